import hashlib
import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from duofix.llm import decontam, pieces, tokens  # noqa: E402
from duofix.llm.text import SPACED, Words, raw  # noqa: E402

ODD = ["a", "b", " ", "  ", "\n", "▁", "é", "́", "漢", "😀", "\x1c", "\xa0", "<|startoftext|>", "'s", "1", "23", "!!", "Σ", "word", "the ", "\t", "\x00", "İ", " ", "ﬁ"]


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, 30))) for _ in range(n)] + ["", None, "abc123" * 3000, "x" * 9000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts()
    t = Tokenizer.from_file(path)
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    rows = tokens.token_counts(frame(spark, texts).repartition(3), path, limit=20).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 20) for r in rows)
    assert tokens.token_counts(frame(spark, []), path).count() == 0


def test_token_counts_without_safe_boundaries(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts(50)
    t = Tokenizer.from_file(path)
    rows = tokens.token_counts(frame(spark, texts), path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_small_cache_gives_the_same_counts():
    c = tokens.Counter(open(public_tokenizers.path("word_bpe_49k.json")).read(), cache_entries=3)
    big = tokens.Counter(open(public_tokenizers.path("word_bpe_49k.json")).read())
    texts = [(x or "").encode() for x in odd_texts(60)]
    assert sum((c.counts(texts[i : i + 5]) for i in range(0, len(texts), 5)), []) == big.counts(texts)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts()
    for r in pieces.encode(frame(spark, texts).repartition(3), path).collect():
        text = texts[r.doc_id] or ""
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        data = text.encode()
        assert r.covered_bytes == len(data) and len(r.span_begin) == len(r.span_end) == len(ids)
        assert b"".join(data[b:e] for b, e in zip(r.span_begin, r.span_end)) == data
    back = pieces.decode(pieces.encode(frame(spark, texts[:5]), path).select("doc_id", "ids", "decoded"), path, out_col="again")
    assert back.where("again <> decoded").count() == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_longest_prefix_normalisation(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    codec = pieces.Codec.__new__(pieces.Codec)
    codec.norm, codec.suffix, codec.identity, codec.starts = proto.normalizer_spec, False, False, frozenset()
    codec.map = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for text in odd_texts(300):
        data = (text or "").encode()
        norm, origin = codec.normalise(data)
        assert norm.decode() == library.normalize(text or "")
        assert len(origin) == len(norm) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(data)


@pytest.mark.parametrize(("rule", "spaces", "symbol"), [("nmt_nfkc", True, None), ("nmt_nfkc_cf", False, None), ("nfkc", True, "word")])
def test_encoding_and_spans_with_a_character_map(spark, tmp_path, rule, spaces, symbol):
    """The public model with another normaliser: ids, decoding and spans against the library's own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, other = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.name = rule
    proto.normalizer_spec.remove_extra_whitespaces = spaces
    if symbol:
        next(p for p in proto.pieces if p.piece == symbol).type = 4
    path = str(tmp_path / "mapped.model")
    open(path, "wb").write(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(300) + ["ﬁne  ＡＢＣ ½ ㌔ e\u0301te\u0301 ", " lead", "trail  ", "①word②"]
    for r in pieces.encode(frame(spark, texts), path).collect():
        text = texts[r.doc_id] or ""
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == sp.decode(ids), text
        own = sp.encode(text, out_type="proto")
        assert len(own.pieces) == len(ids) - 2
        ours = list(zip(r.span_begin, r.span_end, strict=True))[1:-1]
        theirs = [(p.begin, p.end) for p in own.pieces]
        if not any(sp.is_byte(i) for i in ids):  # the library gives all bytes of a character its whole span
            assert ours == theirs, text


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [x or "" for x in odd_texts(100)] + ["İ a\x0bB", "Ab aB"]
    w = Words(*raw(pa.array(texts)), SPACED)
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        want = re.findall(r"[^\x20\x09-\x0D]+", low)
        assert w.counts[i] == len(want)
    h = w.hashes
    assert h[-1] == h[-2]


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - window + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[at : at + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= ids
        names = sorted(str(x) for x in found)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination_equals_brute_force(spark, limit):
    r = random.Random(5)
    vocab = ["ab", "Cd", "éa", "9", "x1", "zz"]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, say(n)) for i, n in enumerate([10, 11, 14, 30, 3, 3, 9, 1, 0])] + [(20, None), (21, "same same same same same same same same same same same same"), (2, say(12))]
    items.append((22, items[3][1]))
    docs = [(i, say(r.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, say(5) + "--" + t.upper() + "!! " + say(4)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "same " * 50), (203, " ".join(items[3][1].split()[2:19]))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    rows = decontam.decontaminate(d, b, broadcast_windows=limit).collect()
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in rows}
    assert len(rows) == len(docs) and got == brute(docs, items)


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.decontaminate(d, none).collect()] == [0, 0]
    assert decontam.decontaminate(d.limit(0), none).count() == 0
