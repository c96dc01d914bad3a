"""Piece encoding and decoding that keeps the place of every piece in the original text.

Normalisation takes, at each place, the longest symbol that the model's author fixed, else the longest prefix that
the model's compiled character map knows (a double-array trie followed by its replacement strings), else one character,
and records for each normalised byte the original byte it comes from. The library gets the normalised text,
with a copy of the model whose own normalisation is switched off, and merges pieces; each piece's
length in the normalised text then gives its span of original bytes through that record.

Where no piece of a byte-pair model has a space mark after another character, a normalised text may be
split before every run of space marks, and a worker remembers the ids of recent segments (at most
`cache_entries`); else whole texts are encoded.

Null text counts as empty: only the begin and end ids, and an empty decoding. Rows are independent, repeated rows
each have their result, and an empty table gives an empty one. Texts of any length are encoded whole; columns beyond the
id and the text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import map_arrow, pick
from .text import slices

MARK = "▁".encode()
_SEGMENT = re.compile(rb"(?:%b)+(?:(?!%b)[\x00-\xff])*" % (MARK, MARK))
_CROSSING = re.compile(f"[^{MARK.decode()}]{MARK.decode()}")


class CharMap:
    """The compiled character map: longest prefix to replacement."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.strings = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes of text that it replaces) of the longest known prefix of text[at:]."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start, size = found
        return self.strings[start : self.strings.index(b"\0", start)], size


class Codec:
    """One sentencepiece model with alignment."""

    def __init__(self, model: bytes, cache_entries: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.norm, train = sentencepiece_model_pb2.NormalizerSpec(), proto.trainer_spec
        self.norm.CopyFrom(proto.normalizer_spec)
        self.suffix = train.treat_whitespace_as_suffix
        self.map = CharMap(self.norm.precompiled_charsmap)
        kinds = [p.type for p in proto.pieces]
        self.fixed = sorted((p.piece.encode() for p, k in zip(proto.pieces, kinds, strict=True) if k == 4), key=len, reverse=True)
        self.starts = frozenset(x[0] for x in self.fixed)
        self.sizes = np.array([1 if k == 6 else 0 if k == 3 else len(p.piece.encode()) for p, k in zip(proto.pieces, kinds, strict=True)], dtype=np.int64)
        self.identity = not self.map.units and not self.fixed and self.norm.add_dummy_prefix and not self.norm.remove_extra_whitespaces and self.norm.escape_whitespaces and not self.suffix
        self.separable = self.identity and train.model_type == 2 and train.byte_fallback and 4 not in kinds and not any(_CROSSING.search(p.piece) for p in proto.pieces)
        self.most = cache_entries
        self.known: dict[bytes, bytes] = {}
        bare = proto.normalizer_spec
        bare.name, bare.precompiled_charsmap, bare.normalization_rule_tsv = "identity", b"", ""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.edges = [np.array([x], "<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id())] if min(self.sp.bos_id(), self.sp.eos_id()) >= 0 else None

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and the end, the original byte it comes from."""
        n = self.norm
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.identity:
            b = np.frombuffer(text, np.uint8)
            reps = np.where(b == 0x20, 3, 1)
            return MARK + text.replace(b" ", MARK), np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(b)), reps), [len(b)]])
        out, origin, at, space = bytearray(), [], 0, MARK if n.escape_whitespaces else b" "

        def prefix(at: int) -> tuple[bytes, int]:
            if text[at] in self.starts:
                for x in self.fixed:
                    if text.startswith(x, at):
                        return x, len(x)
            if hit := self.map.longest(text, at):
                return hit
            lead = text[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return text[at : at + size], size

        if n.remove_extra_whitespaces:
            while at < len(text) and prefix(at)[0] == b" ":
                at += prefix(at)[1]
            if at == len(text):
                return b"", np.array([at], np.int64)
        if n.add_dummy_prefix and not self.suffix:
            out += space
            origin += [at] * len(space)
        after_space = n.remove_extra_whitespaces
        while at < len(text):
            piece, size = prefix(at)
            while after_space and piece[:1] == b" ":
                piece = piece[1:]
            if piece:
                same = piece == text[at : at + size]
                for k, byte in enumerate(piece):
                    put = space if byte == 0x20 else bytes([byte])
                    out += put
                    origin += [at + k if same else at] * len(put)
                after_space = piece.endswith(b" ")
            at += size
            after_space = after_space and n.remove_extra_whitespaces
        if n.remove_extra_whitespaces:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[-len(space)]
                del origin[-len(space) :]
        if n.add_dummy_prefix and self.suffix:
            out += space
            origin += [at] * len(space)
        return bytes(out), np.array([*origin, at], np.int64)

    def _segments(self, norm: bytes) -> list[bytes]:
        """The parts of a normalised text that begin with a run of space marks."""
        if not norm:
            return []
        if MARK + MARK in norm or norm.endswith(MARK):
            return _SEGMENT.findall(norm)
        return [MARK + x for x in norm.split(MARK)[1:]]

    def ids(self, norms: list[bytes]) -> list[bytes]:
        """The ids of each normalised text as little-endian unsigned 32-bit integers, without begin and end."""
        if not self.separable:
            got = self.bare.encode([t.decode("utf-8", "replace") for t in norms], num_threads=1)
            return [np.array(x, "<u4").tobytes() for x in got]
        split = [self._segments(t) for t in norms]
        words = set().union(*split)
        known = self.known
        new = {w for w in words if w not in known}
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, words
        if new:
            ordered = list(new)
            got = self.bare.encode([s.decode("utf-8", "replace") for s in ordered], num_threads=1)
            self.known.update((s, np.array(x, "<u4").tobytes()) for s, x in zip(ordered, got, strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def spans(self, norm: bytes, origin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end original byte of each piece, by what normalise gave."""
        to = np.cumsum(self.sizes[ids])
        if len(ids) and to[-1] != len(norm):
            if not (ids == self.sp.unk_id()).any():
                raise ValueError("the pieces don't cover the normalised text")
            to = self._with_unknown(norm, ids)
        ends = origin[to]
        begins = np.concatenate([origin[:1], ends[:-1]]) if len(ids) else ends
        return begins, ends

    def _with_unknown(self, norm: bytes, ids: np.ndarray) -> np.ndarray:
        """Ends of pieces where some are unknown: such a piece goes on to where the next known ones fit."""
        to, at = [], 0
        pieces = [self.sp.id_to_piece(int(i)).encode() for i in ids]
        unk = self.sp.unk_id()
        for k, i in enumerate(ids):
            if i != unk:
                at += int(self.sizes[i])
            else:
                rest = b""
                for j in range(k + 1, len(ids)):
                    if ids[j] == unk:
                        break
                    rest += pieces[j] if self.sizes[ids[j]] else b""
                at = norm.index(rest, at + 1) if rest and k + 1 < len(ids) else len(norm) if k + 1 == len(ids) or not rest else at
            to.append(at)
        return np.array(to, np.int64)


_codecs: dict[int, Codec] = {}


def encode(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, cache_entries: int = 300_000) -> DataFrame:
    """Encodes each text with begin and end ids, and decodes the ids again.

    Columns: id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (original bytes that the
    pieces' spans cover) and, unless digests_only, ids, span_begin, span_end (array<int>, original
    bytes) and decoded. model: path of a .model file, read on the driver and broadcast.
    """
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = pick(df, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    key = hash((model, cache_entries))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"] + ([] if digests_only else ["ids", "span_begin", "span_end", "decoded"])

    def run(batch: pa.RecordBatch):
        codec = _codecs.get(key)
        if codec is None:
            codec = _codecs[key] = Codec(shared.value, cache_entries)
        bos, eos = codec.edges or (b"", b"")
        for part in slices(batch, text_col):
            texts = [x or b"" for x in part.column(text_col).cast(pa.large_binary()).to_pylist()]
            norms = [codec.normalise(t) for t in texts]
            bare = codec.ids([n for n, _ in norms])
            full = [bos + x + eos for x in bare]
            lists = [np.frombuffer(x, "<u4").tolist() for x in full]
            decoded = codec.sp.decode(lists, num_threads=1)
            spans = [codec.spans(*n, np.frombuffer(x, "<u4")) for n, x in zip(norms, bare, strict=True)]
            columns = [
                part.column(id_col),
                pa.array([len(x) for x in lists], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in full], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                pa.array([int((e - b).sum()) for b, e in spans], pa.int64()),
            ]
            if not digests_only:
                pad = lambda s, k, t: [0, *s[k].tolist(), len(t)] if codec.edges else s[k].tolist()
                columns += [pa.array(lists, pa.list_(pa.int32()))]
                columns += [pa.array([pad(s, k, t) for s, t in zip(spans, texts, strict=True)], pa.list_(pa.int32())) for k in (0, 1)]
                columns += [pa.array(decoded, pa.string())]
                if codec.edges:  # the begin id has the empty span at 0
                    columns[-2] = pa.array([[0, *s[1].tolist(), len(t)] for s, t in zip(spans, texts, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    return map_arrow(rows, run, schema + ("" if digests_only else ", ids array<int>, span_begin array<int>, span_end array<int>, decoded string"))


def decode(df: DataFrame, model: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the library's decoding of ids_col (array of ids; null gives null) in out_col."""
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    key = hash((model, 300_000))

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        codec = _codecs.get(key)
        if codec is None:
            codec = _codecs[key] = Codec(shared.value)
        return pd.Series([None if x is None else codec.sp.decode([int(i) for i in x]) for x in ids])

    return df.withColumn(out_col, back(F.col(ids_col)))
