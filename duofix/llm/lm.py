"""A hashed maximum-entropy language model with class-factored softmax.

Tokens: words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, by 64-bit hash, then one end token.
P(w | history) = P(class(w) | features of the history) * P(w | class(w), class of the previous token).

Classes: the end token; the most frequent words (at most `frequent`, whose counts are broadcast)
in bins of about equal mass; all other words by shape (last byte, length, bytes over 127), so that
a word's class needs no table.

P(class | history) is a softmax over sums of weight rows, found by hashing: bias, previous word,
previous two words, the word before the previous one (skip), and the last very frequent word
(skip over any gap). Texts are dealt into shards by a hash, of a size that follows from the number of training
tokens alone, and each shard is dealt into rounds. In a round every shard runs gradient steps over its texts
of the round, in the order of their hashes, from the weights that all shards start with; then the
weights are averaged, each row by how often the shards updated it. So the weights depend neither on
files nor on tasks. The number of weight rows grows with the training tokens up to `most_rows`.

P(w | class, previous class) is a softmax over the words of the class, with a bias (log of count + 0.5) and a weight for each class
of the previous token. Its weights are trained on the pairs' counts, which are gathered with the gradient steps, class by class
in tasks of their own, by gradient steps over the curvature's diagonal under a Gaussian prior. Words that aren't among the frequent ones have the bias
alone. One more slot of weight 0.5 is that of unknown words, so that the probabilities of each class sum to 1 at most.

Counts cover all training texts. Words that aren't broadcast get their counts by a join.
Null text is empty (one token, the end). A null id is held out. Rows are independent, repeated
rows each get their scores. Without training texts every count is 0; an empty table gives an empty result. Texts of any
length are scored whole; columns beyond the id and the text are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut, map_arrow, pick
from .text import SPACED, Lookup, U, Words, distinct_pairs, mix, raw, slices

END = U(0x00E11D)
BINS, SHAPES = 23, 8
CLASSES = 1 + BINS + SHAPES
ANCHORS = 256
CHUNK = 2048  # weight rows sent together
BLOCK = 4096  # words whose pair counts are sent together
CONTEXTS = CLASSES + 1  # classes of the previous token, and none

# Shapes by last byte: letters and digits by length; then marks; high bytes.
_LAST = np.full(256, 7)
_LAST[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
_LAST[0x80:] = 3
_LAST[[0x2E]] = 4
_LAST[[0x2C]] = 5
_LAST[[0x21]] = 6


def shapes(w: Words) -> np.ndarray:
    """0..SHAPES-1 for each word, a function of its bytes."""
    if not len(w):
        return np.empty(0, np.int64)
    last = _LAST[w.data[w.ends - 1]]
    high = np.concatenate([[0], np.cumsum(w.data >= 0x80)])
    plain = last == 0
    out = last.copy()
    out[plain & (w.ends - w.starts > 9)] = 1
    out[plain & (high[w.ends] > high[w.starts])] = 2
    return out


def stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, token shapes (-1: end), and texts' bounds in tokens."""
    n = len(w.counts)
    bounds = w.bounds + np.arange(n + 1)
    h = np.full(len(w) + n, END)
    s = np.full(len(h), -1)
    at = np.arange(len(w)) + w.doc()
    h[at], s[at] = w.hashes, shapes(w)
    return h, s, bounds


def _count(batches, text_col: str, most: int = 8_000_000):
    held, size = [], 0

    def flush():
        h = np.concatenate([x[0] for x in held])
        s = np.concatenate([x[1] for x in held])
        keys, first, c = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(s[first].astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "shape", "c"])

    for batch in batches:
        for part in slices(batch, text_col):
            h, s, _ = stream(Words(*raw(part.column(text_col)), SPACED))
            held.append((h, s))
            size += len(h)
            if size >= most:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Vocabulary:
    """Frequent words with counts and classes, and the sizes of all classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, rest_tokens: np.ndarray, rest_types: np.ndarray):
        end = h == END
        self.end_count = int(c[end].sum())
        h, c = h[~end], c[~end]
        self.lookup = Lookup(h)
        self.count = np.zeros(len(self.lookup.keys), np.int64)
        self.count[np.searchsorted(self.lookup.keys, h)] = c
        order = np.lexsort((self.lookup.keys, -self.count))
        mass = np.cumsum(self.count[order])
        self.cls = np.zeros(len(order), np.int64)
        if len(order):
            self.cls[order] = 1 + np.minimum((mass - self.count[order]) * BINS // max(1, int(mass[-1])), BINS - 1)
        self.anchor = np.full(len(order), -1)
        self.anchor[order[:ANCHORS]] = np.arange(min(ANCHORS, len(order)))
        tokens = np.zeros(CLASSES)
        types = np.zeros(CLASSES)
        tokens[0], types[0] = self.end_count, 1
        np.add.at(tokens, self.cls, self.count)
        np.add.at(types, self.cls, 1)
        tokens[1 + BINS :] = rest_tokens
        types[1 + BINS :] = rest_types
        self.tokens = tokens
        self.log_size = np.log10(tokens + 0.5 * (types + 1))
        self.log_count = np.log10(self.count + 0.5)
        # frequent words by rank, so that each class is a run of ranks, cut into blocks
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.start = np.searchsorted(self.cls[order], np.arange(CLASSES + 1))
        self.first_block = np.concatenate([[0], np.cumsum(-(-np.diff(self.start) // BLOCK))])
        self.by_rank = self.count[order]

    def read(self, h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token among the frequent words, or -1; class)."""
        place = np.full(len(h), -1)
        at, found = self.lookup.find(h)
        word = s[at] >= 0
        place[at[word]] = found[word]
        cls = np.where(s < 0, 0, 1 + BINS + s)
        cls[at[word]] = self.cls[found[word]]
        return place, cls


def features(place: np.ndarray, cls: np.ndarray, bounds: np.ndarray, anchor: np.ndarray, rows: int) -> np.ndarray:
    """(tokens, 5) weight rows; row 0 is the bias."""
    n = len(place)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    i = np.arange(n)
    ident = np.where(place >= 0, place + 64, cls).astype(U)
    begin = U(63)
    one = np.where(i - 1 >= start, ident[np.maximum(i - 1, 0)], begin)
    two = np.where(i - 2 >= start, ident[np.maximum(i - 2, 0)], begin)
    mark = np.where(place >= 0, anchor[np.maximum(place, 0)] if len(anchor) else -1, -1) if n else place
    last = np.maximum.accumulate(np.where(mark >= 0, i, -1)) if n else i
    last = np.concatenate([[-1], last[:-1]]) if n else last
    far = np.where(last >= start, mark[np.maximum(last, 0)], ANCHORS).astype(U)
    out = np.zeros((n, 5), np.int64)
    with np.errstate(over="ignore"):
        for k, x in enumerate((one, one * U(0x9E3779B97F4A7C15) + two, two, far)):
            out[:, k + 1] = 1 + ((mix(x * U(8) + U(k + 1)) >> U(32)) * U(rows - 1) >> U(32)).astype(np.int64)
    return out


def logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = np.take(w, f[:, 1], axis=0, mode="clip")
    for k in range(2, f.shape[1]):
        z += np.take(w, f[:, k], axis=0, mode="clip")
    z += w[0]
    z -= z.max(axis=1, keepdims=True)
    return z


def contexts(cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of each token's predecessor in its text, or CLASSES."""
    out = np.concatenate([[CLASSES], cls[:-1]]) if len(cls) else cls.copy()
    out[bounds[:-1]] = CLASSES  # every text has a token
    return out


def _sorted(x: np.ndarray) -> np.ndarray:
    """argsort of numbers under 2^32, by two radix sorts."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order if x.max(initial=0) < 1 << 16 else order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]


class Learner:
    """The gradient steps of one shard in one round, and its pair counts."""

    def __init__(self, vocab: Vocabulary, w: np.ndarray, square: np.ndarray, rate: float, step: int = 8192):
        self.vocab, self.rate, self.step, self.before = vocab, rate, step, w
        self.w, self.square, self.seen = w.copy(), np.repeat(square[:, None], CLASSES, axis=1), np.zeros(len(w), np.int64)
        self.f, self.y, self.pairs = [], [], []
        self.size = 0

    def feed(self, part: pa.RecordBatch, text_col: str) -> None:
        h, s, bounds = stream(Words(*raw(part.column(text_col)), SPACED))
        place, cls = self.vocab.read(h, s)
        self.f.append(features(place, cls, bounds, self.vocab.anchor, len(self.w)).astype(np.int32))
        self.y.append(cls)
        top = np.flatnonzero(place >= 0)
        self.pairs.append(np.unique(self.vocab.rank[place[top]] * CONTEXTS + contexts(cls, bounds)[top], return_counts=True))
        self.size += len(cls)
        if self.size >= self.step:
            self._steps(self.size // self.step * self.step)

    def _steps(self, end: int) -> None:
        """Steps of equal numbers of tokens, whatever the batches they came in."""
        f, y = np.concatenate(self.f), np.concatenate(self.y)
        for a in range(0, end, self.step):
            self._update(f[a : min(a + self.step, end)], y[a : min(a + self.step, end)])
        self.f, self.y, self.size = [f[end:]], [y[end:]], len(y) - end

    def _update(self, x: np.ndarray, y: np.ndarray) -> None:
        w, square = self.w, self.square
        p = np.exp(logits(w, x))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        flat = x[:, 1:].reshape(-1)
        order = _sorted(flat)
        ranked = flat[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        g = np.add.reduceat(np.take(p, order // (x.shape[1] - 1), axis=0, mode="clip"), cuts, axis=0)
        who = np.concatenate([ranked[cuts], [0]])
        g = np.concatenate([g, p.sum(axis=0, keepdims=True)])
        n = np.concatenate([np.diff(np.concatenate([cuts, [len(flat)]])), [len(y)]])
        g /= np.sqrt(n).astype(np.float32)[:, None]
        sq = square[who] + g * g
        square[who] = sq
        w[who] -= np.float32(self.rate) * g / np.sqrt(sq)
        self.seen[who] += n

    def done(self):
        """Rows (part, a, b, c): changed weights by chunk, then pair counts by block of words (parts under 0)."""
        if self.size:
            self._steps(self.size)
        out = []
        for k in range(0, len(self.w), CHUNK):
            at = slice(k, k + CHUNK)
            if self.seen[at].any():
                out.append((k // CHUNK, (self.w[at] - self.before[at]).astype(np.float16).tobytes(), self.seen[at].tobytes(), self.square[at].mean(axis=1).tobytes()))
        keys, count = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        count = np.bincount(at, count, len(keys)).astype(np.int64)
        rank = keys // CONTEXTS
        cls = np.searchsorted(self.vocab.start, rank, side="right") - 1
        inner = rank - self.vocab.start[cls]
        block = self.vocab.first_block[cls] + inner // BLOCK
        local = (inner % BLOCK * CONTEXTS + keys % CONTEXTS).astype(np.int32)
        edges = np.searchsorted(block, np.arange(self.vocab.first_block[-1] + 1))
        for b in np.unique(block):
            a, e = edges[b], edges[b + 1]
            out.append((-1 - int(b), local[a:e].tobytes(), count[a:e].tobytes(), b""))
        return _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["part", "a", "b", "c"])


PARTS = "part int, a binary, b binary, c binary"


def _train(batches, text_col: str, vocab: Vocabulary, w: np.ndarray, square: np.ndarray, rate: float):
    """Rows sorted by shard."""
    now, learner = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), [len(shard)]]) if len(shard) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if shard[a] != now:
                if learner:
                    yield learner.done()
                now, learner = shard[a], Learner(vocab, w, square, rate)
            for part in slices(batch.slice(a, b - a), text_col):
                learner.feed(part, text_col)
    if learner:
        yield learner.done()


def _sums(batches, first: bool, last: bool):
    """Sums by part as the rows come, so that memory doesn't grow with their number. first: of rows of Learner.done; last: gives the weights' means."""
    total: dict[int, list] = {}
    for batch in batches:
        for k, a, b, c in zip(batch.column("part").to_pylist(), *(batch.column(x) for x in "abc"), strict=True):
            b = np.frombuffer(b.as_buffer(), np.int64)
            if k < 0:
                have = total.setdefault(k, [None, np.zeros(BLOCK * CONTEXTS, np.int64), None])
                have[1][np.frombuffer(a.as_buffer(), np.int32) if first else slice(None)] += b
            else:
                x = np.frombuffer(a.as_buffer(), np.float16 if first else np.float64).reshape(-1, CLASSES).astype(np.float64)
                q = np.frombuffer(c.as_buffer(), np.float32 if first else np.float64).astype(np.float64)
                if first:
                    x, q = x * b[:, None], q * b
                have = total.setdefault(k, [0.0, 0, 0.0])
                total[k] = [have[0] + x, have[1] + b, have[2] + q]
    out = []
    for k, (a, b, c) in total.items():
        if k < 0:
            out.append((k, b"", b.tobytes(), b""))
        elif last:
            n = np.maximum(b, 1)
            out.append((k, (a / n[:, None]).astype(np.float16).tobytes(), b"", (c / n).astype(np.float32).tobytes()))
        else:
            out.append((k, a.tobytes(), b.tobytes(), c.tobytes()))
    if out:
        yield _rows(out)


def inner_softmax(count: np.ndarray, pairs: np.ndarray, prior: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, words x contexts; natural log of the normaliser for each context) of the softmax inside a class."""
    bias = np.log(count + 0.5)[:, None]
    seen = pairs.sum(axis=0)
    u = np.zeros(pairs.shape)

    def normaliser():
        return np.log(np.exp(bias + u).sum(axis=0) + 0.5)

    for _ in range(steps):
        want = seen * np.exp(bias + u - normaliser())
        u += np.clip((pairs - want - prior * u) / (np.maximum(want, pairs) + prior), -1, 1)
    u = u.astype(np.float16).astype(np.float64)
    return u, normaliser()


def _inner(t: pa.Table, vocab: Vocabulary, prior: float, steps: int) -> pa.Table:
    """The trained softmax of one class from its blocks of pair counts."""
    c = t.column("cls")[0].as_py()
    start, end = vocab.start[c], vocab.start[c + 1]
    pairs = np.zeros((-(-(end - start) // BLOCK) * BLOCK, CONTEXTS))
    for k, b in zip(t.column("part").to_pylist(), t.column("b"), strict=True):
        at = (-1 - k - vocab.first_block[c]) * BLOCK
        pairs[at : at + BLOCK] += np.frombuffer(b.as_buffer(), np.int64).reshape(BLOCK, CONTEXTS)
    u, z = inner_softmax(vocab.by_rank[start:end], pairs[: end - start], prior, steps)
    return pa.table({"cls": pa.array([c], pa.int32()), "u": pa.array([u.astype(np.float16).tobytes()], pa.binary()), "z": pa.array([z.tobytes()], pa.binary())})


def _score(batch: pa.RecordBatch, id_col: str, text_col: str, vocab: Vocabulary, w: np.ndarray, u: np.ndarray, log_z: np.ndarray):
    for part in slices(batch, text_col):
        h, s, bounds = stream(Words(*raw(part.column(text_col)), SPACED))
        place, cls = vocab.read(h, s)
        f = features(place, cls, bounds, vocab.anchor, len(w))
        lp = np.empty(len(h))
        for a in range(0, len(h), 4096):
            z = logits(w, f[a : a + 4096])
            lp[a : a + 4096] = z[np.arange(len(z)), cls[a : a + 4096]] - np.log(np.exp(z).sum(axis=1))
        end, top, ctx = s < 0, place >= 0, contexts(cls, bounds)
        inner = -vocab.log_size[cls]
        inner[top] = (u[vocab.rank[place[top]], ctx[top]] - log_z[cls[top], ctx[top]]) / np.log(10)
        lp = lp / np.log(10) + inner
        known = np.where(end, np.log10(vocab.end_count + 0.5), 0.0)
        known[top] = vocab.log_count[place[top]]
        have = (top | end) & (~end | (vocab.end_count > 0))
        total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has a token
        rest = ~top & ~end
        d = np.repeat(np.arange(part.num_rows), np.diff(bounds))[rest]
        d2, g2 = distinct_pairs(d, h[rest])
        order = np.lexsort((h[rest], d))
        ds, gs = d[order], h[rest][order]
        new = np.ones(len(ds), bool)
        new[1:] = (ds[1:] != ds[:-1]) | (gs[1:] != gs[:-1])
        tf = np.diff(np.concatenate([np.flatnonzero(new), [len(ds)]]))
        edges = np.searchsorted(d2, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("row"),
                part.column(id_col),
                part.column("held_out"),
                pa.array(np.diff(bounds)),
                pa.array(total(have.astype(np.int64))),
                pa.array(total(known)),
                pa.array(total(lp)),
                pa.ListArray.from_arrays(edges, pa.array(g2.view(np.int64))),
                pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int32))),
            ],
            ["row", id_col, "held_out", "n_tokens", "n_known", "known", "model", "rest", "tf"],
        )


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = 5,
    held_fold: int = 1,
    frequent: int = 1 << 18,
    least_rows: int = 1 << 16,
    most_rows: int = 1 << 18,
    tokens_a_row: int = 256,
    rounds: int = 2,
    rate: float = 0.1,
    prior: float = 1.0,
    inner_steps: int = 40,
) -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram) and score, both log10.

    Rows whose crc32(id as text) mod fold is held_fold aren't learned from. frequent bounds the words whose counts and weights
    are broadcast (82 bytes each); the weight rows (128 bytes each) are a power of two, one for at least tokens_a_row training
    tokens, from least_rows up to most_rows.
    """
    spark = docs.sparkSession
    mine = pick(docs, id_col, text_col).withColumn("held_out", F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % fold == held_fold, F.lit(True)))
    train = mine.where("not held_out").select(text_col, F.xxhash64(text_col, id_col).alias("order"), F.xxhash64(id_col, text_col).alias("deal"))

    counts = cut(train.select(text_col).mapInArrow(lambda it: _count(it, text_col), "h long, shape int, c long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that at most `frequent` words reach, from a histogram of some hundred rows
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    level, have = None, 0
    for r in steps:
        have += r["n"]
        if have > frequent:
            break
        level = r["level"]
    often = (F.floor(F.log2("c") * 16) >= level) if level is not None else F.lit(False)
    end = F.col("h") == int(END)
    top = counts.where(often | end).select("h", "c").toArrow()
    rest = {r["shape"]: r for r in counts.where(~(often | end)).groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    vocab = Vocabulary(
        top["h"].to_numpy().view(U), top["c"].to_numpy(), np.array([rest[k]["c"] if k in rest else 0 for k in range(SHAPES)], float), np.array([rest[k]["n"] if k in rest else 0 for k in range(SHAPES)], float)
    )
    words = spark.sparkContext.broadcast(vocab)

    rows = least_rows
    while rows < most_rows and n >= 2 * rows * tokens_a_row:
        rows *= 2
    shards = max(1, n // (64 * rows))
    w, square = np.zeros((rows, CLASSES), np.float32), np.full(rows, 1e-2, np.float32)
    w[0] = np.log((vocab.tokens + 0.5) / (vocab.tokens + 0.5).sum())
    pairs = []
    for k in range(rounds):
        start = spark.sparkContext.broadcast((w, square))
        mine_ = train.where(F.pmod(F.shiftright("order", 32), F.lit(rounds)) == k).withColumn("shard", F.pmod("deal", F.lit(shards)))
        parts = mine_.repartition("shard").sortWithinPartitions("shard", "order").select("shard", text_col).mapInArrow(lambda it, s=start: _train(it, text_col, words.value, *s.value, rate), PARTS)
        salts = min(16, shards // 16)
        if salts > 1:
            parts = parts.withColumn("salt", F.spark_partition_id() % salts).repartition("part", "salt").mapInArrow(lambda it: _sums(it, True, False), PARTS)
        total = cut(parts.repartition("part").mapInArrow(lambda it, raw_=salts < 2: _sums(it, raw_, True), PARTS))
        start.destroy()
        got = total.where("part >= 0").select("part", "a", "c").toArrow()  # rows * 68 bytes at most
        for i, a, c in zip(got["part"].to_pylist(), got["a"], got["c"], strict=True):
            at = slice(i * CHUNK, (i + 1) * CHUNK)
            w[at] += np.frombuffer(a.as_buffer(), np.float16).reshape(-1, CLASSES)
            square[at] = np.maximum(square[at], np.frombuffer(c.as_buffer(), np.float32))
        del got
        pairs.append(total.where("part < 0").select("part", "b"))

    u, log_z = np.zeros((len(vocab.count), CONTEXTS), np.float16), np.repeat(np.log(10) * vocab.log_size[:, None], CONTEXTS, axis=1)
    class_of = F.lit(0)
    for c in range(CLASSES):
        class_of = F.when(-1 - F.col("part") >= int(vocab.first_block[c]), c).otherwise(class_of) if vocab.start[c + 1] > vocab.start[c] else class_of
    every = pairs[0]
    for x in pairs[1:]:
        every = every.unionByName(x)
    inner = every.withColumn("cls", class_of.cast("int")).groupBy("cls").applyInArrow(lambda t: _inner(t, words.value, prior, inner_steps), "cls int, u binary, z binary").toArrow()  # `frequent` * 66 bytes at most
    for c, x, z in zip(inner["cls"].to_pylist(), inner["u"], inner["z"], strict=True):
        u[vocab.start[c] : vocab.start[c + 1]] = np.frombuffer(x.as_buffer(), np.float16).reshape(-1, CONTEXTS)
        log_z[c] = np.frombuffer(z.as_buffer())
    weights = spark.sparkContext.broadcast((w, u, log_z))
    del inner, w, u

    kind = mine.schema[id_col].dataType.simpleString()
    first = cut(
        map_arrow(
            mine.withColumn("row", F.monotonically_increasing_id()),
            lambda b: _score(b, id_col, text_col, words.value, *weights.value),
            f"row long, `{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, known double, model double, rest array<long>, tf array<int>",
        )
    )
    words.destroy()  # what follows reads the cut
    weights.destroy()
    tail = first.select("row", F.explode(F.arrays_zip("rest", "tf")).alias("x")).select("row", F.col("x.rest").alias("h"), "x.tf")
    sums = (
        tail.join(counts.where(~often).select("h", "c"), "h", "left")
        .groupBy("row")
        .agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).cast("long").alias("tail_known"))
    )
    known = F.col("known") + F.coalesce("tail", F.lit(0.0))
    return first.join(sums, "row", "left").select(
        f"`{id_col}`",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (known - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (known + F.col("model")).alias("score"),
    )
