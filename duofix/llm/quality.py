"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text, each hashed to one of `size` weights: white-space tokens, pairs of
neighbouring words, runs of marks and pairs of such runs (A-Z as a-z). A feature's value is its
share among the features of its kind, times `SCALE`, so long and short texts compare.

Labels come from at most about `most_train` labelled texts outside the held-out fold, chosen by a hash of the
id. They are few enough for one task, which runs the sequential updates and returns the weights;
scoring covers every whole text as sparse dot products, batch by batch.

Null and empty texts have no features and get the score of the bias. Rows are independent, a null
id is held out. Rows of labels that share an id count once, by their mean label; null labels are
ignored. Without labels of both classes the score is their share, 0.5 if there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import map_arrow, pick
from .text import ALNUM, SPACED, U, Words, gram, mix, positions, raw, slices

SCALE = 8.0
MARKS = SPACED & ~ALNUM
MARKS[:0x20] = False


def parts(data: np.ndarray, off: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: weight numbers, and the n + 1 bounds of texts among them."""
    out = []
    for kind, (is_word, n) in enumerate(((SPACED, 1), (ALNUM, 2), (MARKS, 1), (MARKS, 2))):
        w = out[-1][2] if kind == 3 else Words(data, off, is_word)
        pos = positions(w.bounds, n)
        h = gram(w.hashes, pos, n) if len(pos) else np.empty(0, U)
        with np.errstate(over="ignore"):
            at = 1 + (mix(h + U(kind * 7919)) % U(size - 1)).astype(np.int64)
        room = np.maximum(w.counts - n + 1, 0)
        out.append((at, np.concatenate([[0], np.cumsum(room)]), w))
    return [x[:2] for x in out]


def dot(w: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The linear score of each text; weight 0 is the bias."""
    n = len(kinds[0][1]) - 1
    z = np.full(n, w[0])
    for at, bounds in kinds:
        count = np.diff(bounds)
        total = np.concatenate([[0.0], np.cumsum(w[at])])
        z += SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(count, 1)
    return z


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def vectors(data: np.ndarray, off: np.ndarray, size: int):
    """(weight numbers, values) of each text."""
    kinds = parts(data, off, size)
    for i in range(len(off) - 1):
        at = np.concatenate([k[b[i] : b[i + 1]] for k, b in kinds])
        x = np.concatenate([np.full(b[i + 1] - b[i], SCALE / max(1, b[i + 1] - b[i])) for _, b in kinds])
        ids, place = np.unique(at, return_inverse=True)
        yield np.concatenate([[0], ids]), np.concatenate([[1.0], np.bincount(place, x, len(ids))])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.arange(len(y))
    for e in range(epochs):
        np.random.default_rng(e).shuffle(order)
        for i in order:
            at, x = examples[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (sigmoid(w @ x) - y[i]) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return weights(z, n)


def _learn(batches, text_col: str, size: int, epochs: int):
    rows = []
    for b in batches:
        for part in slices(b, text_col):
            data, off = raw(part.column(text_col))
            rows += zip(part.column("order").to_pylist(), vectors(data, off, size), part.column("label").to_pylist(), strict=True)
    rows.sort(key=lambda r: (r[0], len(r[1][0])))
    y = np.array([r[2] for r in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        w = ftrl([r[1] for r in rows], y, size, epochs)
    else:
        w = np.zeros(size)
        w[0] = 0.0 if not len(y) else 35.0 if y[0] else -35.0
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])


def held(id_col: str, fold: int, held_fold: int):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % fold == held_fold, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 3, held_fold: int = 1, most_train: int = 8000, size: int = 1 << 18, epochs: int = 3) -> np.ndarray:
    """The weights (float32, `size`)."""
    known = (
        pick(labels, id_col, label_col)
        .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label"))
        .where(F.col("label").isNotNull() & ~held("id", fold, held_fold))
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .withColumn("order", F.xxhash64(F.lit(17), "id"))
    )
    n = known.count()
    if n > most_train:
        known = known.where(F.pmod("order", F.lit(1 << 20)) < (1 << 20) * most_train // n)
    text = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = text.join(F.broadcast(known), "id")  # about most_train rows of 20 bytes
    got = sample.select("order", "label", "text").repartition(1).mapInArrow(lambda it: _learn(it, "text", size, epochs), "w binary").first()
    return np.frombuffer(bytes(got["w"]), np.float32).astype(np.float64) if got else np.zeros(size)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold: int = 3, held_fold: int = 1, **options) -> DataFrame:
    """For each row: id, held_out (crc32(id as text) mod fold is held_fold), score (0 to 1) and predicted (score >= 0.5)."""
    w = train(docs, labels, id_col=id_col, text_col=text_col, fold=fold, held_fold=held_fold, **options)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    mine = pick(docs, id_col, text_col).withColumn("held_out", held(id_col, fold, held_fold))
    kind = mine.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            s = sigmoid(dot(shared.value, parts(*raw(part.column(text_col)), len(shared.value))))
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return map_arrow(mine, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", fold: int = 3, held_fold: int = 1, **options) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at least `least`."""
    w = train(docs, labels, id_col=id_col, text_col=text_col, fold=fold, held_fold=held_fold, **options)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            s = sigmoid(dot(shared.value, parts(*raw(part.column(text_col)), len(shared.value))))
            yield part.filter(pa.array(s >= least))

    return map_arrow(docs, run, docs.schema)
