"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of an item (a shorter item is one window of all its words).
Both sides hash their k-grams, and of every run of w = window - k + 1 k-grams, which is one
window of words, the minimum hash stands for it. Equal windows have equal minima, so joining the
minima finds every shared window; each hit is then extended to the window's words and compared
as a whole (64-bit hash of the word sequence), and overlapping windows merge into spans. Items
shorter than a window are compared by the n-grams of their own length.

The benchmark's hashes are broadcast only after their count has been checked against
`broadcast_windows`; beyond that both sides' fingerprints are shuffled and joined.

Null and empty texts have no words, hit nothing and are never contaminated. Rows are independent:
repeated rows each get their result. Items with a null id mark words but count as no item;
an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut, map_arrow, pick
from .text import ALNUM, Lookup, U, Words, gram, positions, raw, slices

K = 5


def _minima(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows' first words and the minimum k-gram hash of each."""
    pos = positions(w.bounds, window)
    if not len(pos):
        return pos, np.empty(0, U)
    at = np.arange(len(w) - k + 1)
    g = gram(w.hashes, at, k)  # those across texts are never looked at
    low, have = g, 1
    run = window - k + 1
    while have < run:
        step = min(have, run - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return pos, low[pos]


def _windows(batch: pa.RecordBatch, id_col: str, text_col: str, window: int, k: int):
    for part in slices(batch, text_col):
        w = Words(*raw(part.column(text_col)), ALNUM)
        ids = part.column(id_col).cast(pa.string()).to_pylist()
        pos, low = _minima(w, window, k)
        doc = np.searchsorted(w.bounds, pos, side="right") - 1
        rows = [(doc, np.full(len(pos), window), gram(w.hashes, pos, window) if len(pos) else low, low)]
        for n in range(1, window):
            who = np.flatnonzero(w.counts == n)
            if len(who):
                g = gram(w.hashes, w.bounds[who], n)
                rows.append((who, np.full(len(who), n), g, g))
        doc, size, whole, low = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[d] for d in doc], pa.string()), pa.array(size, pa.int32()), pa.array(whole.view(np.int64)), pa.array(low.view(np.int64))], ["item", "size", "whole", "low"]
        )


class Index:
    """The benchmark's windows: fingerprints to look for, whole windows, and each window's items."""

    def __init__(self, size: np.ndarray, whole: np.ndarray, low: np.ndarray, item: list[str | None], window: int):
        self.window = window
        self.names = sorted({x for x in item if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        code = np.array([-1 if x is None else number[x] for x in item], dtype=np.int64)
        whole, low = whole.view(U), low.view(U)
        self.low = Lookup(low[size == window])
        self.by_size = {}
        for n in np.unique(size):
            at = size == n
            keys = Lookup(whole[at])
            place = np.searchsorted(keys.keys, whole[at])
            pairs = np.unique(np.stack([place, code[at]]), axis=1)
            pairs = pairs[:, pairs[1] >= 0]
            self.by_size[int(n)] = keys, np.searchsorted(pairs[0], np.arange(len(keys.keys) + 1)), pairs[1]

    def hits(self, w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is hit, text and item number of each distinct pair)."""
        mark = np.zeros(len(w) + 1, np.int64)
        found = []
        for n, (keys, first, items) in self.by_size.items():
            if n == self.window:
                pos, low = _minima(w, n, k)
                pos = pos[self.low.find(low)[0]]  # candidates, extended below
            else:
                pos = positions(w.bounds, n)
            if not len(pos):
                continue
            at, place = keys.find(gram(w.hashes, pos, n))
            pos = pos[at]
            np.add.at(mark, pos, 1)
            np.add.at(mark, pos + n, -1)
            doc = np.searchsorted(w.bounds, pos, side="right") - 1
            # a text repeats a window: look its items up once
            both = np.unique(np.stack([doc, place]), axis=1)
            size = first[both[1] + 1] - first[both[1]]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.stack([np.repeat(both[0], size), items[np.repeat(first[both[1]], size) + inner]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return np.cumsum(mark[:-1]) > 0, pairs[0], pairs[1]


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = 10, k: int = K) -> DataFrame:
    """Distinct item (string), size in words, hash of the whole window and its fingerprint."""
    rows = pick(benchmark, item_col, text_col)
    return map_arrow(rows, lambda b: _windows(b, item_col, text_col, window, k), "item string, size int, whole long, low long").distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = K, broadcast_windows: int = 1_000_000
) -> DataFrame:
    """For each document: id, n_words, n_hit, items (array<string>, sorted), n_items, items_sha256 and contaminated."""
    k = min(k, window)
    known = cut(benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window, k=k))
    rows = pick(docs, id_col, text_col)
    if known.count() > broadcast_windows:
        out = _joined(rows, known, id_col, text_col, window, k)
    else:
        got = known.toArrow()
        index = Index(*(got["size"].to_numpy(), got["whole"].to_numpy(), got["low"].to_numpy(), got["item"].to_pylist()), window)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        kind = rows.schema[id_col].dataType.simpleString()

        def run(batch: pa.RecordBatch):
            for part in slices(batch, text_col):
                w = Words(*raw(part.column(text_col)), ALNUM)
                hit, doc, item = shared.value.hits(w, k)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[w.bounds[1:]] - total[w.bounds[:-1]]
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                names = shared.value.names
                items = [[names[i] for i in item[a:b]] if b > a else [] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(w.counts), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], [id_col, "n_words", "n_hit", "items"])

        out = map_arrow(rows, run, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>")
    return out.select(
        f"`{id_col}`", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _joined(rows: DataFrame, known: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """The same by joins of fingerprints, for a benchmark of any size. Rows of one id and text share their hits."""
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most `window` numbers

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            w = Words(*raw(part.column(text_col)), ALNUM)
            keys = part.column("key").to_numpy()
            for n in sizes:
                if n == window:
                    pos, low = _minima(w, n, k)
                else:
                    pos, low = w.ngrams(n)
                if not len(pos):
                    continue
                doc = np.searchsorted(w.bounds, pos, side="right") - 1
                order = np.lexsort((pos, low, doc))
                new = np.ones(len(order), bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (low[order][1:] != low[order][:-1])
                cuts = np.flatnonzero(new)
                edges = np.concatenate([cuts, [len(order)]]).astype(np.int32)
                whole = gram(w.hashes, pos[order], n).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[doc[order][cuts]]),
                        pa.array(np.full(len(cuts), n), pa.int32()),
                        pa.array(low[order][cuts].view(np.int64)),
                        pa.ListArray.from_arrays(edges, pa.array((pos - w.bounds[doc])[order], pa.int32())),
                        pa.ListArray.from_arrays(edges, pa.array(whole)),
                    ],
                    ["key", "size", "low", "at", "whole"],
                )

    def count(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            w = Words(*raw(part.column(text_col)), ALNUM, hashed=False)
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("key"), pa.array(w.counts)], [id_col, "key", "n_words"])

    kind = rows.schema[id_col].dataType.simpleString()
    keyed = rows.withColumn("key", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    prints = map_arrow(keyed.dropDuplicates(["key"]), run, "key long, size int, low long, at array<int>, whole array<long>")
    near = prints.join(known.select("size", "low").distinct(), ["size", "low"], "left_semi")
    spots = near.select("key", "size", F.explode(F.arrays_zip("at", "whole")).alias("x")).select("key", "size", "x.at", "x.whole")
    hits = cut(spots.join(known.select("size", "whole", "item"), ["size", "whole"]).select("key", "size", "at", "item").distinct())
    words = hits.select("key", "size", "at").distinct().select("key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    items = hits.where("item is not null").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return (
        map_arrow(keyed, count, f"`{id_col}` {kind}, key long, n_words long")
        .join(words, "key", "left")
        .join(items, "key", "left")
        .select(f"`{id_col}`", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
