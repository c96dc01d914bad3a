"""Exact top-k search by inner product with a KD-tree per shard.

Each component x becomes floor(scale * x), and scores are integers. Rows are dealt into shards by median
splits of a bounded sample (at most `sample_rows`), so that a shard is a region of space; a region
that holds far more rows than meant (equal vectors, say) is dealt by row into several shards of the same region.
Every row is in a shard, and each shard has a tight box.

A task builds a shard's tree once: median splits of the widest dimension, by count, so that equal
vectors split too, with a tight box for every node. The largest inner product of a query with a box bounds
the scores inside. Queries stream past the tree; each takes the open node of the highest bound first, opens it into
its halves or scans it as a leaf, and leaves off once no open bound can beat its kth entry.
A query is sent to the shard of its highest bound first; the kth score found there goes along to the
next few shards, theirs to the rest, and shards whose bound is under the kth score don't see the query.

Ties go to the smaller id. Vectors that are null or empty, or hold null or non-finite components, take no part; so do rows
with a null id. Only vectors of equal length are compared, one length after another. Rows that share an id are rows of their own: each is a
candidate for the others, and each query among them gives its own list. Fewer than k candidates give as many rows, an
empty table none. Extra columns are left out, whatever their names. Components too large for exact doubles are
scored with Python integers; a score that doesn't fit a long fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .runtime import cut, pick

LOW = -(1 << 62)
FOUND = "query_row long, query_id long, vec_id long, score long"


class Tree:
    """Binary KD-tree over points, whose ids ascend. Node i spans order[first:last] and has the children left[i] and left[i] + 1, or none."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(points))
        spans, left = [(0, len(points))], [-1]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            if b - a > leaf:
                x = points[self.order[a:b]]
                dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(x[:, dim], mid)]
                left[at] = len(spans)
                spans += [(a, a + mid), (a + mid, b)]
                left += [-1, -1]
            at += 1
        self.spans, self.left = spans, np.array(left)
        self.points = points[self.order].astype(np.float64)
        dims = points.shape[1]
        self.low, self.high = np.empty((len(spans), dims)), np.empty((len(spans), dims))
        self.least = np.empty(len(spans), np.int64)  # the smallest place in a node, which wins ties
        for i in range(len(spans) - 1, -1, -1):
            a, b = spans[i]
            if left[i] < 0:
                self.low[i], self.high[i], self.least[i] = self.points[a:b].min(axis=0), self.points[a:b].max(axis=0), self.order[a:b].min()
            else:
                c = left[i]
                self.low[i], self.high[i] = np.minimum(self.low[c], self.low[c + 1]), np.maximum(self.high[c], self.high[c + 1])
                self.least[i] = min(self.least[c], self.least[c + 1])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best for each query at or over floor; place -1 where there are fewer. own: the query's own place, or -1."""
        bits = max(1, int(len(self.order)).bit_length())
        step, top = 1 << bits, (1 << bits) - 1  # a key is the score, then the smaller place
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)

        def bounds(who: np.ndarray, node: int) -> np.ndarray:
            return (up[who] @ self.high[node] + down[who] @ self.low[node]).astype(np.int64) * step + (top - self.least[node])

        start = np.where(floor > LOW, floor * step - 1, LOW)
        best = np.repeat(start[:, None], k, axis=1)
        kth = start.copy()
        open_ = np.full((len(q), len(self.spans)), LOW)
        live = np.arange(len(q))
        open_[:, 0] = bounds(live, 0)
        while True:
            node = open_[live].argmax(axis=1)
            go = open_[live, node] > kth[live]
            live, node = live[go], node[go]
            if not len(live):
                break
            open_[live, node] = LOW
            by = np.argsort(node, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], node[by][1:] != node[by][:-1]]))
            for a, b in zip(at, [*at[1:], len(by)], strict=True):
                who, n = live[by[a:b]], node[by[a]]
                c = self.left[n]
                if c >= 0:
                    open_[who, c], open_[who, c + 1] = bounds(who, c), bounds(who, c + 1)
                    continue
                s, e = self.spans[n]
                place = self.order[s:e]
                key = (q[who] @ self.points[s:e].T).astype(np.int64) * step + (top - place)
                key[own[who][:, None] == place[None, :]] = LOW
                both = np.concatenate([best[who], key], axis=1)
                best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                kth[who] = best[who].min(axis=1)
        real = best > np.maximum(start, LOW)[:, None]
        return np.where(real, best >> bits, 0), np.where(real, top - (best & top), -1)


def _matrix(column) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _plain(ids, rows, points, q, q_row, queries, k: int) -> list[tuple]:
    """For components so large that keys would overflow: Python integers, one query at a time."""
    p, out = points.astype(object), []
    for i, r, x in zip(q, q_row, queries.astype(object), strict=True):
        s = sorted((-int(v), int(j)) for v, j, own in zip(p @ x, ids, rows, strict=True) if own != r)[:k]
        out += [(int(r), int(i), j, -v) for v, j in s]
    return out


class Shard:
    """The rows of one shard, with its tree."""

    def __init__(self, t: pa.Table, leaf: int):
        ids, rows = t.column("id").to_numpy(), t.column("row").to_numpy()
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.points = _matrix(t.column("v"))[order]
        self.most = int(np.abs(self.points).max(initial=0))
        self.by_row = np.argsort(self.rows)
        self.tree, self.leaf = None, leaf

    def search(self, t: pa.Table, k: int) -> pa.RecordBatch:
        q, q_row, queries = t.column("id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("v"))
        most, n = max(self.most, int(np.abs(queries).max(initial=0))), len(self.ids)
        names = ["query_row", "query_id", "vec_id", "score"]
        if most * most * self.points.shape[1] * (n + 1) * 2 >= 1 << 62 or most * most * self.points.shape[1] >= 1 << 53:
            found = _plain(self.ids, self.rows, self.points, q, q_row, queries, k)
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(4)], names)
        self.tree = self.tree or Tree(self.points, self.leaf)
        at = self.by_row[np.minimum(np.searchsorted(self.rows[self.by_row], q_row), n - 1)]
        own = np.where(self.rows[at] == q_row, at, -1)
        score, place = self.tree.search(queries, own, k, t.column("floor").fill_null(LOW).to_numpy())
        real = place >= 0
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(x, k).reshape(real.shape)[real]) for x in (q_row, q)] + [pa.array(self.ids[place[real]]), pa.array(score[real])], names)


def _search(batches, k: int, leaf: int, block: int = 1024):
    """Rows sorted by shard, each shard's points before its queries: builds the tree once and streams the queries past it."""
    now, points, shard = None, [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        key = np.stack([t.column("shard").to_numpy(), t.column("ask").to_numpy().astype(np.int64)])
        edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]]) if t.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if key[0, a] != now:
                now, points, shard = key[0, a], [], None
            if not key[1, a]:
                points.append(t.slice(a, b - a))
                continue
            if shard is None and points:
                shard, points = Shard(pa.concat_tables(points), leaf), []
            for c in range(a, b if shard else a, block):
                yield shard.search(t.slice(c, min(block, b - c)), k)


def _splits(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and thresholds of a complete binary tree of median splits, in the order of a heap; `leaves` is a power of two."""
    dims, cuts = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
    parts = {0: points}
    for i in range(leaves - 1):
        x = parts.pop(i)
        if len(x):
            dims[i] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            cuts[i] = np.median(x[:, dims[i]])
        low = x[:, dims[i]] < cuts[i]
        parts[2 * i + 1], parts[2 * i + 2] = x[low], x[~low]
    return dims, cuts


def _region(v: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(v), np.int64)
    while len(dims) and node[0] < len(dims):
        node = 2 * node + 1 + (v[np.arange(len(v)), dims[node]] >= cuts[node])
    return node - len(dims)


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0, shard_rows: int = 8192, most_regions: int = 4096, sample_rows: int = 100_000, leaf: int = 64
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by `every`.

    A shard has about shard_rows rows, more where that would make over most_regions regions; the regions' boxes are broadcast.
    """
    x = F.col(f"`{vector_col}`")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = pick(vectors, id_col, vector_col).where(fine & F.col(f"`{id_col}`").isNotNull())
    rows = cut(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    sizes = [(r["dim"], r["n"]) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()]
    found = [_of_one_length(rows.where(F.size("v") == dim), n, every, k, shard_rows, most_regions, sample_rows, leaf) for dim, n in sizes]
    spark = rows.sparkSession
    every_one = found[0] if found else spark.createDataFrame([], FOUND)
    for f in found[1:]:
        every_one = every_one.unionByName(f)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(rows: DataFrame, n: int, every: int, k: int, shard_rows: int, most_regions: int, sample_rows: int, leaf: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    regions = 1
    while regions < most_regions and n > regions * shard_rows:
        regions *= 2
    most = max(shard_rows, n // regions * 2)
    asked = F.pmod("id", F.lit(every)) == 0
    if regions > 1:
        picked = rows.where(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(1 << 20)) < max(1, min(1 << 20, (1 << 20) * sample_rows // n)))
        sample = _matrix(picked.select("v").limit(2 * sample_rows).toArrow().column("v"))
        shared = sc.broadcast(_splits(sample, regions))

        def place(batches):
            for b in batches:
                if b.num_rows:
                    yield b.append_column("region", pa.array(_region(_matrix(b.column("v")), *shared.value), pa.int64()))

        data = cut(rows.mapInArrow(place, "id long, v array<long>, row long, region long"))
        full = {r["region"]: -(-r["n"] // most) for r in data.groupBy("region").agg(F.count("*").alias("n")).collect()}  # at most most_regions rows
        first = dict(zip(full, np.cumsum([0, *list(full.values())[:-1]]).tolist(), strict=True))
        table = rows.sparkSession.createDataFrame([(r, int(first[r]), int(full[r])) for r in full], "region long, first long, n long")
        data = data.join(F.broadcast(table), "region").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), "n"))
        data = cut(data.select("id", "v", "row", "shard"))
    else:
        data = rows.withColumn("shard", F.lit(0).cast("long"))

    def boxes(batches):
        for b in batches:
            v, s = _matrix(b.column("v")), b.column("shard").to_numpy()
            for x in np.unique(s):
                mine = v[s == x]
                yield pa.RecordBatch.from_pydict({"shard": [int(x)], "low": [mine.min(axis=0).tolist()], "high": [mine.max(axis=0).tolist()]})

    parts = data.mapInArrow(boxes, "shard long, low array<long>, high array<long>")
    dims = range(rows.select(F.size("v")).first()[0])
    box = parts.groupBy("shard").agg(F.array(*[F.min(F.col("low")[d]) for d in dims]).alias("low"), F.array(*[F.max(F.col("high")[d]) for d in dims]).alias("high")).orderBy("shard").toArrow()
    known = sc.broadcast((box["shard"].to_numpy(), _matrix(box["low"]).astype(float), _matrix(box["high"]).astype(float)))

    def routes(start: int, end: int):
        """Each query's shards of rank start to end by their bounds, as far as these reach the floor."""

        def run(batches):
            shard, low, high = known.value
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("v")).astype(float)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                floor = b.column("floor").fill_null(LOW).to_numpy()
                # doubles lose digits beyond 2^53, so bounds of that size count as reached
                go = (np.take_along_axis(bound, order, axis=1) >= floor[:, None]) | (np.abs(np.take_along_axis(bound, order, axis=1)) >= 2.0**52)
                who, nth = np.nonzero(go)
                yield b.take(pa.array(who)).append_column("shard", pa.array(shard[order[who, nth]], pa.int64()))

        return run

    asks = data.where(asked).select("id", "v", "row")
    floor, found, start = asks.withColumn("floor", F.lit(None).cast("long")), None, 0
    for end in (1, 4, len(box)):
        if end <= start or start >= len(box):
            continue
        sent = floor.select("id", "v", "row", "floor").mapInArrow(routes(start, end), "id long, v array<long>, row long, floor long, shard long").withColumn("ask", F.lit(True))
        mixed = data.withColumn("floor", F.lit(None).cast("long")).withColumn("ask", F.lit(False)).unionByName(sent)
        got = mixed.repartition("shard").sortWithinPartitions("shard", "ask").mapInArrow(lambda it: _search(it, k, leaf), FOUND)
        found = cut(got if found is None else found.unionByName(got))
        best = Window.partitionBy("query_row").orderBy(F.desc("score"))
        kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
        floor, start = asks.join(kth, "row", "left"), end
    return found
