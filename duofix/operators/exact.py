"""The exact estimator: worker effects are eliminated, and only firm-by-firm matrices are dense.

Let r = e_k - p_w for a copy in cell (w, k), p_w being the worker's firm shares, and S the firm
Laplacian with the last firm grounded. Leverages and the kernels of the four targets are quadratic
forms r' K r with fixed firm-by-firm matrices K, built on the driver from aggregates and broadcast
(their size is checked against exact_limit). Per cell they cost a pass over the worker's cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..spec import PanelSpec, Withheld
from . import cut, small_table

TARGETS = ("worker_variance", "firm_variance", "worker_firm_covariance", "total_variance")


def index_firms(cells: DataFrame, limit: int, local: int = 100_000) -> tuple[int, DataFrame]:
    """(number of firms, table f -> j from 0 in the order of f); the last firm is the grounded one.

    Up to `local` firms are numbered by one task and broadcast; beyond, ranges of firms are numbered
    by their tasks, the driver adds up the ranges' sizes, and joins choose their own way.
    """
    firms = cells.select("f").distinct()
    k = firms.count()
    if k > limit:
        raise Withheld("EXACT_LIMIT", f"{k} firms, at most {limit}")
    if k <= local:
        return k, F.broadcast(cut(firms.select((F.row_number().over(Window.orderBy("f")) - 1).alias("j"), "f")))
    ranges = cut(firms.repartitionByRange(k // local + 1, "f").select("f", F.spark_partition_id().alias("part")))  # cut, as a range drawn again could differ
    sizes = sorted((r["part"], r["count"]) for r in ranges.groupBy("part").count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)])
    offsets = small_table(cells.sparkSession, [(part, int(n)) for (part, _), n in zip(sizes, before, strict=False)], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("f")) - 1
    return k, cut(ranges.withColumn("place", place).join(F.broadcast(offsets), "part").select((F.col("place") + F.col("before")).cast("int").alias("j"), "f"))


def by_worker(cells: DataFrame, firms: DataFrame) -> DataFrame:
    """Cells with firm numbers, dealt and sorted by worker: w (hash), j, n, sy, s (target share); and worker totals."""
    mass = cells.agg(F.sum("t")).first()[0]
    c = cells.join(firms, "f").select(F.xxhash64("w").alias("w"), "j", "n", "sy", (F.col("t") / mass).alias("s"))
    return c.repartition("w").sortWithinPartitions("w", "j")


class Block:
    """Whole workers of one partition as arrays; a and b are the pairs of cells of one worker."""

    def __init__(self, t: pa.Table):
        self.w, self.j, self.n, self.sy, self.s = (t.column(c).to_numpy() for c in ("w", "j", "n", "sy", "s"))
        new = np.ones(len(self.w), bool)
        new[1:] = self.w[1:] != self.w[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.first, [len(self.w)]]))
        self.who = np.repeat(np.arange(len(self.first)), self.size)
        total = lambda x: np.add.reduceat(x, self.first)
        self.nw, self.sw, self.syw = total(self.n)[self.who], total(self.s)[self.who], total(self.sy)[self.who]
        self.p = self.n / self.nw
        deg = self.size[self.who]
        self.a = np.repeat(np.arange(len(self.w)), deg)
        self.b = np.arange(deg.sum()) - np.repeat(np.cumsum(deg) - deg, deg) + np.repeat(self.first[self.who], deg)
        self.starts = np.cumsum(deg) - deg

    def over_b(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def worker_sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first)[self.who]


def tables(batches, most: int):
    """Tables of whole workers from a stream sorted by worker: at most `most` rows in one, or a worker with more."""

    def parts(t: pa.Table, last: bool):
        """Ends of the parts of t, up to its last worker or with it."""
        w = t.column("w").to_numpy()
        ends = np.flatnonzero(w[1:] != w[:-1]) + 1
        ends, at = np.append(ends, len(w)) if last else ends, 0
        while len(ends) and at < ends[-1]:
            k = max(np.searchsorted(ends, at + most, side="right") - 1, np.searchsorted(ends, at, side="right"))
            yield at, (at := int(ends[k]))

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= most and held[0]["w"][0] != held[-1]["w"][-1]:
            t, end = pa.concat_tables(held).combine_chunks(), 0
            held.clear()
            for at, end in parts(t, False):
                yield t.slice(at, end - at)
            held.append(t.slice(end))
            del t
    if held:
        t = pa.concat_tables(held).combine_chunks()
        for at, end in parts(t, True):
            yield t.slice(at, end - at)


def blocks(batches, most: int = 50_000, pairs: int = 2_000_000):
    """Blocks of whole workers; at most `pairs` pairs of cells in one, and those of one worker more."""
    for t in tables(batches, most):
        w = t.column("w").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        part = np.cumsum(np.diff(np.append(first, len(w))) ** 2) // pairs
        starts = first[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))]
        for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
            yield Block(t.slice(int(a), int(b - a)))


def laplacian_parts(cells: DataFrame) -> DataFrame:
    """(i, j): sums over workers of n_i n_j / N, s_w p_i p_j and p_i s_j; summed within tasks first."""

    def run(batches):
        for b in blocks(batches):
            i, j = b.j[b.a].astype(np.int64), b.j[b.b].astype(np.int64)
            key, at = np.unique(i << 32 | j, return_inverse=True)
            add = lambda x: np.bincount(at, x, len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), *(pa.array(add(x)) for x in (b.n[b.a] * b.p[b.b], b.sw[b.a] * b.p[b.a] * b.p[b.b], b.p[b.a] * b.s[b.b]))], ["i", "j", "nn", "g", "h"]
            )

    out = cells.mapInArrow(run, "i int, j int, nn double, g double, h double")
    return out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("nn", "g", "h")])


@dataclass
class Fit:
    """Driver-side firm objects: inverse Laplacian, kernels, firm effects; K have a zero last row and column."""

    inverse: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    k3: np.ndarray
    v1: np.ndarray
    v2: np.ndarray
    psi: np.ndarray
    mean: float
    total: float


def solve(cells: DataFrame, k: int, rank_tolerance: float = 1e-12) -> Fit:
    """cells: of by_worker. Collects at most k * k aggregated rows."""
    t = laplacian_parts(cells).toArrow()
    nn, g, h = (np.zeros((k, k)) for _ in range(3))
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    nn[i, j], g[i, j], h[i, j] = t["nn"].to_numpy(), t["g"].to_numpy(), t["h"].to_numpy()

    def sums(batches):
        for b in blocks(batches):
            add = lambda x: np.bincount(b.j, x, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *(pa.array(add(x)) for x in (b.n, b.sy, b.s, b.sw * b.p, b.n * b.syw / b.nw))], ["j", "n", "sy", "s", "m", "ny"])

    f = cells.mapInArrow(sums, "j int, n double, sy double, s double, m double, ny double").groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "s", "m", "ny")]).orderBy("j").toArrow()
    n, sy, s, m, ny = (f[c].to_numpy() for c in ("n", "sy", "s", "m", "ny"))
    lap = (np.diag(n) - nn)[: k - 1, : k - 1]
    lap = (lap + lap.T) / 2
    scale = 1 / np.sqrt(np.maximum(np.diag(lap), 1e-300))
    if k > 1:
        value, vector = np.linalg.eigh(lap * scale[:, None] * scale[None, :])
        if value[0] <= rank_tolerance * value[-1]:
            raise Withheld("NO_LEAVEOUT_COMPONENT", "the firm Laplacian is singular")
        inv = scale[:, None] * ((vector / value) @ vector.T) * scale[None, :]
    else:
        inv = np.zeros((0, 0))
    pad = lambda x: np.pad(x, (0, 1))
    gg, hh = g[: k - 1, : k - 1], h[: k - 1, : k - 1]
    q2 = np.diag(s[: k - 1]) - np.outer(s[: k - 1], s[: k - 1])
    k3 = inv @ hh @ inv
    return Fit(pad(inv), pad(inv @ gg @ inv), pad(inv @ q2 @ inv), pad((k3 + k3.T) / 2), pad(inv @ m[: k - 1]), pad(inv @ s[: k - 1]), pad(inv @ (sy - ny)[: k - 1]), float(sy.sum() / n.sum()), float(n.sum()))


KERNEL_SCHEMA = "w long, j int, n double, sy double, s double, leverage double, q_worker double, q_firm double, q_cov double, alpha double, psi double"


def kernels(cells: DataFrame, fit: Fit) -> DataFrame:
    """Per cell: leverage of one copy, the three kernels of one copy, and both effects."""
    shared = cells.sparkSession.sparkContext.broadcast(fit)

    def run(batches):
        fit = shared.value
        for b in blocks(batches):
            ja, jb = b.j[b.a], b.j[b.b]
            p = b.p[b.b]

            def form(k):
                """r' K r, with K p for later."""
                kp = b.over_b(k[ja, jb] * p)
                return k[b.j, b.j] - 2 * kp + b.worker_sum(b.p * kp), kp

            ru, lp = form(fit.inverse)
            lpp = b.worker_sum(b.p * lp)
            pu = lp - lpp  # p'u
            ls = b.over_b(fit.inverse[ja, jb] * b.s[b.b])
            su = ls - b.worker_sum(b.s * lp)  # s_w'u
            ugu, uhu = form(fit.k1)[0], form(fit.k3)[0]
            mu = fit.v1[b.j] - b.worker_sum(b.p * fit.v1[b.j])
            fu = fit.v2[b.j] - b.worker_sum(b.p * fit.v2[b.j])
            share = b.sw / b.nw
            qa = b.sw / b.nw**2 - 2 * b.sw * pu / b.nw + ugu - (share - mu) ** 2
            qc = su / b.nw - uhu - (share - mu) * fu
            psi = fit.psi[b.j]
            alpha = b.syw / b.nw - b.worker_sum(b.p * psi)
            cols = (b.w, b.j.astype(np.int32), b.n, b.sy, b.s, 1 / b.nw + ru, qa, form(fit.k2)[0], qc, alpha, psi)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in KERNEL_SCHEMA.split(", ")])

    return cells.mapInArrow(run, KERNEL_SCHEMA)


def plugin(k: DataFrame) -> DataFrame:
    """Target-weighted variances and covariance of the fitted effects."""
    s, a, p = F.col("s"), F.col("alpha"), F.col("psi")
    v = k.agg((F.sum(s * a * a) - F.sum(s * a) ** 2).alias(TARGETS[0]), (F.sum(s * p * p) - F.sum(s * p) ** 2).alias(TARGETS[1]), (F.sum(s * a * p) - F.sum(s * a) * F.sum(s * p)).alias(TARGETS[2]))
    return v.withColumn(TARGETS[3], F.expr("worker_variance + firm_variance + 2 * worker_firm_covariance"))


def correction(units: DataFrame, k: DataFrame, firms: DataFrame, spec: PanelSpec, mean: float, tolerance: float = 1e-10) -> DataFrame:
    """Bias of the plug-in, its largest leverage, by source (mover blocks, single copies).

    units: w, f, n, sy, syy, mover. A mover's unit is left out as a whole under match deletion, else each copy alone.
    """
    shift = mean if spec.centering == "mean" else 0.0
    u = units.join(firms, "f").select(F.xxhash64("w").alias("w"), "j", F.col("n").alias("m"), F.col("sy").alias("uy"), F.col("syy").alias("uyy"), "mover")
    x = u.join(k.select("w", "j", "leverage", "q_worker", "q_firm", "q_cov", "alpha", "psi"), ["w", "j"])
    whole = F.col("mover") & F.lit(spec.deletion == "match")
    fitted = F.col("alpha") + F.col("psi")
    h = F.when(whole, F.col("m") * F.col("leverage")).otherwise(F.col("leverage"))
    block = (F.col("uy") - F.col("m") * shift) * (F.col("uy") - F.col("m") * fitted)
    copies = F.col("uyy") - F.col("uy") * fitted - shift * (F.col("uy") - F.col("m") * fitted)
    x = x.withColumn("h", h).withColumn("w_", F.when(whole, block).otherwise(copies) / (1 - h)).withColumn("source", F.when(whole, "block").otherwise("copy"))
    out = x.groupBy("source").agg(F.max("h").alias("max_leverage"), F.count("*").alias("units"), *[F.sum(F.col("w_") * F.col(q)).alias(t) for q, t in zip(("q_worker", "q_firm", "q_cov"), TARGETS, strict=False)])
    return out.withColumn(TARGETS[3], F.expr("worker_variance + firm_variance + 2 * worker_firm_covariance"))


def fit(rows: DataFrame, spec: PanelSpec):
    """(cells, number of firms, firm table, Fit, kernels) of a selected sample."""
    from .collapse import cells as collapse

    c = cut(collapse(rows))
    count, firms = index_firms(c, spec.exact_limit)
    mine = cut(by_worker(c, firms))
    mine = mine.sortWithinPartitions("w", "j")
    f = solve(mine, count)
    return c, count, firms, f, cut(kernels(mine, f))
