"""Randomized leverages and corrections: random signs, batched solves, finite-projection terms.

Signs are bits of a mixed 64-bit counter keyed by (seed, domain, probe, unit, word), so a draw depends on
neither partitions nor order nor batches. Worker effects live only inside the tasks; per unit five moments leave them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec
from . import collapse, cut, exact, firmwise, joint_random

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a splitmix generator."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signs(key: np.ndarray, n: np.ndarray, probes: np.ndarray, seed: int, domain: int) -> np.ndarray:
    """rows x probes: the sum of n random signs for each key."""
    with np.errstate(over="ignore"):
        stream = mix(U(seed) * U(0x9E3779B97F4A7C15) + U(domain)) + probes.astype(U) * U(0xD1342543DE82EF95)
        base = mix(mix(key.astype(np.int64).view(U))[:, None] ^ mix(stream)[None, :])
        out = np.zeros(base.shape)
        left = n.astype(np.int64).copy()
        word = 0
        while (left > 0).any():
            at = np.flatnonzero(left > 0)
            take = np.minimum(left[at], 64)
            mask = np.where(take == 64, U(0xFFFFFFFFFFFFFFFF), (U(1) << (take % 64).astype(U)) - U(1))
            bits = mix(base[at] + U(word) * U(0x9E3779B97F4A7C15)) & mask[:, None]
            out[at] += 2.0 * np.bitwise_count(bits) - take[:, None]
            left[at] -= take
            word += 1
    return out


def leverage_units(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """key, w, f, n, uy, uo: a mover's unit under match deletion; every physical copy otherwise. yo is the outcome to be fitted, y the outer one."""
    whole = F.col("mover") & F.lit(spec.deletion == "match")
    block = rows.where(whole).groupBy("unit", "w", "f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("uy"))
    block = block.select(F.xxhash64(F.lit("unit"), "unit").alias("key"), "w", "f", "n", "uy", F.lit(True).alias("whole"))
    # equal stored rows of a cell are told apart by a number, so that each copy has signs of its own
    z = [c for c in rows.columns if c[0] == "z" and c[1:].isdigit()]
    same = rows.where(~whole).groupBy("unit", "w", "f", "y", "t", "n", *z).agg(F.count("*").alias("k"))
    copy = same.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("k") * F.col("n")).cast("long"))))
    copy = copy.select(F.xxhash64(F.lit("copy"), "unit", "w", "f", "y", "t", "n", *z, "copy").alias("key"), "w", "f", F.lit(1.0).alias("n"), F.col("y").alias("uy"), F.lit(False).alias("whole"))
    return block.unionAll(copy)


def effects(cells: DataFrame, solver: firmwise.Solver) -> DataFrame:
    """cells (w, j, n, sy, s) with alpha and psi."""

    def rhs(batches):
        for b in firmwise.whole_workers(batches, 1):
            y = b.col["sy"][:, None]
            yield b.j, y - b.p[:, None] * b.total(y)

    shared = cells.sparkSession.sparkContext.broadcast(solver(firmwise.collect(cells, rhs, solver.k, 1)))
    names = ["w", "j", "n", "sy", "s", "alpha", "psi"]

    def run(batches):
        for b in firmwise.whole_workers(batches, 1):
            psi = shared.value[b.j, 0]
            alpha = b.total(b.col["sy"]) / b.nw - b.total(b.p * psi)
            yield pa.RecordBatch.from_arrays([pa.array(b.col[c]) for c in names[:5]] + [pa.array(alpha), pa.array(psi)], names)

    return cut(cells.mapInArrow(run, "w long, j int, n double, sy double, s double, alpha double, psi double"))


def moments(units: DataFrame, solver: firmwise.Solver, spec: PanelSpec) -> DataFrame:
    """units with p2, m2, p4, m4, pm: sums over the probes. units: dealt and sorted by worker."""
    group = max(1, min(spec.probes, spec.firm_cells // max(solver.k, 1)))
    parts = []
    for start in range(0, spec.probes, group):
        probes = np.arange(start, min(start + group, spec.probes))

        def rhs(batches, probes=probes):
            for b in firmwise.whole_workers(batches, len(probes)):
                s = signs(b.col["key"], b.n, probes, spec.seed, 1)
                yield b.j, s - b.p[:, None] * b.total(s)

        psi = units.sparkSession.sparkContext.broadcast(solver(firmwise.collect(units, rhs, solver.k, len(probes))))

        def run(batches, probes=probes, psi=psi):
            for b in firmwise.whole_workers(batches, len(probes)):
                s = signs(b.col["key"], b.n, probes, spec.seed, 1)
                root = np.sqrt(b.n)[:, None]
                p = root * (b.total(s) / b.nw[:, None] + b.away(psi.value))
                m = s / root - p
                p, m = p * p, m * m
                values = (p.sum(1), m.sum(1), (p * p).sum(1), (m * m).sum(1), (p * m).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(b.col[c]) for c in ("key", "w", "j", "n", "uy", "whole")] + [pa.array(v) for v in values], ["key", "w", "j", "n", "uy", "whole", "p2", "m2", "p4", "m4", "pm"])

        parts.append(cut(units.mapInArrow(run, "key long, w long, j int, n double, uy double, whole boolean, p2 double, m2 double, p4 double, m4 double, pm double")))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.groupBy("key", "w", "j", "n", "uy", "whole").agg(*[F.sum(c).alias(c) for c in ("p2", "m2", "p4", "m4", "pm")])


def weights(moments: DataFrame, probes: int) -> DataFrame:
    """With ell, the estimated share left by the projection, and inverse = 1/ell + B/ell^2 - V/ell^3."""
    r = float(probes)
    m = moments.withColumn("pbar", F.col("p2") / (F.col("p2") + F.col("m2"))).withColumn("ell", F.col("m2") / (F.col("p2") + F.col("m2")))
    mb, pb = F.col("ell"), F.col("pbar")
    b = (mb * F.col("p4") - pb * F.col("m4") + (mb - pb) * F.col("pm")) / (r * r)
    v = F.greatest(F.lit(0.0), (mb * mb * F.col("p4") + pb * pb * F.col("m4") - 2 * pb * mb * F.col("pm")) / (r * r))
    m = m.withColumn("b", b).withColumn("v", v)
    return m.withColumn("inverse", 1 / mb + F.col("b") / (mb * mb) - F.col("v") / (mb * mb * mb))


def draws(strata: DataFrame, solver: firmwise.Solver, spec: PanelSpec, joint: tuple | None = None) -> np.ndarray:
    """3 x probes: worker, firm and covariance draws of the correction. strata: w, j, key, n, t, mass, weight; dealt and sorted by worker.

    joint: (inverse Gram of the controls, their firm parts, Czz) with joint controls, whose worker parts a0.. and weights cz0.. strata has then too.
    """
    k, total = solver.k, float(strata.agg(F.sum("t")).first()[0])
    group = max(1, min(spec.probes, spec.firm_cells // max(2 * k, 1)))
    sc, out = strata.sparkSession.sparkContext, []
    kc = len(joint[0]) if joint else 0
    many = lambda b, c: np.column_stack([b.col[f"{c}{i}"] for i in range(kc)])
    for start in range(0, spec.probes, group):
        probes = np.arange(start, min(start + group, spec.probes))
        c = len(probes)

        def raw(b, probes=probes):
            return np.sqrt(b.col["mass"] / total)[:, None] * signs(b.col["key"], b.n, probes, spec.seed, 2)

        def rhs(batches, raw=raw, c=c):
            for b in firmwise.whole_workers(batches, 2 * c + 2):
                a, s = raw(b), (b.col["t"] / total)[:, None]
                yield b.j, np.column_stack([b.p[:, None] * b.total(a), a, b.p[:, None] * b.total(s), s])
                if kc:
                    z = many(b, "a").T
                    yield k + np.arange(kc), np.column_stack([z @ a, np.zeros((kc, c)), z @ s, np.zeros((kc, 1))])

        got = firmwise.collect(strata, rhs, k + kc, 2 * c + 2)
        loads, got = got[k:], got[:k]
        every = got[:, c : 2 * c].sum(0)
        right = np.column_stack([got[:, -2:-1] * every - got[:, :c], got[:, c : 2 * c] - got[:, -1:] * every])
        q = np.zeros((0, 2 * c))
        if kc:
            q = joint[0] @ np.column_stack([loads[:, :c] - loads[:, -2:-1] * every, joint[1].T @ right[:, c:]])
        psi = sc.broadcast((solver(right), every, q))

        def run(batches, raw=raw, psi=psi, c=c):
            for b in firmwise.whole_workers(batches, 3 * c):
                x, every, q = psi.value
                a = b.total(raw(b) - (b.col["t"] / total)[:, None] * every)
                g = b.away(x)
                sw, sf = a / b.nw[:, None] + g[:, :c], g[:, c:]
                s = np.column_stack([sw, sf, sw + sf])
                u = b.col["weight"] @ (s * s)
                if kc:
                    u -= (s * (many(b, "cz") @ np.column_stack([q, q[:, :c] + q[:, c:]]))).sum(0)
                yield np.zeros(1, np.int64), u[None, :]

        x = firmwise.collect(strata, run, 1, 3 * c)[0]
        if kc:
            q3 = np.column_stack([q, q[:, :c] + q[:, c:]])
            x = x + np.einsum("ic,ij,jc->c", q3, joint[2], q3)
        x = x.reshape(3, c)
        out.append(np.stack([x[0], x[1], (x[2] - x[0] - x[1]) / 2]))
    return np.concatenate(out, axis=1)


def deal(df: DataFrame, *order: str) -> DataFrame:
    """Cut, with whole workers in sorted runs."""
    return cut(df.repartition("w").sortWithinPartitions("w", *order)).sortWithinPartitions("w", *order)


def fit(rows: DataFrame, spec: PanelSpec, names: list[str] | None = None, gram: np.ndarray | None = None):
    """(firm table, kernels with alpha and psi, draws of the correction, table by source, solver). names: controls that are estimated jointly; gram: theirs."""
    cells = cut(collapse.cells(rows.withColumn("y", F.col("yo"))))
    count, firms = exact.index_firms(cells, spec.firm_cells)
    mine = deal(exact.by_worker(cells, firms), "j")
    solver = firmwise.Solver(mine, count, spec)
    k = effects(mine, solver)
    mean = rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0] if spec.centering == "mean" else 0.0
    units = leverage_units(rows.withColumn("y", F.col("yo")), spec).join(firms, "f").withColumn("w", F.xxhash64("w")).select("key", "w", "j", "n", "uy", "whole")
    found = cut(weights(moments(deal(units, "j", "key"), solver, spec), spec.probes))
    x = found.join(k.select("w", "j", "alpha", "psi"), ["w", "j"])
    fitted = F.col("n") * (F.col("alpha") + F.col("psi"))
    x = x.withColumn("weight", (F.col("uy") - F.col("n") * float(mean)) * (F.col("uy") - fitted) * F.col("inverse"))
    by = found.groupBy(F.when(F.col("whole"), "block").otherwise("copy").alias("source")).agg(F.max("pbar").alias("max_leverage"), F.count("*").alias("units"), F.min("ell").alias("least_left"))
    cell, joint, extra = x.groupBy("w", "j").agg(F.sum("weight").alias("cell_weight")), None, []
    if names:
        parts, firm_parts = joint_random.predictions(rows, firms, names, solver)
        cell, zz = joint_random.weights(found, joint_random.unit_sums(rows, names, spec, mean), k, parts, gram, names)
        cell = cell.join(parts.select("w", "j", *[f"a{i}" for i in range(len(names))]), ["w", "j"])
        joint, extra = (np.linalg.inv(gram), firm_parts, zz), [f"cz{i}" for i in range(len(names))]
    cell = cell.join(found.groupBy("w", "j").agg(F.sum("n").alias("cell_n")), ["w", "j"])
    strata = collapse.strata(rows).join(firms, "f").select(F.xxhash64("w", "f", "copy_mass").alias("key"), F.xxhash64("w").alias("w"), "j", "n", "t", F.col("copy_mass").alias("mass"))
    share = F.col("n") / F.col("cell_n")
    strata = strata.join(cell, ["w", "j"]).withColumn("weight", F.col("cell_weight") * share).withColumns({c: F.col(c) * share for c in extra}).drop("cell_weight", "cell_n")
    return firms, k, draws(deal(strata, "j", "key"), solver, spec, joint), cut(by), solver
