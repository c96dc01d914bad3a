"""Random probes with controls that are estimated jointly with both effects.

Partialling out splits a unit's block of the projection into the part of both effects, which the leverage probes estimate,
and Z~ G^-1 Z~', which is exact (notation of joint.py). All that a unit needs of its rows are sums with [1, z~]:
with R those rows times the roots of their masses, C = R'R and S = diag(share of the effects / mass, G^-1), the sums of the left-out
residuals are (I - CS)^-1 R'e, corrected for the finite number of probes along the direction of the effects.
A target probe's prediction in a row is s - z~'q, s being that of both effects and q one vector for all rows, so a cell's part of
a draw is c00 s^2 - s cz'q, and q'Czz q is added once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import cut, firmwise


def predictions(rows: DataFrame, firms: DataFrame, names: list[str], solver: firmwise.Solver) -> tuple[DataFrame, np.ndarray]:
    """(per cell w, j: both effects' prediction p0.. of the controls and its worker part a0.., firm parts as firms x controls)."""
    c = rows.groupBy("w", "f").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(z)).alias(z) for z in names])
    c = c.join(firms, "f").select(F.xxhash64("w").alias("w"), "j", "n", *names)
    c = cut(c.repartition("w").sortWithinPartitions("w", "j")).sortWithinPartitions("w", "j")
    stack = lambda b: np.column_stack([b.col[x] for x in names])

    def rhs(batches):
        for b in firmwise.whole_workers(batches, len(names)):
            z = stack(b)
            yield b.j, z - b.p[:, None] * b.total(z)

    psi = solver(firmwise.collect(c, rhs, solver.k, len(names)))
    shared = rows.sparkSession.sparkContext.broadcast(psi)
    out = [*[f"p{i}" for i in range(len(names))], *[f"a{i}" for i in range(len(names))]]

    def run(batches):
        for b in firmwise.whole_workers(batches, len(names)):
            firm = shared.value[b.j]
            a = b.total(stack(b)) / b.nw[:, None] - b.total(b.p[:, None] * firm)
            cols = [b.col["w"], b.j.astype(np.int32), *(a + firm).T, *a.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["w", "j", *out])

    return cut(c.mapInArrow(run, "w long, j int, " + ", ".join(f"{x} double" for x in out))), psi


def unit_sums(rows: DataFrame, names: list[str], spec: PanelSpec, mean: float) -> DataFrame:
    """key and sums of a deletion unit (a mover's unit, else one copy): m, uy, uo, z0.., zy0.., zo0.., zz0_0..; keys are those of jla.leverage_units."""
    whole = F.col("mover") & F.lit(spec.deletion == "match")
    y, yo, kc = F.col("y") - F.lit(float(mean)), F.col("yo"), len(names)

    def stats(n):
        out = {"m": n, "uy": n * y, "uo": n * yo}
        for a, z in enumerate(names):
            out |= {f"z{a}": n * F.col(z), f"zy{a}": n * F.col(z) * y, f"zo{a}": n * F.col(z) * yo}
            out |= {f"zz{a}_{b}": n * F.col(z) * F.col(names[b]) for b in range(a, kc)}
        return out

    block = rows.where(whole).groupBy("unit").agg(*[F.sum(v).alias(q) for q, v in stats(F.col("n")).items()])
    block = block.withColumn("key", F.xxhash64(F.lit("unit"), "unit")).drop("unit")
    same = rows.where(~whole).groupBy("unit", "w", "f", "y", "yo", "t", "n", *names).agg(F.count("*").alias("k"))
    copy = same.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("k") * F.col("n")).cast("long"))))
    copy = copy.select(F.xxhash64(F.lit("copy"), "unit", "w", "f", "yo", "t", "n", *names, "copy").alias("key"), *[v.alias(q) for q, v in stats(F.lit(1.0)).items()])
    return block.unionByName(copy)


def weights(found: DataFrame, sums: DataFrame, effects: DataFrame, cells: DataFrame, gram: np.ndarray, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(per cell w, j: c00 and cz0.., Czz). found: key, w, j, whole, ell, b, v of the leverage probes."""
    kc = len(names)
    x = found.select("key", "w", "j", "whole", "ell", "b", "v").join(sums, "key").join(effects.select("w", "j", "alpha", "psi"), ["w", "j"]).join(cells, ["w", "j"])
    inv = np.linalg.inv(gram)
    shared = found.sparkSession.sparkContext.broadcast(inv)
    out = ["c00", *[f"cz{i}" for i in range(kc)], *[f"zz{i}" for i in range(kc * kc)], "left"]
    pairs = [(a, b) for a in range(kc) for b in range(a, kc)]

    def part(t: pa.Table) -> pa.RecordBatch:
        inv = shared.value
        get = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        many = lambda c: np.column_stack([get(f"{c}{i}") for i in range(kc)])
        m, fit, p, z = get("m"), get("alpha") + get("psi"), many("p"), many("z")
        c = np.zeros((t.num_rows, kc + 1, kc + 1))
        c[:, 0, 0] = m
        c[:, 0, 1:] = c[:, 1:, 0] = z - m[:, None] * p
        for a, b in pairs:
            c[:, a + 1, b + 1] = c[:, b + 1, a + 1] = get(f"zz{a}_{b}") - p[:, a] * z[:, b] - p[:, b] * z[:, a] + m * p[:, a] * p[:, b]
        uy, ue = get("uy"), get("uo") - m * fit
        y = np.column_stack([uy, many("zy") - p * uy[:, None]])
        e = np.column_stack([ue, many("zo") - fit[:, None] * z - p * ue[:, None]])
        share = np.zeros_like(c)
        share[:, 0, 0], share[:, 1:, 1:] = (1 - get("ell")) / m, inv
        root = np.zeros_like(c)
        root[:, 0, 0], root[:, 1:, 1:] = np.sqrt(share[:, 0, 0]), np.linalg.cholesky(inv)
        left = 1 - np.linalg.eigvalsh(root.transpose(0, 2, 1) @ c @ root)[:, -1]
        maker = np.eye(kc + 1) - c @ share
        maker[left <= 1e-10] = np.eye(kc + 1)  # refused by the caller
        both = np.linalg.solve(maker, np.stack([e, c[:, :, 0] / np.sqrt(m)[:, None]], axis=2))
        ra, rw = both[:, :, 0], both[:, :, 1]
        along, k = ra[:, 0] / np.sqrt(m), rw[:, 0] / np.sqrt(m)
        e = ra + ((get("b") - get("v") * k) * along)[:, None] * rw
        cz = y[:, :1] * e[:, 1:] + e[:, :1] * y[:, 1:]
        zz = (y[:, 1:, None] * e[:, None, 1:]).reshape(t.num_rows, -1)
        cols = [get("w"), get("j"), y[:, 0] * e[:, 0], *cz.T, *zz.T, left]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(q)) for q in cols], ["w", "j", *out])

    def run(batches):
        most = firmwise.rows_for((kc + 1) ** 2)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield part(pa.Table.from_batches([batch.slice(at, most)]))

    done = cut(x.mapInArrow(run, "w long, j int, " + ", ".join(f"{q} double" for q in out)))
    got = done.agg(F.min("left").alias("left"), *[F.sum(f"zz{i}").alias(f"zz{i}") for i in range(kc * kc)]).first()
    if got["left"] <= 1e-10:
        raise Withheld("NONESTIMABLE_UNIT", f"least share left {got['left']}")
    return done.groupBy("w", "j").agg(F.sum("c00").alias("cell_weight"), *[F.sum(f"cz{i}").alias(f"cz{i}") for i in range(kc)]), np.array(list(got)[1:]).reshape(kc, kc)
