"""Exact correction with controls that are estimated jointly with both effects.

By partialling out, a copy's row of the inverse is c = A1 x1 - B g with g = G^-1 z~, where z~ is the
control row less its prediction by both effects (B), G the Gram of z~ and A1 the two-way inverse. So
the leverage is h1 + z~' g and each target's kernel is [1, z~'] N [1, z~']' with
N = [[q1, -v' G^-1], [-G^-1 v, G^-1 M G^-1]], v = x1' A1 Q B (one number a cell and control) and M = B' Q B.
A deleted block then needs only its sums of [1, z~] outer products, y and residuals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec
from . import cut, exact, firmwise


def geometry(rows: DataFrame, firms: DataFrame, names: list[str], solver: firmwise.Solver) -> tuple[DataFrame, np.ndarray]:
    """(per cell w, j: predictions p1.. of the controls and v1.. for the three targets, M of the three targets)."""
    k, kc = solver.k, len(names)
    c = rows.groupBy("w", "f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), *[F.sum(F.col("n") * F.col(z)).alias(z) for z in names])
    mass = rows.agg(F.sum("t")).first()[0]
    c = c.join(firms, "f").select(F.xxhash64("w").alias("w"), "j", "n", (F.col("t") / mass).alias("s"), *names)
    c = cut(c.repartition("w").sortWithinPartitions("w", "j")).sortWithinPartitions("w", "j")
    sc = rows.sparkSession.sparkContext

    def rhs(batches):
        for b in firmwise.whole_workers(batches, kc):
            z = np.column_stack([b.col[x] for x in names])
            yield b.j, z - b.p[:, None] * b.total(z)

    psi = solver(firmwise.collect(c, rhs, k, kc))
    shared = sc.broadcast(psi)

    def alphas(b, psi):
        z = np.column_stack([b.col[x] for x in names])
        return b.total(z) / b.nw[:, None] - b.total(b.p[:, None] * psi[b.j])

    def sums(batches):
        for b in firmwise.whole_workers(batches, 3 * kc + 2):
            psi = shared.value
            a, s, sw = alphas(b, psi), b.col["s"], b.total(b.col["s"])
            sp = b.total(s[:, None] * psi[b.j])
            yield b.j, np.column_stack([(b.p * sw)[:, None] * a, b.p[:, None] * sp, s[:, None] * a, b.p * sw, s])
            square = np.einsum("i,ik,il->kl", s, a, a)  # over the copies' masses, as a is one number a worker
            yield k + np.arange(kc), np.column_stack([square, np.zeros((kc, 2 * kc + 2))])

    got = firmwise.collect(c, sums, k + kc, 3 * kc + 2)
    square, got = got[k:, :kc], got[:k]
    s1, s2, s3, m, s = got[:, :kc], got[:, kc : 2 * kc], got[:, 2 * kc : 3 * kc], got[:, -2:-1], got[:, -1:]
    amean, pmean = s3.sum(0), (s * psi).sum(0)
    cross = (s3.T @ psi + psi.T @ s3) / 2
    big_m = np.stack([square - np.outer(amean, amean), psi.T @ (s * psi) - np.outer(pmean, pmean), cross - (np.outer(amean, pmean) + np.outer(pmean, amean)) / 2])
    v = solver(np.column_stack([m * amean - s1, s * (psi - pmean), (s3 - s * amean) / 2 - (s2 - m * pmean) / 2]))
    more = sc.broadcast(v)
    out = ", ".join(["w long", "j int", *[f"p{i} double" for i in range(kc)], *[f"v{i} double" for i in range(3 * kc)]])

    def cells(batches):
        for b in firmwise.whole_workers(batches, 3 * kc):
            psi, v = shared.value, more.value
            a, s, sw = alphas(b, psi), b.col["s"], b.total(b.col["s"])[:, None]
            at = np.column_stack([sw * (a - amean), np.zeros_like(a), (b.total(s[:, None] * psi[b.j]) - sw * pmean) / 2])
            x = at / b.nw[:, None] + b.away(v)
            cols = [b.col["w"], b.j.astype(np.int32), *(a + psi[b.j]).T, *x.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(q)) for q in cols], [q.split()[0] for q in out.split(", ")])

    return cut(c.mapInArrow(cells, out)), big_m


def correction(rows: DataFrame, kernels: DataFrame, firms: DataFrame, cells: DataFrame, gram: np.ndarray, big_m: np.ndarray, names: list[str], spec: PanelSpec) -> DataFrame:
    """Same columns as exact.correction. rows: w, f, unit, n, y (outcome), yo (outcome less the controls' part), mover, z..

    A mover's unit under match deletion is one block, else each stored row stands for n single copies.
    """
    kc = len(names)
    mean = rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0] if spec.centering == "mean" else 0.0
    whole = F.col("mover") & F.lit(spec.deletion == "match")
    y = F.col("y") - F.lit(float(mean))
    n, yo = F.col("n"), F.col("yo")
    pairs = [(a, b) for a in range(kc) for b in range(a, kc)]
    stats = {"m": n, "uy": n * y, "uo": n * yo}
    stats |= {f"z{a}": n * F.col(names[a]) for a in range(kc)} | {f"zy{a}": n * F.col(names[a]) * y for a in range(kc)} | {f"zo{a}": n * F.col(names[a]) * yo for a in range(kc)}
    stats |= {f"zz{a}_{b}": n * F.col(names[a]) * F.col(names[b]) for a, b in pairs}
    block = rows.where(whole).groupBy("unit", "w", "f").agg(*[F.sum(v).alias(q) for q, v in stats.items()]).drop("unit").withColumn("whole", F.lit(True))
    single = rows.where(~whole).select("w", "f", n.alias("m"), y.alias("uy"), yo.alias("uo"), *[F.col(z).alias(f"z{i}") for i, z in enumerate(names)], F.lit(False).alias("whole"))
    u = block.unionByName(single, allowMissingColumns=True).join(firms, "f").withColumn("w", F.xxhash64("w")).drop("f")
    u = u.join(kernels.select("w", "j", "leverage", "q_worker", "q_firm", "q_cov", "alpha", "psi"), ["w", "j"]).join(cells, ["w", "j"])
    inv = np.linalg.inv(gram)
    shared = rows.sparkSession.sparkContext.broadcast((inv, big_m))
    inner = [inv @ q @ inv for q in big_m]
    schema = "source string, max_leverage double, units long, worker_variance double, firm_variance double, worker_firm_covariance double"

    def kernel(t, inv):
        """N per row and target: rows x 3 x (K + 1) x (K + 1)."""
        get = lambda c: t.column(c).to_numpy()
        out = np.zeros((t.num_rows, 3, kc + 1, kc + 1))
        v = np.column_stack([get(f"v{i}") for i in range(3 * kc)]).reshape(-1, 3, kc) @ inv
        for i, q in enumerate(("q_worker", "q_firm", "q_cov")):
            out[:, i, 0, 0] = get(q)
            out[:, i, 1:, 1:] = inner[i]
        out[:, :, 0, 1:] = out[:, :, 1:, 0] = -v
        return out

    def run(batches):
        inv, _ = shared.value
        most = firmwise.rows_for(3 * (kc + 1) ** 2)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for kind in (True, False):
                t = table.filter(pa.compute.equal(table["whole"], kind))
                for at in range(0, t.num_rows, most):
                    yield from part(t.slice(at, most), kind, inv)

    def part(t, kind, inv):
        get = lambda c: t.column(c).to_numpy()
        m, fit = get("m"), get("alpha") + get("psi")
        p = np.column_stack([get(f"p{i}") for i in range(kc)])
        z, nn = np.column_stack([get(f"z{i}") for i in range(kc)]), kernel(t, inv)
        if kind:
            c = np.zeros((t.num_rows, kc + 1, kc + 1))
            zt = z - m[:, None] * p
            c[:, 0, 0], c[:, 0, 1:], c[:, 1:, 0] = m, zt, zt
            for a, b in pairs:
                c[:, a + 1, b + 1] = c[:, b + 1, a + 1] = get(f"zz{a}_{b}") - p[:, a] * z[:, b] - p[:, b] * z[:, a] + m * p[:, a] * p[:, b]
            uy, ue = get("uy"), get("uo") - m * fit
            zy = np.column_stack([get(f"zy{i}") for i in range(kc)]) - p * uy[:, None]
            ze = np.column_stack([get(f"zo{i}") for i in range(kc)]) - fit[:, None] * z - p * ue[:, None]
            y, e = np.column_stack([uy, zy]), np.column_stack([ue, ze])
            root = np.zeros_like(c)
            root[:, 0, 0], root[:, 1:, 1:] = np.sqrt(get("leverage")), np.linalg.cholesky(inv)
            h = np.linalg.eigvalsh(root.transpose(0, 2, 1) @ c @ root)[:, -1]
            if h.max() < 1 - 1e-10:
                e = np.linalg.solve(np.eye(kc + 1) - c @ root @ root.transpose(0, 2, 1), e[:, :, None])[:, :, 0]
            q = np.einsum("na,ntab,nb->t", y, nn, e)
        else:
            zt = z - p
            h = get("leverage") + np.einsum("na,ab,nb->n", zt, inv, zt)
            x = np.column_stack([np.ones(len(m)), zt])
            each = np.einsum("na,ntab,nb->nt", x, nn, x)
            q = (m * get("uy") * (get("uo") - fit) / np.where(h < 1 - 1e-10, 1 - h, 1))[:, None] * each
            q = q.sum(0)
        yield pa.RecordBatch.from_pydict({"source": ["block" if kind else "copy"], "max_leverage": [float(h.max())], "units": [t.num_rows], **{a: [float(b)] for a, b in zip(exact.TARGETS, q, strict=False)}})

    out = u.mapInArrow(run, schema).groupBy("source").agg(F.max("max_leverage").alias("max_leverage"), F.sum("units").alias("units"), *[F.sum(t).alias(t) for t in exact.TARGETS[:3]])
    return out.withColumn(exact.TARGETS[3], F.expr("worker_variance + firm_variance + 2 * worker_firm_covariance"))
