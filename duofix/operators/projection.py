"""Regression of estimated effects on covariates and a constant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import cut, firmwise, jla, small_table


def coefficients(df: DataFrame, effect: str, covariates: list[str], weight: str | None = None) -> DataFrame:
    """(term, coefficient) by weighted least squares; one aggregation of (K + 1)(K + 2) sums."""
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(x)
    got = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(w * x[i] * F.col(effect)).alias(f"r{i}") for i in range(k)]).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.linalg.solve(gram, np.array([got[f"r{i}"] for i in range(k)], float))
    return small_table(spark, [(t, float(v)) for t, v in zip(["constant", *covariates], b, strict=True)], "term string, coefficient double")


def regress(rows: DataFrame, kernels: DataFrame, firms: DataFrame, units: DataFrame, spec: PanelSpec, solver: firmwise.Solver) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, covariance by leave-out products, naive covariance) of an effect on a constant and x1...

    A coefficient is a weighted sum of outcomes; a unit's weight is the prediction of A L at its cell, L being the
    coefficient's load on the effects. The grounded firm moves the constant alone. units: of inference.units.
    """
    z = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, len(spec.project) + 1)]]
    omega, kc = F.col("n" if spec.project_weight == "frequency" else "t"), len(z)
    cells = rows.groupBy("w", "f").agg(*[F.sum(omega * x).alias(f"l{i}") for i, x in enumerate(z)]).join(firms, "f").withColumn("w", F.xxhash64("w"))
    got = rows.agg(*[F.sum(omega * z[i] * z[j]).alias(f"g{i}_{j}") for i in range(kc) for j in range(i, kc)]).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(kc)] for i in range(kc)])
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    if np.linalg.eigvalsh(gram / np.outer(scale, scale))[0] <= 1e-12:
        raise Withheld("RANK_DEFICIENT_PROJECTION")
    inv = np.linalg.inv(gram)
    effect = F.col("psi" if spec.project_effect == "firm" else "alpha")
    cells = cut(cells.join(kernels.select("w", "j", "alpha", "psi", F.col("n").alias("cell_n")), ["w", "j"]))
    b = inv @ np.array(list(cells.agg(*[F.sum(F.col(f"l{i}") * effect) for i in range(kc)]).first()))
    share = F.col("n") / F.col("cell_n")
    u = units.select("key", "w", "j", "n", "product", "e").join(cells.select("w", "j", "cell_n", *[f"l{i}" for i in range(kc)]), ["w", "j"])
    u = jla.deal(u.select("key", "w", "j", "n", "product", "e", *[(F.col(f"l{i}") * share).alias(f"l{i}") for i in range(kc)]), "j", "key")
    worker = spec.project_effect == "worker"
    loads = lambda b: np.column_stack([b.col[f"l{i}"] for i in range(kc)]) @ inv

    def rhs(batches):
        for b in firmwise.whole_workers(batches, kc):
            yield b.j, -b.p[:, None] * b.total(loads(b)) if worker else loads(b)

    right = firmwise.collect(u, rhs, solver.k, kc)
    if solver.inverse is None and not worker:  # loads on firms are made to sum to nothing, as the last firm is grounded
        right[-1] -= right.sum(0)
    shared = rows.sparkSession.sparkContext.broadcast(solver(right))

    def run(batches):
        for b in firmwise.whole_workers(batches, kc):
            c = b.away(shared.value) + (b.total(loads(b)) / b.nw[:, None] if worker else 0)
            c = np.sqrt(b.n)[:, None] * c
            both = np.stack([c.T @ (q[:, None] * c) for q in (b.col["product"], b.col["e"] ** 2)])
            yield np.zeros(1, np.int64), both.reshape(1, -1)

    robust, naive = firmwise.collect(u, run, 1, 2 * kc * kc)[0].reshape(2, kc, kc)
    robust = (robust + robust.T) / 2
    low, size = np.linalg.eigvalsh(robust)[0], np.abs(robust).max()
    if low < -1e-8 * size:
        raise Withheld("PROJECTION_COVARIANCE")
    return b, robust + max(0.0, -low) * np.eye(kc), naive
