"""Controls by partialling out both effects: K small weighted normal equations over two-way residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import exact, firmwise


def coefficients(rows: DataFrame, spec: PanelSpec, limit: int, tolerance: float = 1e-10) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names z1.., coefficients in the full weighted regression, Gram of the partialled-out controls).

    With M the residual maker of both effects, they solve (Z'MZ) b = Z'My. For each column x, Mx
    needs the firm effects of x from one firm-by-firm solve; all columns share the inverse.
    """
    names = [c for c in rows.columns if c[0] == "z" and c[1:].isdigit()]
    if not names:
        return [], np.zeros(0), np.zeros((0, 0))
    cols = ["y", *names]
    cells = rows.groupBy("w", "f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in cols])
    cells = exact.cut(cells)
    _, firms = exact.index_firms(cells, limit - len(names))
    c = cells.join(firms, "f")
    worker = c.groupBy("w").agg(F.sum("n").alias("nw"), *[F.sum(x).alias(f"{x}_w") for x in cols])
    joined = exact.cut(c.join(worker, "w"))
    k = joined.agg(F.max("j")).first()[0] + 1
    base = exact.by_worker(cells.withColumn("sy", F.col("y")), firms)
    solve = firmwise.Solver(exact.cut(base).sortWithinPartitions("w", "j"), k, spec)
    rhs = joined.groupBy("j").agg(*[F.sum(F.col(x) - F.col("n") * F.col(f"{x}_w") / F.col("nw")).alias(x) for x in cols]).orderBy("j").toArrow()
    effect = dict(zip(cols, solve(np.column_stack([rhs[x].to_numpy() for x in cols])).T, strict=True))
    # residual cross-products: Z'MZ = Z'Z - (worker and firm parts)
    cross = rows.agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in cols]).first()
    part = joined.groupBy("w").agg(F.max("nw").alias("nw"), *[F.max(f"{x}_w").alias(x) for x in cols]).agg(*[F.sum(F.col(a) * F.col(b) / F.col("nw")).alias(f"{a}_{b}") for a in names for b in cols]).first()
    full = lambda a, b: cross[f"{a}_{b}"] - part[f"{a}_{b}"] - float(rhs[a].to_numpy() @ effect[b])
    gram = np.array([[full(a, b) for b in names] for a in names])
    gram = (gram + gram.T) / 2
    scale = np.sqrt(np.array([max(cross[f"{a}_{a}"], 1e-300) for a in names]))
    value = np.linalg.eigvalsh(gram / np.outer(scale, scale))
    if value[0] <= tolerance:
        raise Withheld("RANK_DEFICIENT_CONTROLS")
    return names, np.linalg.solve(gram, np.array([full(a, "y") for a in names])), gram


def offset(b: np.ndarray) -> Column:
    """y less the controls' part."""
    y = F.col("y")
    for k, v in enumerate(b, 1):
        y = y - F.col(f"z{k}") * float(v)
    return y
