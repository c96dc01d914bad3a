"""Corrected centering: the bias of centring by an estimated mean, from leave-out residuals.

All copies of a unit share a row, so each unit has one unknown kappa in (diag(delta) + F' A F) kappa = b. With
u = A F kappa it turns into one more two-way regression, of weights m + m^2 / delta and sums m b / delta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import cut, firmwise, jla


def _regress(u: DataFrame, n, y, spec: PanelSpec, k: int) -> DataFrame:
    cells = u.groupBy("w", "j").agg(F.sum(n).alias("n"), F.sum(y).alias("sy"), F.sum("s").alias("s"))
    cells = jla.deal(cells.select("w", "j", "n", "sy", "s"), "j")
    return jla.effects(cells, firmwise.Solver(cells, k, spec)).select("w", "j", (F.col("alpha") + F.col("psi")).alias("fitted"))


def increment(units: DataFrame, spec: PanelSpec, k: int) -> tuple[float, float, float]:
    """What is added to the mean-centred estimates of the three targets. units: of inference.units, centred by the mean."""
    total = float(units.agg(F.sum("n")).first()[0])
    u = units.withColumn("t", F.col("n") * F.col("product")).withColumn("delta", total * (1 - F.col("h")) - F.col("n"))
    if u.agg(F.min("delta")).first()[0] <= 1e-8 * total:
        raise Withheld("CENTERING_UNIT", "a unit of too high a leverage for the size of the sample")
    u = cut(u.join(_regress(u, F.col("n"), F.col("t"), spec, k), ["w", "j"]).withColumn("b", F.col("t") - F.col("n") * F.col("fitted")).drop("fitted"))
    weight = F.col("n") + F.col("n") ** 2 / F.col("delta")
    u = u.join(_regress(u, weight, F.col("n") * F.col("b") / F.col("delta"), spec, k), ["w", "j"])
    kappa = (F.col("b") - F.col("n") * F.col("fitted")) / F.col("delta")
    return tuple(-float(x) for x in u.agg(*[F.sum(F.col(f"d{i}") * kappa) for i in (1, 2, 3)]).first())
