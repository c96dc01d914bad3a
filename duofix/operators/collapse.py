"""Rows to cells, units and target strata; everything later works on these."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cells(rows: DataFrame) -> DataFrame:
    """Per worker-firm cell: rows, n, sum of n y and n y^2, target mass."""
    return rows.groupBy("w", "f").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("syy"), F.sum("t").alias("t"))


def units(rows: DataFrame) -> DataFrame:
    """Per deletion unit: the same sums, and the collapsed outcome (sum n y over root n)."""
    out = rows.groupBy("unit", "w", "f").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("syy"), F.sum("t").alias("t"))
    return out.withColumn("y_unit", F.col("sy") / F.sqrt("n"))


def strata(rows: DataFrame) -> DataFrame:
    """Per cell and target mass of one copy, never merging neighbouring masses."""
    return rows.withColumn("copy_mass", F.col("t") / F.col("n")).groupBy("w", "f", "copy_mass").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def classify(rows: DataFrame) -> DataFrame:
    """Per worker: number of units and firms, physical total, and whether it is a mover (more than one unit)."""
    return rows.groupBy("w").agg(F.countDistinct("unit").alias("units"), F.countDistinct("f").alias("firms"), F.sum("n").alias("physical")).withColumn("mover", F.col("units") > 1)


def outcome_moments(rows: DataFrame) -> DataFrame:
    """Variance of the outcome by frequency and by target mass, effective number of units and the largest share."""
    m = rows.agg(*[F.sum(F.col(x) * F.col("y") ** k).alias(f"{x}{k}") for x in ("n", "t") for k in (0, 1, 2)])
    u = rows.groupBy("unit").agg(F.sum("n").alias("n")).agg((F.sum("n") ** 2 / F.sum(F.col("n") ** 2)).alias("effective_units"), (F.max("n") / F.sum("n")).alias("largest_share"))
    v = lambda x: F.expr(f"{x}2 / {x}0 - ({x}1 / {x}0) * ({x}1 / {x}0)")
    return m.select(v("n").alias("frequency_variance"), v("t").alias("target_variance")).join(F.broadcast(u))


def parallel_blocks(rows: DataFrame) -> DataFrame:
    """Cells that hold several deletion units: w, f, units, rows."""
    return rows.groupBy("w", "f").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("rows")).where("units > 1")


def residual_moments(rows: DataFrame, kernels: DataFrame, firms: DataFrame) -> DataFrame:
    """Variances of the outcome by frequency (less fixed controls) and by target mass, of the residual, and what the effects explain.

    Joint controls count as explained. The residual sum comes from differences by row, not from sums of squares.
    """
    fitted = kernels.join(firms, "j").select("w", "f", "alpha", "psi")
    x = rows.withColumn("hw", F.xxhash64("w")).join(fitted.withColumnRenamed("w", "hw"), ["hw", "f"])
    left = F.col("yo") - F.col("alpha") - F.col("psi")
    got = x.agg((F.sum(F.col("n") * left * left) / F.sum("n")).alias("residual_variance"))
    m = outcome_moments(rows).select(F.col("frequency_variance").alias("regression_outcome_variance"), F.col("target_variance").alias("target_outcome_variance"))
    explained = F.col("regression_outcome_variance") - F.col("residual_variance")
    return m.join(F.broadcast(got)).withColumn("explained_variance", explained).withColumn("explained_share", explained / F.col("regression_outcome_variance"))
