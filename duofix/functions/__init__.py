"""Column functions: keyed signs and draws, normalised midranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hex_word(*parts: Column | str, at: int = 0) -> Column:
    """A 28-bit whole number from the md5 of the parts, the same in any engine and any partitioning."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1 + 7 * at, 7), 16, 10).cast("long")


def sign(*parts: Column | str) -> Column:
    """-1 or 1 with equal chances."""
    return 1 - 2 * (hex_word(*parts) % 2)


def normal(*parts: Column | str) -> Column:
    """A standard normal draw (Box-Muller on two words)."""
    u = (hex_word(*parts) + 0.5) / (1 << 28)
    v = (hex_word(*parts, at=1) + 0.5) / (1 << 28)
    return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)


def with_midrank(df: DataFrame, value: str, out: str = "midrank") -> DataFrame:
    """Adds (first + last rank - 1) / n - 1, ties sharing a rank, in [-1, 1]; a null value counts for nothing and gets null.

    Ranks come from counts of distinct values, cumulated in two levels, so no task sees all rows:
    values are cut at quantiles, cumulated within a cut, and the cuts' totals are added.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    cuts = counts.select(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(cuts))]), lambda b: b <= F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__m")).withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))  # 64 rows
    inside = Window.partitionBy("__part").orderBy(value)
    total = counts.agg(F.sum("__n").alias("__total"))
    ranks = counts.withColumn("__last", F.sum("__n").over(inside)).join(F.broadcast(parts.select("__part", "__before")), "__part").join(F.broadcast(total))
    last = F.col("__last") + F.col("__before")
    ranks = ranks.select(value, ((2 * last - F.col("__n")) / F.col("__total") - 1).alias(out))
    return df.join(ranks, value, "left")


def with_rank_bin(df: DataFrame, value: str, key: str, bins: int, out: str = "bin") -> DataFrame:
    """Adds floor((rank - 1) * bins / n) + 1, ranks by value and then by key (a number); a row without value or key gets null.

    Rows are cut at quantiles of the value and, inside a value, of the key, so neither a task nor a
    tied value has to see all rows: a row's rank is the rows of the cuts before it plus its place in its own.
    """
    known = F.col(value).isNotNull() & F.col(key).isNotNull()
    at = [i / 64 for i in range(1, 64)]
    cuts, inner = df.where(known).select(F.percentile_approx(value, at, 1000), F.percentile_approx(key, at, 1000)).first()
    index = lambda c, x: F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(x))]), lambda b: b <= F.col(c))) if x else F.lit(0)
    tied = F.array(*[F.lit(float(b)) for b in sorted(set(cuts or []))]).cast("array<double>")
    # rows at a cut's own value are parted by the key, the rest of a cut is not
    df = df.withColumn("__value", F.when(known, index(value, cuts) * 2 + 1 - F.array_contains(tied, F.col(value).cast("double")).cast("int")))
    df = df.withColumn("__key", F.when(F.col("__value") % 2 == 0, index(key, inner)).otherwise(0))
    before = Window.orderBy("__value", "__key").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.where(known).groupBy("__value", "__key").agg(F.count("*").alias("__m"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).withColumn("__n", F.sum("__m").over(Window.partitionBy(F.lit(0))))  # 4,160 rows at most
    inside = Window.partitionBy("__value", "__key").orderBy(value, key)
    rank = F.row_number().over(inside) + F.col("__before")
    df = df.join(F.broadcast(parts.drop("__m")), ["__value", "__key"], "left").withColumn("__rank", F.when(known, rank))
    return df.withColumn(out, F.expr(f"(__rank - 1) * {int(bins)} div __n + 1")).drop("__value", "__key", "__before", "__n", "__rank")
