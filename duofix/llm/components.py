"""Connected components of a graph of any size by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import cut, release

SALTS = 64


def _fewer(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (u, v) with m, the smallest v of each u; the cut table that it reads).

    The pairs of a node that has over a 32nd of all rows (32 such nodes at most) are dealt over SALTS tasks.
    """
    low = cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hot = [r["u"] for r in low.where(F.col("n") > max(256, rows // 32)).select("u").collect()]
    if not hot:
        return pairs.join(low.select("u", "m"), "u"), low
    salt = F.when(F.col("u").isin(hot), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    all_salts = F.explode(F.when(F.col("u").isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    return pairs.withColumn("salt", salt).join(low.select("u", "m", all_salts.alias("salt")), ["u", "salt"]).drop("salt"), low


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v: long), root being the smallest node that is reachable; null ends are ignored.

    Each step is an aggregation by node (combined before the shuffle) and a join by node, in which the few nodes with
    very many neighbours are salted; the number of steps grows with the logarithm of the size.
    """
    e, before = cut(_fewer(edges)), None
    rows = e.count()
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, low1 = _with_least(both, 2 * rows)
        large = cut(joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        joined, low2 = _with_least(large, rows)
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut(_fewer(small))
        for done in (e, large, low1, low2):
            release(done)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, rows = now, now[0]
