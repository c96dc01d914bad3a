"""Panels as DataFrames: reading, validation, and simulated examples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hex_word, normal
from ..spec import PHYSICAL_LIMIT, PanelSpec, Withheld


def read(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    return spark.read.format(form).options(**options).load(path)


def freeze(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Role columns only: w, f, unit, y, n (frequency), t (target mass), z1.. (controls), x1.. (covariates of the projection), after the missing-value rule and all checks.

    One aggregation checks all rows. Match deletion fails on a missing value, observation deletion drops such rows.
    """
    spec.validate()
    cols = {"w": F.col(spec.worker), "f": F.col(spec.firm), "y": F.col(spec.y).cast("double")}
    cols["n"] = F.col(spec.frequency).cast("double") if spec.frequency else F.lit(1.0)
    cols["t"] = F.col(spec.target).cast("double") if spec.target else cols["n"]
    for k, c in enumerate(spec.controls, 1):
        cols[f"z{k}"] = F.col(c).cast("double")
    for k, c in enumerate(spec.project, 1):
        cols[f"x{k}"] = F.col(c).cast("double")
    k = len(spec.controls)
    for c in spec.factors:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(34).collect()]
        if len(levels) + k > 33:
            raise Withheld("INVALID_OPTION", "at most 32 controls after expansion")
        for v in levels[1:]:  # the first level is the base
            k += 1
            cols[f"z{k}"] = F.when(F.col(c).isNotNull(), (F.col(c) == F.lit(v)).cast("double"))
    unit = F.col(spec.unit) if spec.unit else F.struct(cols["w"].alias("w"), cols["f"].alias("f"))
    rows = df.select(*[c.alias(a) for a, c in cols.items()], unit.alias("unit"))
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    missing = F.col("w").isNull() | F.col("f").isNull() | F.col("unit").isNull()
    for c in cols:
        if c not in ("w", "f"):
            missing = missing | bad(c)
    if spec.deletion == "observation":
        rows = rows.where(~missing)
    got = rows.agg(
        F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(((F.col("n") <= 0) | (F.col("n") != F.floor("n"))).cast("long")), F.lit(0)).alias("frequency"),
        F.coalesce(F.sum((F.col("t") < 0).cast("long")), F.lit(0)).alias("target"),
        F.sum("t").alias("mass"),
        F.sum(F.col("n").cast("decimal(38,0)")).alias("total"),
    ).first()
    if got["missing"]:
        raise Withheld("MATCH_INPUT_MISSING", f"{got['missing']} rows")
    if got["frequency"]:
        raise Withheld("INVALID_FREQUENCY")
    if got["target"] or (got["mass"] is not None and got["mass"] <= 0):
        raise Withheld("INVALID_TARGET")
    if got["total"] is not None and got["total"] > PHYSICAL_LIMIT:
        raise Withheld("PHYSICAL_TOTAL_LIMIT")
    if spec.unit and not rows.groupBy("unit").agg(F.min(F.struct("w", "f")).alias("a"), F.max(F.struct("w", "f")).alias("b")).where("a <> b").isEmpty():
        raise Withheld("CROSS_COORDINATE_MATCH")
    return rows


# Firms and disturbances of example ex5, row by row.
EX5_FIRMS = [0, 0, 1, 1, 0, 2, 2, 1, 1, 2, 3, 3, 2, 3, 0, 0, 3, 1, 1, 2, 3, 3, 2, 0]
EX5_ERRORS = [0.2, -0.1, 0.1, -0.2, -0.2, 0.3, -0.1, 0.1, 0.1, -0.2, 0.2, -0.1, -0.1, 0.2, -0.2, 0.1, 0.3, -0.2, 0.1, -0.2, -0.2, 0.1, 0.2, -0.1]


def simulate(spark: SparkSession, name: str) -> DataFrame:
    """Example panels ex1 to ex5 with their true effects. Draws are keyed by md5, so they are the same everywhere.

    ex1, ex2: three jobs a worker, two observations a job, sorting. ex3: frequencies and target masses. ex4: firm effects
    by firm size, one move to the next firm. ex5: 24 fixed rows.
    """
    i, worker, firm = F.col("id"), F.col("worker_id"), F.col("firm_id")
    wage = lambda df, more: df.withColumn("log_wage", 2 + F.col("worker_fe") + F.col("firm_fe") + more + F.col("error"))
    if name in ("ex1", "ex2"):
        workers, firms, seed = (10_000, 3001, "20260821") if name == "ex1" else (200, 61, "20260820")
        df = spark.range(workers * 6).select((F.floor(i / 6) + 1).alias("worker_id"), (F.floor(i % 6 / 2) + 1).alias("spell"), (i % 2 + 1).alias("period"))
        step = 1 + hex_word(seed, "step", worker) % (firms - 1)
        at = lambda spell: (worker - 1 + (spell - 1) * step) % firms + 1
        premium = lambda f: normal(seed, "firm", f)
        df = df.withColumn("firm_id", at(F.col("spell"))).withColumn("match_id", worker * 10 + F.col("spell")).withColumn("firm_fe", premium(firm))
        mean = (premium(at(F.lit(1))) + premium(at(F.lit(2))) + premium(at(F.lit(3)))) / 3
        df = df.withColumn("worker_fe", 0.5 * mean + normal(seed, "worker", worker))
        cell = (worker, F.col("spell"), F.col("period"))
        df = df.withColumn("productivity", normal(seed, "productivity", *cell)).withColumn("error", 3 * normal(seed, "error", *cell))
        return wage(df, 0.30 * F.col("productivity") + 0.15 * (F.col("period") == 2).cast("double"))
    if name == "ex3":
        df = spark.range(180).select((F.floor(i / 3) + 1).alias("worker_id"), (i % 3 + 1).alias("spell"))
        away = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(7)), F.col("spell").cast("int"))
        df = df.withColumn("firm_id", (worker - 1 + away) % 15 + 1).withColumn("match_id", worker * 10 + F.col("spell"))
        df = df.withColumn("frequency", 1 + (worker + F.col("spell")) % 3).withColumn("target_mass", 1 + F.col("spell") / 2)
        df = df.withColumn("worker_fe", normal("ex3", "worker", worker)).withColumn("firm_fe", 0.6 * normal("ex3", "firm", firm))
        df = df.withColumn("productivity", normal("ex3", "productivity", F.col("match_id"))).withColumn("error", 0.45 * normal("ex3", "error", F.col("match_id")))
        return wage(df, 0.35 * F.col("productivity"))
    if name == "ex4":
        # workers 1 to 10 begin at the firm of their number, the next at firm 1, three at firm 2, five at firm 3 and so on: 2k in all at firm k
        df = spark.range(440).select((F.floor(i / 4) + 1).alias("worker_id"), (i % 4 + 1).alias("year"))
        origin = F.when(worker <= 10, worker).otherwise(F.ceil(F.sqrt(worker - 10)))
        df = df.withColumn("firm_id", F.when(F.col("year") <= 2, origin).otherwise(origin % 10 + 1).cast("long"))
        size = firm + F.when(firm == 1, 10).otherwise(firm - 1)  # those who begin there and those who come, two years each, twice as many as the numbers, over four years
        df = df.withColumn("firm_size", size.cast("double")).withColumn("log_firm_size", F.log("firm_size"))
        df = df.withColumn("worker_fe", 0.4 * normal("ex4", "worker", worker)).withColumn("firm_fe", 0.5 * F.col("log_firm_size"))
        return wage(df.withColumn("error", 0.15 * normal("ex4", "error", worker, F.col("year"))), F.lit(0.0))
    if name == "ex5":
        df = spark.createDataFrame([(k // 4, k % 4, f, float(e)) for k, (f, e) in enumerate(zip(EX5_FIRMS, EX5_ERRORS, strict=True))], "worker_id long, period long, firm_id long, error double")
        df = df.withColumn("productivity", F.col("period") - 1.5).withColumn("policy", (F.col("period") == 2).cast("double"))
        df = df.withColumn("worker_fe", 0.3 * worker).withColumn("firm_fe", -0.2 * firm)
        return wage(df, 0.4 * F.col("productivity") - 0.15 * F.col("policy") - 0.5)
    raise Withheld("INVALID_OPTION", f"no example {name!r}")


def connected_copies(df: DataFrame, worker: str, firm: str, y: str, design: str, copies: int) -> DataFrame:
    """Copies of a panel, workers and firms renamed "copy:name", joined by movers: a panel of any size for tests of scale.

    design ring links each copy to the next, replicated_blocks each to each. A link is two workers with a row at the
    first firm (by name) of either copy, outcome 0. See copies_facts for what comes out.
    """
    if design not in ("ring", "replicated_blocks") or copies < 2:
        raise Withheld("INVALID_OPTION", f"{design!r} of {copies} copies")
    named = lambda c: F.concat_ws(":", F.col("__copy").cast("string"), F.col(c).cast("string"))
    many = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(named(worker).alias(worker), named(firm).alias(firm), F.col(y).cast("double").alias(y))
    left = F.col("id") + 1
    pairs = df.sparkSession.range(copies if design == "replicated_blocks" or copies > 2 else 1)
    right = left % copies + 1
    if design == "replicated_blocks":
        pairs, right = pairs.where(left < copies), F.explode(F.sequence(left + 1, F.lit(copies).cast("long")))
    first = df.select(F.min(F.col(firm).cast("string"))).first()[0]
    links = pairs.select(left.alias("l"), right.alias("r")).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.explode(F.array("l", "r")))
    text = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    return many.unionByName(links.select(text(F.lit("link"), F.col("l"), F.col("r"), F.col("i")).alias(worker), text(F.col("at"), F.lit(first)).alias(firm), F.lit(0.0).alias(y)))


def copies_facts(design: str, copies: int, rows: int, workers: int, firms: int, cells: int) -> dict[str, float]:
    """Counts of connected_copies, and conductance and extreme eigenvalues of the normalised Laplacian of the graph of copies."""
    ring = design == "ring"
    pairs = (1 if copies == 2 else copies) if ring else copies * (copies - 1) // 2
    half = copies // 2
    if ring and copies > 2:
        cut, least, most = 1 / half, 1 - math.cos(2 * math.pi / copies), 2.0 if copies % 2 == 0 else 1 + math.cos(math.pi / copies)
    else:
        cut, least = (copies - half) / (copies - 1), copies / (copies - 1)
        most = least
    return {"rows": copies * rows + 4 * pairs, "workers": copies * workers + 2 * pairs, "firms": copies * firms, "cells": copies * cells + 4 * pairs, "pairs": pairs, "conductance": cut, "lambda2": least, "lambda_max": most}


def true_moments(df: DataFrame, worker_effect: str, firm_effect: str, mass: str | None = None) -> DataFrame:
    """Mass-weighted population variances, covariance and variance of the sum of two known effects."""
    m = F.col(mass).cast("double") if mass else F.lit(1.0)
    a, p = F.col(worker_effect), F.col(firm_effect)
    s = df.agg(*[F.sum(m * x).alias(k) for k, x in {"m": F.lit(1.0), "a": a, "p": p, "aa": a * a, "pp": p * p, "ap": a * p}.items()])
    v = lambda x, y, z: F.col(z) / F.col("m") - F.col(x) * F.col(y) / (F.col("m") * F.col("m"))
    s = s.select(v("a", "a", "aa").alias("worker_variance"), v("p", "p", "pp").alias("firm_variance"), v("a", "p", "ap").alias("worker_firm_covariance"))
    return s.withColumn("total_variance", F.expr("worker_variance + firm_variance + 2 * worker_firm_covariance"))
