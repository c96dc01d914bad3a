"""Durable cuts of the lineage and the driver's small tables, shared by the operators."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the shared checkpoint folder (spark.checkpoint.dir). Where that is unset, local mode takes a temporary folder and a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver, of numbers, texts and booleans.

    Through Arrow: createDataFrame of a list runs on Python workers, which each executor keeps beside those of mapInArrow.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}), schema)
