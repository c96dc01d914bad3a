"""What the operators share: input checks, durable cuts of the lineage, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the one named in spark.checkpoint.dir. Where that is unset, a temporary folder is taken
    in local mode, and a cluster, whose machines don't share such a folder, is refused.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of a cut whose rows nothing needs any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with one function call for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    k = 0
    while f"{stem}_{k}" in have:
        k += 1
    return f"{stem}_{k}"


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that extra ones, whatever their names, can't clash."""
    need(df, *names)
    return df.select(*[F.col(f"`{n}`") for n in names])


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows; meant for narrow rows of numbers that have been cut."""
    return F.broadcast(df) if df.count() <= most else df


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """df without the rows whose id is among ids (one column), which are broadcast if there are at most `most`."""
    return df.join(small(ids, most), id_col, "left_anti")
