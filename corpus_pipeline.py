"""A cleaning pipeline over documents: each stage reads what the one before has kept."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from duofix.llm import decontam, lines, neardup, pieces, quality
from duofix.llm.runtime import cut, drop_ids, small, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; n_chars follows the text. Documents without any text left go."""
    return lines.strip(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id; of repeated rows (same id and text), one."""
    found = neardup.near_duplicates(docs, percent=80)
    rest = drop_ids(docs, cut(found.where("not kept").select("doc_id")))
    twice = cut(rest.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    return drop_ids(rest, twice).unionByName(rest.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return drop_ids(docs, cut(found.where("contaminated").select("doc_id")))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of their decoding."""
    return pieces.encode(docs, importlib.import_module("public_tokenizers").path("piece_bpe_32k.model"), digests_only=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("lines", without_common_lines),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("pieces", as_pieces),
]

ORACLE_SQL = None  # sketches, winnowing and piece merges have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each cut off by a checkpoint in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
