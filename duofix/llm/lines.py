"""Removal of lines that spread over many sites.

Lines are the parts of a text between line feeds, compared after trimming spaces, by a 64-bit hash. For each line
a HyperLogLog sketch of its sites is merged by aggregation; where the estimate is within `band` of
the threshold, the sites are counted exactly. A line of at least `min_sites` sites is boilerplate:
it stays where it stands in the document of the smallest id and goes everywhere else.

Blank lines never go, and a null site counts as no site. Null text stays null; an empty text has one
blank line. Repeated rows are treated alike. A null id is never the first holder of a line. Texts of any length are
taken whole, an empty table gives an empty result, and extra columns stay as they are, whatever their names. Only
lines' hashes and the ids of holders are shuffled to decide; texts are shuffled once, to rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import cut, fresh, need, small

LG_K = 12


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread(lines: DataFrame, min_sites: int, band: float) -> DataFrame:
    """(h, first) of the lines that at least min_sites sites hold. lines: h, site, doc."""
    by = lines.groupBy("h").agg(F.count("site").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sites"), F.min("doc").alias("first")).where(F.col("n") >= min_sites)
    est = F.hll_sketch_estimate("sites")
    by = cut(by.select("h", "first", est.alias("est")).where(est >= min_sites * (1 - band)))
    near = by.where(F.col("est") <= min_sites * (1 + band)).select("h", "first")
    exact = lines.join(small(near), "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    return by.where(F.col("est") > min_sites * (1 + band)).select("h", "first").unionByName(near.join(exact.select("h"), "h"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, band: float = 0.3, stats: bool = True) -> DataFrame:
    """docs, all columns, with the text rewritten; with stats also n_lines and n_removed (n_lines_0 and so on where docs has such columns)."""
    need(docs, id_col, text_col, site_col)
    total, lost = (c if c not in {x.lower() for x in docs.columns} else fresh(docs, c) for c in ("n_lines", "n_removed"))
    doc, text, site = (F.col(f"`{c}`") for c in (id_col, text_col, site_col))
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.xxhash64(doc, text).alias("a"), F.xxhash64(F.lit(1), text, doc).alias("b")))  # 128 bits, as one key for two texts would mix them up
    lines = docs.select(doc.alias("doc"), site.cast("string").alias("site"), F.explode(_parts(text)).alias("line")).where(F.trim("line") != "").select("doc", "site", _hash(F.col("line")).alias("h"))
    bad = cut(spread(lines, min_sites, band))

    held = keyed.select(F.col(key), doc.alias("doc"), F.explode(F.array_distinct(F.transform(F.filter(_parts(text), lambda x: F.trim(x) != ""), _hash))).alias("h"))
    goes = held.join(small(bad), "h").where(~F.col("doc").eqNullSafe(F.col("first"))).groupBy(key).agg(F.collect_set("h").alias("gone"))

    out = keyed.join(goes, key, "left")
    gone = F.coalesce("gone", F.array().cast("array<long>"))
    parts = _parts(text)
    kept = F.when(F.size(gone) == 0, parts).otherwise(F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(gone, _hash(x))))
    rest = [F.col(f"`{c}`") if c != text_col else F.array_join(kept, "\n").alias(text_col) for c in docs.columns]
    if stats:
        n = F.coalesce(F.size(parts), F.lit(0))
        rest += [F.when(text.isNull(), 0).otherwise(n).cast("long").alias(total), F.when(text.isNull(), 0).otherwise(F.size(parts) - F.size(kept)).cast("long").alias(lost)]
    return out.select(*rest)


def strip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **options) -> DataFrame:
    """line_dedup without statistics, without the documents that lost lines and have no text but blank lines left."""
    said = fresh(docs, "said")
    some = F.col(f"`{text_col}`").rlike("[^ \n]")
    out = line_dedup(docs.withColumn(said, some), id_col=id_col, text_col=text_col, site_col=site_col, stats=False, **options)
    return out.where(F.coalesce(~F.col(said) | some, F.lit(True))).drop(said)
