"""Resolution of not-modified revisits in web archives.

A revisit (a capture answered by 304) is joined as of its time to the latest earlier full response
of the same canonical URL (http and https alike, lower-case host without www., no default port, fragment or
tracking parameter, parameters in order). It is resolved if the validators agree: where both have
an entity tag, the tags by weak comparison, else the modification times. Its headers are those of
the response, replaced by the permitted ones of the revisit.

Time is cut at quantiles, so that a URL with very many captures is dealt over tasks; the latest response of
earlier cuts is carried over. Ties in time go by record id: the smaller one is earlier. Records with a null URL,
time or id are never targets, and such revisits stay unresolved; so do those without an earlier
response or with no validator in common. Repeated records share their result, but each has its row. Header names
are compared in lower case; fields of one name are joined by ", " in the order of their original names. Columns
beyond those named are left out, whatever their names. Long values are kept whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .runtime import cut, pick

# Header fields that a 304 answer may update, and parameters without meaning.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(?:utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)$"


def canonical_url(url: Column) -> Column:
    u = F.trim(url)
    rest = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^(?i)[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(?:80|443)?$", ""), r"^www\d?\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&", -1)
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _low(headers: Column) -> Column:
    """Header fields by lower-case name; null is none, and fields that differ by case alone are joined."""
    own = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    lowered = F.transform(F.map_keys(own), F.lower)
    fields = F.array_sort(F.map_entries(own))
    names = F.array_distinct(lowered)

    def joined(name: Column) -> Column:
        values = F.transform(F.filter(fields, lambda x: (F.lower(x["key"]) == name) & x["value"].isNotNull()), lambda x: x["value"])
        return F.when(F.size(values) > 0, F.array_join(values, ", "))

    return F.when(F.size(names) == F.size(lowered), F.map_from_arrays(lowered, F.map_values(own))).otherwise(F.map_from_arrays(names, F.transform(names, joined)))


def resolve_revisits(records: DataFrame, *, rows_per_cut: int = 50_000) -> DataFrame:
    """For each revisit: record_id, url (canonical), target_id, status and headers (merged; its own if unresolved).

    records: record_id long, url string, ts long or timestamp, kind (response or revisit), etag,
    last_modified string, headers map<string,string>. status: resolved, no_earlier, mismatch, no_validator or incomplete.
    """
    r = pick(records, "record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    r = r.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "headers")
    fine = F.col("record_id").isNotNull() & F.col("url").isNotNull() & F.col("ts").isNotNull()
    good = cut(r.where(fine & F.col("kind").isin("response", "revisit")))
    n = good.count()
    cuts = min(1024, max(1, n // rows_per_cut))
    bounds = good.select(F.percentile_approx("ts", [i / cuts for i in range(1, cuts)] or [0.5], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]), lambda b: b <= F.col("ts"))) if cuts > 1 else F.lit(0)
    good = good.withColumn("part", part)
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    slim = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))

    inside = Window.partitionBy("url", "part").orderBy("ts", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = good.withColumn("near", F.last(slim, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    across = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = good.groupBy("url", "part").agg(F.max(slim).alias("tail")).withColumn("carry", F.last("tail", ignorenulls=True).over(across)).select("url", "part", "carry")
    found = near.join(carried, ["url", "part"], "left").withColumn("to", F.coalesce("near", "carry")).select("record_id", "url", "etag", "last_modified", "headers", F.col("to.record_id").alias("target_id"))
    targets = good.where("kind = 'response'").groupBy(F.col("record_id").alias("target_id"), F.col("url").alias("u")).agg(F.first(full, ignorenulls=True).alias("t"))
    joined = found.join(targets, (found["target_id"] == targets["target_id"]) & (found["url"] == targets["u"]), "left").drop(targets["target_id"])

    tags = F.col("etag").isNotNull() & F.col("t.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("t.last_modified").isNotNull()
    status = (
        F.when(F.col("target_id").isNull(), "no_earlier")
        .when(tags, F.when(_tag(F.col("etag")) == _tag(F.col("t.etag")), "resolved").otherwise("mismatch"))
        .when(times, F.when(F.trim("last_modified") == F.trim("t.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    joined = joined.withColumn("status", status).withColumn("own", _low(F.col("headers"))).withColumn("theirs", _low(F.col("t.headers")))
    joined = joined.withColumn("update", F.map_filter("own", lambda k, v: k.isin(PERMITTED)))
    kept = F.map_filter("theirs", lambda k, v: ~F.map_contains_key(F.col("update"), k))
    done = F.col("status") == "resolved"
    out = joined.select("record_id", "url", F.when(done, F.col("target_id")).alias("target_id"), "status", F.when(done, F.map_concat(kept, "update")).otherwise(F.col("own")).alias("headers"))
    odd = r.where(~fine & (F.col("kind") == "revisit")).select("record_id", "url", F.lit(None).cast("long").alias("target_id"), F.lit("incomplete").alias("status"), _low(F.col("headers")).alias("headers"))
    return out.unionByName(odd)
