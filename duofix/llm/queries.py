"""The queries op1 to op10 and the pipeline, each over its whole tables with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, lines, lm, neardup, pieces, pii, quality, tokens, topk, warc
from .runtime import table


def _vocabulary(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), digests_only=True)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="duofix").select("doc_id", "n_entities", "text")


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl log of pages: each is fetched once in full and asked for again later, with validators of which some are stale or missing."""
    page, kind = F.col("page_id"), F.col("page_id") % 4
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    full = pages.select(
        (page * 2).alias("record_id"),
        "url",
        (page * 10).alias("ts"),
        F.lit("response").alias("kind"),
        tag.alias("etag"),
        page.cast("string").alias("last_modified"),
        F.create_map(F.lit("ETag"), tag, F.lit("Date"), page.cast("string"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Server"), F.lit("a")).alias("headers"),
    )
    again = pages.select(
        (page * 2 + 1).alias("record_id"),
        "url",
        (page * 10 + 5 + page % 97 * 10).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.when(kind == 0, F.concat(F.lit('"'), F.md5("url"), F.lit('"'))).when(kind == 3, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(kind != 2, page.cast("string")).alias("last_modified"),
        F.create_map(F.lit("date"), (page + 1000).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("server"), F.lit("b")).alias("headers"),
    )
    return full.unionAll(again)


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda k: F.col("headers")[k].alias(f"h_{k.replace('-', '_')}")
    return warc.resolve_revisits(crawl(table(spark, sf_dir, "pages"))).select("record_id", "url", "target_id", "status", *[h(k) for k in ("date", "etag", "content-type", "content-length", "server")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language_model": op3_language_model,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_token_counts": op6_token_counts,
    "op7_pieces": op7_pieces,
    "op8_line_dedup": op8_line_dedup,
    "op9_surrogates": op9_surrogates,
    "op10_revisits": op10_revisits,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = f"regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
with d as (select doc_id, coalesce({_ALNUM}, []) as w from documents),
it as (select item_id, {_ALNUM} as w from benchmark),
size as (select item_id, w, least(10, len(w)) as n from it where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as i from size)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, i, n, item_id from dw join win using (n, g)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join items using (doc_id)""",
    "op2_near_duplicates": f"""
with recursive w as (select doc_id, coalesce({_SPACED}, []) as w from documents),
sh as (select distinct doc_id, array_to_string(case when len(w) < 5 then w else w[i:i + 4] end, ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
inter as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from inter join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
edge as (select x, y from link union select y, x from link),
reach as (select x, y from edge union select r.x, e.y from reach r join edge e on e.x = r.y),
root as (select x as doc_id, min(y) as r from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(r, w.doc_id)) as kept
from w left join n using (doc_id) left join root using (doc_id)""",
    "op5_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= 20""",
    "op8_line_dedup": """
with parts as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
ln as (select doc_id, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from parts),
bad as (select trim(line, ' ') as t, min(doc_id) as first from ln where trim(line, ' ') <> '' group by 1 having count(distinct source) >= 8),
m as (select ln.*, bad.t is not null and ln.doc_id <> bad.first as gone from ln left join bad on trim(ln.line, ' ') = bad.t)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as text_sha256
from m group by doc_id""",
    "op10_revisits": """
with u as (select *, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/@?#]*@)?', '') as rest from pages),
v as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)?$', ''), '^www[0-9]?[.]', '') as host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
    lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)$'))), '&') as q from u),
c as (select page_id, html, host || (case when path = '' then '/' else path end) || (case when q <> '' then '?' || q else '' end) as canon, url from v),
r as (select page_id as p, canon, page_id * 10 as ts, '"' || md5(html) || '"' as tag from c),
a as (select page_id, canon, page_id * 10 + 5 + page_id % 97 * 10 as ts, case page_id % 4 when 0 then '"' || md5(url) || '"' when 3 then '"' || md5(html) || '"' end as tag,
  case when page_id % 4 <> 2 then page_id::varchar end as lm from c),
j as (select a.*, r.p, r.tag as rtag from a asof left join r on a.canon = r.canon and a.ts >= r.ts),
s as (select *, case when p is null then 'no_earlier' when tag is not null then (case when tag = rtag then 'resolved' else 'mismatch' end)
  when lm is not null then (case when lm = p::varchar then 'resolved' else 'mismatch' end) else 'no_validator' end as status from j)
select page_id * 2 + 1 as record_id, canon as url, case when status = 'resolved' then p * 2 end as target_id, status, (page_id + 1000)::varchar as h_date,
  case when status = 'resolved' then rtag end as h_etag, case when status = 'resolved' then 'text/html' end as h_content_type,
  case when status <> 'resolved' then '0' end as h_content_length, case when status = 'resolved' then 'a' else 'b' end as h_server from s""",
}
