"""Queries on the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as fn, sources
from ..estimator import TwoWay
from ..operators import collapse, cut, exact, graph, projection, small_table
from ..spec import PanelSpec

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("w"), F.col("event_type").alias("f"), "value")
    return e.withColumn("fw", F.col("event_id") % 3 + 1).withColumn("tw", F.col("event_id") % 5 + 0.5).withColumn("c1", (F.col("event_id") % 7).cast("double"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("w"), F.col("o_orderpriority").alias("f"), F.log1p(F.col("o_totalprice")).alias("value"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("w"), F.col("l_suppkey").alias("f"), F.log1p("l_extendedprice").alias("value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by suppliers: the large panel of the bench."""
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("w"), F.col("l_suppkey").alias("f"), F.log1p("l_extendedprice").alias("value"))


def _spec(**options) -> PanelSpec:
    """Movers and no centering, but for what the options say."""
    return PanelSpec("value", "w", "f", **{"stayers": "movers", "centering": "none", **options})


r6 = lambda c: F.round(c, 6)


def _estimate(panel: Query, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = TwoWay(_spec(**options)).fit(panel(spark, sf_dir))
        row = [round(float(x), 6) + 0.0 for x in (*r.plugin, *r.bias, r.max_leverage)]
        names = [f"{a}_{b}" for a in ("plugin", "bias") for b in ("worker", "firm", "cov", "total")] + ["max_leverage"]
        return small_table(spark, [tuple(row)], ", ".join(f"{n} double" for n in names))

    return query


def _frozen(panel: Query, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: sources.freeze(panel(s, d), _spec(**options))


def cell_collapse(spark, sf_dir):
    return collapse.cells(_frozen(events, frequency="fw", target="tw")(spark, sf_dir)).select("w", "f", "rows", F.col("n").cast("long").alias("n"), r6("sy").alias("sy"), r6("syy").alias("syy"), r6("t").alias("t"))


def unit_collapse(spark, sf_dir):
    rows = sources.freeze(events(spark, sf_dir).withColumn("u", F.concat_ws("-", "w", "f", F.col("event_id") % 2)), _spec(unit="u"))
    return collapse.units(rows).select("unit", "w", "f", F.col("n").cast("long").alias("n"), r6("y_unit").alias("y_unit"))


def target_strata(spark, sf_dir):
    return collapse.strata(_frozen(events, frequency="fw", target="tw")(spark, sf_dir)).select("w", "f", r6("copy_mass").alias("copy_mass"), F.col("n").cast("long").alias("n"), r6("t").alias("t"))


def mover_stayer(spark, sf_dir):
    return collapse.classify(_frozen(parts)(spark, sf_dir)).select("w", "units", "firms", F.col("physical").cast("long").alias("physical"), "mover")


def sample_complete(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 10 > 0, F.col("value")))
    return sources.freeze(e, _spec(deletion="observation")).groupBy("f").agg(F.count("*").alias("rows"), r6(F.sum("y")).alias("total"))


def components(spark, sf_dir):
    found = graph.components(parts(spark, sf_dir).select("w", "f").distinct())
    return found.groupBy("root").agg(F.min("w").alias("least_worker"), F.countDistinct("w").alias("workers"), F.countDistinct("f").alias("firms"), F.count("*").alias("cells")).drop("root")


def sample_accounting(spark, sf_dir):
    _, facts = graph.select(_frozen(orders, stayers="both")(spark, sf_dir), _spec(stayers="both"))
    keep = ("rows_in", "units_in", "stayers_in", "stayers_added", "rows_out", "units_out", "workers_out", "firms_out")
    return small_table(spark, [(k, int(facts[k])) for k in keep], "step string, count long")


def _cells(spark, sf_dir):
    c = cut(collapse.cells(_frozen(events)(spark, sf_dir)))
    _, firms = exact.index_firms(c, 2000)
    return exact.by_worker(c, firms)


def firm_laplacian(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return exact.laplacian_parts(c).select("i", "j", r6("nn").alias("shared"), F.round("g", 9).alias("g"), F.round("h", 9).alias("h"))


def _fit(spark, sf_dir, **options):
    return TwoWay(_spec(**options)).fit(events(spark, sf_dir))


def firm_effects(spark, sf_dir):
    return _fit(spark, sf_dir).effects("firm").select("f", (r6("psi") + 0.0).alias("psi"))


def worker_effects(spark, sf_dir):
    return _fit(spark, sf_dir).effects("worker").select("w", r6("alpha").alias("alpha"))


def leverage_match(spark, sf_dir):
    r = _fit(spark, sf_dir)
    return r.kernels.join(r.firms, "j").groupBy("f").agg(r6(F.max(F.col("n") * F.col("leverage"))).alias("max_leverage"), r6(F.sum(F.col("n") * F.col("leverage"))).alias("sum_leverage"))


def decomposition(spark, sf_dir):
    d = _fit(spark, sf_dir).decomposition()
    return d.select("component", *[r6(c).alias(c) for c in d.columns if c != "component"])


def outcome_moments(spark, sf_dir):
    m = collapse.outcome_moments(_frozen(events, frequency="fw", target="tw")(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in m.columns])


def midranks(spark, sf_dir):
    d = fn.with_midrank(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity")), "l_quantity")
    return d.select("l_orderkey", "l_linenumber", F.round("midrank", 9).alias("midrank"))


def rank_bins(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").cast("double").alias("l_quantity"))
    return fn.with_rank_bin(li, "l_quantity", "line", 7).select("line", "bin")


def parallel_blocks(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("u", F.concat_ws("-", "w", "f", F.col("event_id") % 2))
    return collapse.parallel_blocks(sources.freeze(e, _spec(unit="u")))


def residual_moments(spark, sf_dir):
    m = _fit(spark, sf_dir, frequency="fw", target="tw").moments()
    return m.select(*[r6(c).alias(c) for c in m.columns])


def _copies(design: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sources.connected_copies(events(spark, sf_dir).select("w", "f", "value"), "w", "f", "value", design, 4)
        return df.groupBy("f").agg(F.count("*").alias("rows"), F.countDistinct("w").alias("workers"))

    return query


def projection_coef(spark, sf_dir):
    p = projection.coefficients(_table(spark, sf_dir, "lineitem").withColumn("v", F.log1p("l_extendedprice")), "v", ["l_discount", "l_tax"], "l_quantity")
    return p.select("term", r6("coefficient").alias("coefficient"))


def component_se(spark, sf_dir):
    t = _fit(spark, sf_dir, centering="mean", inference="highrank").inference()
    return t.select("component", *[r6(c).alias(c) for c in t.columns if c != "component"])


def component_intervals(spark, sf_dir):
    t = _fit(spark, sf_dir, centering="mean").intervals()
    return t.select(*[r6(c).alias(c) if kind == "double" else c for c, kind in t.dtypes])


def projection_cov(spark, sf_dir):
    panel = events(spark, sf_dir).withColumn("x", F.length("f").cast("double"))
    t = TwoWay(_spec(project=("x",), centering="mean")).fit(panel).projection()
    return t.select("term", *[r6(c).alias(c) for c in t.columns if c != "term"])


def true_moments(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    m = sources.true_moments(li, "l_discount", "l_tax", "l_quantity")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def _simulated(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sources.simulate(spark, name)
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in df.dtypes])

    return query


QUERIES: dict[str, Query] = {
    "sample_complete": sample_complete,
    "cell_collapse": cell_collapse,
    "unit_collapse": unit_collapse,
    "target_strata": target_strata,
    "mover_stayer": mover_stayer,
    "components": components,
    "sample_accounting": sample_accounting,
    "firm_laplacian": firm_laplacian,
    "firm_effects": firm_effects,
    "worker_effects": worker_effects,
    "leverage_match": leverage_match,
    "kss_match_none": _estimate(events),
    "kss_match_mean": _estimate(events, centering="mean"),
    "kss_obs": _estimate(events, deletion="observation"),
    "kss_obs_mean": _estimate(events, deletion="observation", centering="mean"),
    "kss_freq_target": _estimate(events, frequency="fw", target="tw"),
    "kss_hybrid": _estimate(orders, stayers="both", centering="mean"),
    "kss_fixed_offset": _estimate(events, controls=("c1",), nuisance="fixed_offset"),
    "kss_joint": _estimate(events, controls=("c1",), centering="mean"),
    "kss_joint_obs": _estimate(events, controls=("c1",), deletion="observation"),
    "kss_centering_corrected": _estimate(events, centering="corrected"),
    "jla_point": _estimate(events, algorithm="jla", probes=64),
    "jla_joint": _estimate(events, algorithm="jla", probes=64, controls=("c1",), centering="mean"),
    "jla_hybrid": _estimate(orders, algorithm="jla", probes=64, stayers="both", centering="mean"),
    "decomposition": decomposition,
    "outcome_moments": outcome_moments,
    "midranks": midranks,
    "rank_bins": rank_bins,
    "parallel_blocks": parallel_blocks,
    "residual_moments": residual_moments,
    "copies_ring": _copies("ring"),
    "copies_replicated_blocks": _copies("replicated_blocks"),
    "projection_coef": projection_coef,
    "component_se": component_se,
    "component_intervals": component_intervals,
    "projection_cov": projection_cov,
    "true_moments": true_moments,
    **{f"simulate_{x}": _simulated(x) for x in ("ex1", "ex2", "ex3", "ex4", "ex5")},
}

_EVENTS = "select user_id as w, event_type as f, value as y, {n} as n, {t} as t from events"
_ORDERS = """select o_custkey as w, o_orderpriority as f, ln(1 + o_totalprice) as y, 1 as n, 1 as t from orders where o_custkey in
 (select o_custkey from orders group by 1 having count(distinct o_orderpriority) > 1 or count(*) > 1)"""

_FIT = """with recursive
obs as ({obs}),
fid as (select f, row_number() over (order by f) as j, count(*) over () as nf from (select distinct f from obs)),
o as (select * from obs join fid using (f)),
K as (select max(nf) - 1 as k from fid),
cell as (select w, j, sum(n)::double as n, sum(n * y) as sy, sum(n * y * y) as syy, sum(t)::double as t from o group by w, j),
wt as (select w, sum(n) as nw, sum(sy) as syw, sum(t) as tw, count(*) as deg from cell group by w),
tot as (select sum(n) as nn, sum(t) as tt, sum(sy) / sum(n) as ybar from cell),
sh as (select cell.w, j, n / nw as p, t / tt as s, nw, tw / tt as sw, n, sy, syy, syw, deg, ybar from cell join wt using (w), tot),
fm as (select j, sum(n) as nf, sum(sy) as syf, sum(s) as sf from sh group by j),
g as (select j, sf from fm where j <= (select k from K)),
ij as (select a.j as i, b.j as j from g a, g b),
pr as (select a.j as i, b.j as j, sum(a.n * b.n / a.nw) as nn, sum(a.sw * a.p * b.p) as gg, sum(a.p * b.s) as hh from sh a join sh b using (w) group by 1, 2),
S as (select ij.i, ij.j, (case when ij.i = ij.j then fm.nf else 0 end) - coalesce(pr.nn, 0) as v, coalesce(gg, 0) as gg, coalesce(hh, 0) as hh
  from ij join fm on fm.j = ij.i left join pr on pr.i = ij.i and pr.j = ij.j),
gj as (
  select 0::bigint as step, i, list(v order by j) || list_transform(range(1, (select k from K) + 1), lambda c: case when c = i then 1.0 else 0.0 end) as r from S group by i
  union all
  select a.step + 1, a.i, case when a.i = a.step + 1 then list_transform(b.r, lambda x: x / b.r[a.step + 1])
    else list_transform(range(1, len(a.r) + 1), lambda c: a.r[c] - a.r[a.step + 1] * b.r[c] / b.r[a.step + 1]) end
  from gj a join gj b on b.i = a.step + 1 and b.step = a.step where a.step < (select k from K)),
inv as (select i, j, r[(select k from K) + j] as v from gj, (select j from g) where step = (select k from K)),
mv as (select j, sum(sw * p) as m from sh where j <= (select k from K) group by j),
rhs as (select fm.j, fm.syf - sum(a.n * a.syw / a.nw) as b from fm join sh a using (j) where fm.j <= (select k from K) group by fm.j, fm.syf),
psi as (select i as j, sum(v * b) as psi from inv join rhs on rhs.j = inv.j group by i),
alpha as (select w, max(syw / nw) - sum(p * coalesce(psi, 0)) as al from sh left join psi using (j) group by w),
fit as (select sh.*, al, coalesce(psi, 0) as psi from sh join alpha using (w) left join psi using (j)),
plug as (select sum(s * al * al) - sum(s * al) ^ 2 as pw, sum(s * psi * psi) - sum(s * psi) ^ 2 as pf, sum(s * al * psi) - sum(s * al) * sum(s * psi) as pc from fit),
r as (select a.w, a.j as cell, g.j, (case when a.j = g.j then 1.0 else 0.0 end) - coalesce(b.p, 0) as r, coalesce(b.s, 0) as s, coalesce(b.p, 0) as p
  from sh a cross join g left join sh b on b.w = a.w and b.j = g.j),
u as (select x.w, x.cell, inv.i as j, sum(inv.v * x.r) as u from r x join inv on inv.j = x.j group by 1, 2, 3),
ur as (select u.w, u.cell, sum(u.u * r.r) as ru, sum(u.u * r.p) as pu, sum(u.u * r.s) as su1, sum(u.u * m) as mu, sum(u.u * sf) as sfu, sum(u.u * u.u * sf) as sfu2
  from u join r on r.w = u.w and r.cell = u.cell and r.j = u.j join mv on mv.j = u.j join g on g.j = u.j group by 1, 2),
q as (select a.w, a.cell, sum(a.u * S.gg * b.u) as ugu, sum(a.u * S.hh * b.u) as uhu from u a join u b on b.w = a.w and b.cell = a.cell join S on S.i = a.j and S.j = b.j group by 1, 2),
kern as (select f.w, f.j, f.n, f.sy, f.syy, al + psi as hat, deg, ybar, 1 / f.nw + ru as h1,
  f.sw / f.nw ^ 2 - 2 * f.sw * pu / f.nw + ugu - (f.sw / f.nw - mu) ^ 2 as qa, sfu2 - sfu ^ 2 as qf, su1 / f.nw - uhu - (f.sw / f.nw - mu) * sfu as qc
  from fit f join ur on ur.w = f.w and ur.cell = f.j join q on q.w = f.w and q.cell = f.j)"""

_BIAS = """,
part as (select *, case when {whole} then n * h1 else h1 end as h,
  case when {whole} then (sy - n * {shift}) * (sy - n * hat) else syy - sy * hat - {shift} * (sy - n * hat) end as e from kern),
cor as (select sum(e * qa / (1 - h)) as cw, sum(e * qf / (1 - h)) as cf, sum(e * qc / (1 - h)) as cc, max(h) as maxlev from part)
"""


def _kss(obs: str, whole: str = "true", shift: str = "0", bias: str = "") -> str:
    return _FIT.format(obs=obs) + (bias or _BIAS.format(whole=whole, shift=shift)) + (
        "select round(pw, 6) as plugin_worker, round(pf, 6) as plugin_firm, round(pc, 6) as plugin_cov, round(pw + pf + 2 * pc, 6) as plugin_total, "
        "round(cw, 6) as bias_worker, round(cf, 6) as bias_firm, round(cc, 6) as bias_cov, round(cw + cf + 2 * cc, 6) as bias_total, round(maxlev, 6) as max_leverage from plug, cor"
    )


_COPIES = """with p as ({pairs}), k as (select min(event_type) as f from events),
e as (select c || ':' || user_id as w, c || ':' || event_type as f from events, range(1, 5) t(c)
  union all select 'link:' || l || ':' || r || ':' || i, case s when 0 then l else r end || ':' || f from p, k, range(1, 3) a(i), range(0, 2) b(s))
select f, count(*) as rows, count(distinct w) as workers from e group by f"""

_CONTROL = """,
zcell as (select w, j, sum(n * z) as sz, sum(n * z * z) as szz, sum(n * z * y) as szy from o group by w, j),
zw as (select w, sum(sz) as szw from zcell group by w),
zrhs as (select j, sum(sz) - sum(p * szw) as b from zcell join sh using (w, j) join zw using (w) group by j),
zpsi as (select i as j, sum(v * b) as zp from inv join zrhs on zrhs.j = inv.j group by i),
zal as (select w, max(szw / nw) - sum(p * coalesce(zp, 0)) as za from sh join zw using (w) left join zpsi using (j) group by w),
zfit as (select sh.w, sh.j, sh.p, sh.s, sh.sw, sh.nw, za, coalesce(zp, 0) as zp, za + coalesce(zp, 0) as zhat from sh join zal using (w) left join zpsi using (j)),
gz as (select sum(szz - 2 * zhat * sz + n * zhat * zhat) as g, sum(szy - zhat * sy - hat * (sz - n * zhat)) / sum(szz - 2 * zhat * sz + n * zhat * zhat) as b from zcell join zfit using (w, j) join kern using (w, j)),
plug2 as (select sum(f.s * (al - b * za) ^ 2) - sum(f.s * (al - b * za)) ^ 2 as pw, sum(f.s * (psi - b * z.zp) ^ 2) - sum(f.s * (psi - b * z.zp)) ^ 2 as pf,
  sum(f.s * (al - b * za) * (psi - b * z.zp)) - sum(f.s * (al - b * za)) * sum(f.s * (psi - b * z.zp)) as pc from fit f join zfit z using (w, j), gz),
zm as (select sum(s * za) as am, sum(s * zp) as pm, sum(s * za * za) - sum(s * za) ^ 2 as m1, sum(s * zp * zp) - sum(s * zp) ^ 2 as m2, sum(s * za * zp) - sum(s * za) * sum(s * zp) as m3 from zfit),
aw as (select w, max(sw * (za - am)) as a1, (sum(s * zp) - max(sw * pm)) / 2 as a3 from zfit, zm group by w),
vr as (select j, -sum(p * a1) as r1, sum(s * (zp - pm)) as r2, (sum(s * za) - sum(s * am)) / 2 - sum(p * a3) as r3 from zfit join aw using (w), zm group by j),
vp as (select i as j, sum(v * r1) as x1, sum(v * r2) as x2, sum(v * r3) as x3 from inv join vr on vr.j = inv.j group by i),
va as (select w, max(a1 / nw) - sum(p * coalesce(x1, 0)) as y1, -sum(p * coalesce(x2, 0)) as y2, max(a3 / nw) - sum(p * coalesce(x3, 0)) as y3 from zfit join aw using (w) left join vp using (j) group by w),
cell2 as (select k.*, sz, szz, szy, zhat, g, b, m1, m2, m3, hat - b * zhat as hato, y1 + coalesce(x1, 0) as v1, y2 + coalesce(x2, 0) as v2, y3 + coalesce(x3, 0) as v3, {shift} as c
  from kern k join zcell using (w, j) join zfit using (w, j) join va using (w) left join vp using (j), gz, zm)"""
_OFFSET_BIAS = """,
part as (select *, n * h1 as h, (sy - b * sz) * (sy - b * sz - n * hato) / (1 - n * h1) as e from cell2),
cor as (select sum(e * qa) as cw, sum(e * qf) as cf, sum(e * qc) as cc, max(h) as maxlev from part) """
_JOINT_BIAS = """,
sums as (select *, sz - n * zhat as zt, (szz - 2 * zhat * sz + n * zhat * zhat) / g as tt, sy - n * c as uy, szy - zhat * sy - c * (sz - n * zhat) as zy, sy - b * sz - n * hato as ue,
  szy - b * szz - hato * sz - zhat * (sy - b * sz - n * hato) as ze from cell2),
sol as (select *, ((1 - tt) * ue + zt / g * ze) / ((1 - n * h1) * (1 - tt) - zt * zt * h1 / g) as x0, (zt * h1 * ue + (1 - n * h1) * ze) / ((1 - n * h1) * (1 - tt) - zt * zt * h1 / g) as x1 from sums),
cor as (select sum(uy * (qa * x0 - v1 / g * x1) + zy * (m1 / g / g * x1 - v1 / g * x0)) as cw, sum(uy * (qf * x0 - v2 / g * x1) + zy * (m2 / g / g * x1 - v2 / g * x0)) as cf,
  sum(uy * (qc * x0 - v3 / g * x1) + zy * (m3 / g / g * x1 - v3 / g * x0)) as cc, max((n * h1 + tt + sqrt((n * h1 - tt) ^ 2 + 4 * zt * zt * h1 / g)) / 2) as maxlev from sol) """
_JOINT_OBS_BIAS = """,
part as (select cell2.*, o.n as k, (o.z - zhat) / g as d, h1 + (o.z - zhat) ^ 2 / g as h, o.n * (o.y - c) * (o.y - b * o.z - hato) / (1 - h1 - (o.z - zhat) ^ 2 / g) as e from o join cell2 using (w, j)),
cor as (select sum(e * (qa - 2 * v1 * d + m1 * d * d)) as cw, sum(e * (qf - 2 * v2 * d + m2 * d * d)) as cf, sum(e * (qc - 2 * v3 * d + m3 * d * d)) as cc, max(h) as maxlev from part) """


def _controlled(bias: str, shift: str = "0") -> str:
    obs = _PLAIN.replace(" from events", ", (event_id % 7)::double as z from events")
    return _kss(obs, bias=_CONTROL.format(shift=shift) + bias).replace("from plug, cor", "from plug2, cor")


def _draw(*parts: str) -> str:
    """SQL of functions.normal: the parts are SQL of text or whole numbers."""
    text = "concat_ws(':', " + ", ".join(parts) + ")"
    u, v = (f"((('0x' || substr(md5({text}), {1 + 7 * k}, 7))::bigint + 0.5::double) / 268435456)" for k in (0, 1))
    return f"(sqrt(-2 * ln({u})) * cos(6.283185307179586::double * {v}))"


def _whole(columns: str, doubles: str, rest: str) -> str:
    parts = [*(f"{c}::bigint as {c}" for c in columns.split()), *(f"round({c}::double, 6) + 0 as {c}" for c in doubles.split())]
    return f"select {', '.join(parts)} from {rest}"


def _jobs(workers: int, firms: int, seed: int) -> str:
    at = f"(worker_id - 1 + ({{}} - 1) * (1 + ('0x' || substr(md5('{seed}:step:' || worker_id), 1, 7))::bigint % {firms - 1})) % {firms} + 1"
    premium = lambda f: _draw(f"'{seed}'", "'firm'", f)
    cell = ("worker_id", "spell", "period")
    inner = f"""(select *, worker_id * 10 + spell as match_id, {premium("firm_id")} as firm_fe, 0.5 * ({premium("f1")} + {premium("f2")} + {premium("f3")}) / 3 + {_draw(f"'{seed}'", "'worker'", "worker_id")} as worker_fe,
  {_draw(f"'{seed}'", "'productivity'", *cell)} as productivity, 3 * {_draw(f"'{seed}'", "'error'", *cell)} as error
  from (select *, {at.format("spell")} as firm_id, {at.format(1)} as f1, {at.format(2)} as f2, {at.format(3)} as f3
    from (select i // 6 + 1 as worker_id, i % 6 // 2 + 1 as spell, i % 2 + 1 as period from range({workers * 6}) t(i))))"""
    return _whole("worker_id spell period firm_id match_id", "firm_fe worker_fe productivity error log_wage", f"(select *, 2 + worker_fe + firm_fe + 0.30::double * productivity + case when period = 2 then 0.15::double else 0 end + error as log_wage from {inner})")


_EX3 = f"""(select *, 2 + worker_fe + firm_fe + 0.35::double * productivity + error as log_wage from (select *, {_draw("'ex3'", "'worker'", "worker_id")} as worker_fe, 0.6::double * {_draw("'ex3'", "'firm'", "firm_id")} as firm_fe,
  {_draw("'ex3'", "'productivity'", "match_id")} as productivity, 0.45::double * {_draw("'ex3'", "'error'", "match_id")} as error from (select *, (worker_id - 1 + case spell when 1 then 0 when 2 then 1 else 7 end) % 15 + 1 as firm_id,
  worker_id * 10 + spell as match_id, 1 + (worker_id + spell) % 3 as frequency, 1 + spell / 2.0 as target_mass from (select i // 3 + 1 as worker_id, i % 3 + 1 as spell from range(180) t(i)))))"""
_EX4 = f"""(select *, 2 + worker_fe + firm_fe + error as log_wage from (select *, ln(firm_size) as log_firm_size, 0.5::double * ln(firm_size) as firm_fe, 0.4::double * {_draw("'ex4'", "'worker'", "worker_id")} as worker_fe,
  0.15::double * {_draw("'ex4'", "'error'", "worker_id", "year")} as error from (select *, (count(*) over (partition by firm_id))::double / 4 as firm_size from (select worker_id, year, case when year <= 2 then o else o % 10 + 1 end as firm_id
  from (select w as worker_id, y as year, case when w <= 10 then w else ceil(sqrt(w - 10))::bigint end as o from range(1, 111) a(w), range(1, 5) b(y))))))"""
_EX5 = f"""(select *, 1.5::double + worker_fe + firm_fe + 0.4::double * productivity - 0.15::double * policy + error as log_wage from (select i // 4 as worker_id, i % 4 as period, ({sources.EX5_FIRMS})[i + 1] as firm_id, ({sources.EX5_ERRORS})[i + 1]::double as error,
  i % 4 - 1.5 as productivity, case when i % 4 = 2 then 1 else 0 end as policy, 0.3::double * (i // 4) as worker_fe, -0.2::double * ({sources.EX5_FIRMS})[i + 1] as firm_fe from range(24) t(i)))"""

_PLAIN = _EVENTS.format(n=1, t=1)
_WEIGHTED = _EVENTS.format(n="event_id % 3 + 1", t="(event_id % 5 + 0.5)::double")
ORACLES: dict[str, str] = {
    "simulate_ex1": _jobs(10_000, 3001, 20260821),
    "simulate_ex2": _jobs(200, 61, 20260820),
    "simulate_ex3": _whole("worker_id spell firm_id match_id frequency", "target_mass worker_fe firm_fe productivity error log_wage", _EX3),
    "simulate_ex4": _whole("worker_id year firm_id", "firm_size log_firm_size worker_fe firm_fe error log_wage", _EX4),
    "simulate_ex5": _whole("worker_id period firm_id", "error productivity policy worker_fe firm_fe log_wage", _EX5),
    "sample_complete": "select event_type as f, count(*) as rows, round(sum(value), 6) as total from events where event_id % 10 > 0 group by 1",
    "cell_collapse": f"select w, f, count(*) as rows, sum(n)::bigint as n, round(sum(n * y), 6) as sy, round(sum(n * y * y), 6) as syy, round(sum(t), 6) as t from ({_WEIGHTED}) group by w, f",
    "unit_collapse": "select concat_ws('-', user_id, event_type, event_id % 2) as unit, user_id as w, event_type as f, count(*) as n, round(sum(value) / sqrt(count(*)), 6) as y_unit from events group by 1, 2, 3",
    "target_strata": f"select w, f, round(t / n, 6) as copy_mass, sum(n)::bigint as n, round(sum(t), 6) as t from ({_WEIGHTED}) group by w, f, t / n",
    "mover_stayer": "select l_partkey as w, count(distinct l_suppkey) as units, count(distinct l_suppkey) as firms, count(*) as physical, count(distinct l_suppkey) > 1 as mover from lineitem group by 1",
    "components": """with recursive e as (select distinct l_partkey as w, l_suppkey as f from lineitem),
step as (
  select w, w as root, true as go from (select distinct w from e)
  union all
  select w, new, bool_or(new < old) over () from (
    select e.w, min(s.root) as old, min(m.root) as new from step s join e on e.w = s.w
      join (select f, min(root) as root from step join e using (w) where go group by f) m on m.f = e.f where s.go group by e.w)),
root as (select w, min(root) as least_worker from step group by w)
select least_worker, count(distinct w) as workers, count(distinct f) as firms, count(*) as cells from e join root using (w) group by 1""",
    "sample_accounting": """with c as (select o_custkey as w, o_orderpriority as f, count(*) as n from orders group by 1, 2), w as (select w, count(*) as k, sum(n) as n from c group by 1),
m as (select * from c where w in (select w from w where k > 1)), s as (select * from c where w in (select w from w where k = 1 and n > 1) and f in (select f from m)), o as (select * from m union all select * from s)
select 'rows_in' as step, sum(n)::bigint as count from c union all select 'units_in', count(*) from c union all select 'stayers_in', count(*) from w where k = 1 union all select 'stayers_added', count(*) from s
union all select 'rows_out', sum(n)::bigint from o union all select 'units_out', count(*) from o union all select 'workers_out', count(distinct w) from o union all select 'firms_out', count(distinct f) from o""",
    "firm_laplacian": _FIT.format(obs=_PLAIN) + " select (i - 1)::int as i, (j - 1)::int as j, round(nn, 6) as shared, round(gg, 9) as g, round(hh, 9) as h from pr",
    "firm_effects": _FIT.format(obs=_PLAIN) + " select distinct f, round(psi, 6) as psi from fit join fid using (j)",
    "worker_effects": _FIT.format(obs=_PLAIN) + " select w, round(al, 6) as alpha from alpha",
    "leverage_match": _FIT.format(obs=_PLAIN) + " select f, round(max(n * h1), 6) as max_leverage, round(sum(n * h1), 6) as sum_leverage from kern join fid using (j) group by f",
    "kss_match_none": _kss(_PLAIN),
    "kss_match_mean": _kss(_PLAIN, shift="ybar"),
    "kss_obs": _kss(_PLAIN, whole="false"),
    "kss_obs_mean": _kss(_PLAIN, whole="false", shift="ybar"),
    "kss_freq_target": _kss(_WEIGHTED),
    "kss_fixed_offset": _controlled(_OFFSET_BIAS),
    "kss_joint": _controlled(_JOINT_BIAS, "ybar"),
    "kss_joint_obs": _controlled(_JOINT_OBS_BIAS),
    "projection_cov": _FIT.format(obs=_PLAIN) + """,
xs as (select fm.j, fm.nf, length(f)::double as x from fm join fid using (j)),
g2 as (select sum(nf) as a, sum(nf * x) as b, sum(nf * x * x) as c from xs),
ld as (select j, nf * (c - b * x) / (a * c - b * b) as l0, nf * (a * x - b) / (a * c - b * b) as l1 from xs, g2),
lp as (select i as j, sum(v * l0) as q0, sum(v * l1) as q1 from inv join ld on ld.j = inv.j group by i),
la as (select w, sum(p * coalesce(q0, 0)) as w0, sum(p * coalesce(q1, 0)) as w1 from sh left join lp using (j) group by w),
cc as (select n, coalesce(q0, 0) - w0 as c0, coalesce(q1, 0) - w1 as c1, (sy - n * ybar) * (sy - n * hat) / (1 - n * h1) as pr, (sy - n * hat) ^ 2 as e2 from kern join la using (w) left join lp using (j)),
co as (select sum(l0 * coalesce(psi, 0)) as b0, sum(l1 * coalesce(psi, 0)) as b1 from ld left join psi using (j)),
va as (select sum(c0 * c0 * pr) as r0, sum(c1 * c1 * pr) as r1, sum(c0 * c0 * e2) as n0, sum(c1 * c1 * e2) as n1 from cc)
select 'constant' as term, round(b0, 6) as coefficient, round(sqrt(r0), 6) as se, round(sqrt(n0), 6) as naive_se from co, va
union all select 'x', round(b1, 6), round(sqrt(r1), 6), round(sqrt(n1), 6) from co, va""",
    "kss_hybrid": _kss(_ORDERS, whole="deg > 1", shift="ybar"),
    "decomposition": _FIT.format(obs=_PLAIN) + _BIAS.format(whole="true", shift="0") + """,
v as (select avg(y * y) - avg(y) ^ 2 as var from obs),
x as (select 'worker' as component, pw as a, cw as b from plug, cor union all select 'firm', pf, cf from plug, cor union all select 'sorting', 2 * pc, 2 * cc from plug, cor union all select 'total', pw + pf + 2 * pc, cw + cf + 2 * cc from plug, cor),
z as (select a, b from x where component = 'total')
select component, round(x.a, 6) as plugin, round(x.a / z.a, 6) as plugin_share, round(x.a / var, 6) as plugin_outcome_share, round(x.b, 6) as bias, round(x.a - x.b, 6) as corrected,
  round((x.a - x.b) / (z.a - z.b), 6) as corrected_share, round((x.a - x.b) / var, 6) as corrected_outcome_share from x, z, v""",
    "outcome_moments": f"""with o as ({_WEIGHTED}), u as (select sum(n)::double as n from o group by w, f)
select round(sum(n * y * y) / sum(n) - (sum(n * y) / sum(n)) ^ 2, 6) as frequency_variance, round(sum(t * y * y) / sum(t) - (sum(t * y) / sum(t)) ^ 2, 6) as target_variance,
  (select round(sum(n) ^ 2 / sum(n * n), 6) from u) as effective_units, (select round(max(n) / sum(n), 6) from u) as largest_share from o""",
    "midranks": """select l_orderkey, l_linenumber, round((2 * rank() over (order by l_quantity) + count(*) over (partition by l_quantity) - 2) / (count(*) over ())::double - 1, 9) as midrank from lineitem""",
    "rank_bins": """select l_orderkey * 10 + l_linenumber as line, (row_number() over (order by l_quantity, l_orderkey * 10 + l_linenumber) - 1) * 7 // count(*) over () + 1 as bin from lineitem""",
    "parallel_blocks": """with c as (select user_id as w, event_type as f, count(distinct event_id % 2) as units, count(*) as rows from events group by 1, 2)
select w, f, units, rows from c where units > 1""",
    "residual_moments": _FIT.format(obs=_WEIGHTED) + """
select round(sum(n * y * y) / sum(n) - (sum(n * y) / sum(n)) ^ 2, 6) as regression_outcome_variance, round(sum(t * y * y) / sum(t) - (sum(t * y) / sum(t)) ^ 2, 6) as target_outcome_variance,
  round((select sum(syy - 2 * (al + psi) * sy + n * (al + psi) ^ 2) / sum(n) from fit), 6) as residual_variance,
  round(sum(n * y * y) / sum(n) - (sum(n * y) / sum(n)) ^ 2 - (select sum(syy - 2 * (al + psi) * sy + n * (al + psi) ^ 2) / sum(n) from fit), 6) as explained_variance,
  round(1 - (select sum(syy - 2 * (al + psi) * sy + n * (al + psi) ^ 2) / sum(n) from fit) / (sum(n * y * y) / sum(n) - (sum(n * y) / sum(n)) ^ 2), 6) as explained_share from obs""",
    "copies_ring": _COPIES.format(pairs="select a as l, a % 4 + 1 as r from range(1, 5) t(a)"),
    "copies_replicated_blocks": _COPIES.format(pairs="select a as l, b as r from range(1, 5) t(a), range(1, 5) s(b) where a < b"),
    "projection_coef": """with s as (select ln(1 + l_extendedprice) as y, l_discount::double as a, l_tax::double as b, l_quantity::double as w from lineitem),
m as (select sum(w * y) / sum(w) as y, sum(w * a) / sum(w) as a, sum(w * b) / sum(w) as b from s),
c as (select sum(w * (s.a - m.a) ^ 2) as aa, sum(w * (s.b - m.b) ^ 2) as bb, sum(w * (s.a - m.a) * (s.b - m.b)) as ab, sum(w * (s.a - m.a) * (s.y - m.y)) as ay, sum(w * (s.b - m.b) * (s.y - m.y)) as bys from s, m),
k as (select (bb * ay - ab * bys) / (aa * bb - ab * ab) as ca, (aa * bys - ab * ay) / (aa * bb - ab * ab) as cb from c)
select 'constant' as term, round(y - ca * a - cb * b, 6) as coefficient from m, k union all select 'l_discount', round(ca, 6) from k union all select 'l_tax', round(cb, 6) from k""",
    "true_moments": """with s as (select l_discount::double as a, l_tax::double as p, l_quantity::double as m from lineitem),
v as (select sum(m * a * a) / sum(m) - (sum(m * a) / sum(m)) ^ 2 as w, sum(m * p * p) / sum(m) - (sum(m * p) / sum(m)) ^ 2 as f, sum(m * a * p) / sum(m) - sum(m * a) * sum(m * p) / sum(m) ^ 2 as c from s)
select round(w, 9) as worker_variance, round(f, 9) as firm_variance, round(c, 9) as worker_firm_covariance, round(w + f + 2 * c, 9) as total_variance from v""",
}
