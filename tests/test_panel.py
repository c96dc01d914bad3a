import random
import tracemalloc
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import dense
from pyspark.sql import functions as F

from duofix import functions as fn, report, sources, spec as options_
from duofix.estimator import TwoWay
from duofix.operators import cut, exact, firmwise, graph, inference, jla, leading, numerical
from duofix.plans.queries import QUERIES
from duofix.spec import Withheld


def PanelSpec(*roles, **options):
    """Movers and no centering, but for what the options say."""
    return options_.PanelSpec(*roles, **{"stayers": "movers", "centering": "none", **options})


# A small panel and known results for it.
FIRM = [0, 0, 1, 1, 0, 2, 2, 1, 1, 2, 3, 3, 2, 3, 0, 0, 3, 1, 1, 2, 3, 3, 2, 0]
MATCH = [10, 10, 11, 11, 20, 21, 21, 22, 30, 31, 32, 32, 40, 41, 42, 42, 50, 51, 51, 52, 60, 60, 61, 62]
NOISE = [0.2, -0.1, 0.1, -0.2, -0.2, 0.3, -0.1, 0.1, 0.1, -0.2, 0.2, -0.1, -0.1, 0.2, -0.2, 0.1, 0.3, -0.2, 0.1, -0.2, -0.2, 0.1, 0.2, -0.1]
PLUGIN = (0.23886949630417731, 0.029429019126843384, -0.026942626261056212, 0.21441326290890825)
JOINT = (-0.01925012, -0.00784379, -0.00434937, -0.03579264)
OFFSET = (-0.00467505214166742, 0.00105611329461117, -0.0074400408799687, -0.01849902060699364)


def panel(spark):
    rows = []
    for i in range(24):
        w, t = divmod(i, 4)
        c1, c2 = t - 1.5, float(t == 2)
        rows.append((w, f"f{FIRM[i]}", MATCH[i], c1, c2, 1.5 + 0.3 * w - 0.2 * FIRM[i] + 0.4 * c1 - 0.15 * c2 + NOISE[i], i % 2 + 1, 0.5 + i / 24))
    return rows, spark.createDataFrame(rows, "worker long, firm string, m long, c1 double, c2 double, y double, fw int, tw double")


def test_known_values_with_fixed_offset(spark):
    r = TwoWay(PanelSpec("y", "worker", "firm", unit="m", controls=("c1", "c2"), nuisance="fixed_offset")).fit(panel(spark)[1])
    assert r.plugin == pytest.approx(PLUGIN, abs=1e-10) and r.bias == pytest.approx(OFFSET, abs=1e-10)
    got = {x.row: x for x in r.results().collect()}
    assert got["corrected"].total_variance == pytest.approx(PLUGIN[3] - OFFSET[3])
    assert [x.component for x in r.decomposition().collect()] == ["worker", "firm", "sorting", "total"]


@pytest.mark.parametrize("deletion", ["match", "observation"])
@pytest.mark.parametrize("centering", ["none", "mean"])
def test_weights_equal_the_dense_estimator(spark, deletion, centering):
    rows, df = panel(spark)
    spec = PanelSpec("y", "worker", "firm", unit="m", frequency="fw", target="tw", deletion=deletion, centering=centering)
    r = TwoWay(spec).fit(df)
    want = dense([x[5] for x in rows], [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], [x[6] for x in rows], [x[7] for x in rows], deletion, centering)
    assert r.plugin == pytest.approx(want[0], abs=1e-10) and r.bias == pytest.approx(want[1], abs=1e-10)


def test_known_values_with_joint_controls(spark):
    r = TwoWay(PanelSpec("y", "worker", "firm", unit="m", controls=("c1", "c2"))).fit(panel(spark)[1])
    assert r.plugin == pytest.approx(PLUGIN, abs=1e-10) and r.bias == pytest.approx(JOINT, abs=1e-8)


@pytest.mark.parametrize("deletion", ["match", "observation"])
def test_joint_controls_equal_the_dense_estimator(spark, deletion):
    rows, df = panel(spark)
    spec = PanelSpec("y", "worker", "firm", unit="m", frequency="fw", target="tw", deletion=deletion, centering="mean", controls=("c1", "c2"))
    r = TwoWay(spec).fit(df)
    want = dense([x[5] for x in rows], [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], [x[6] for x in rows], [x[7] for x in rows], deletion, "mean", [x[3:5] for x in rows], joint=True)
    assert r.plugin == pytest.approx(want[0], abs=1e-10) and r.bias == pytest.approx(want[1], abs=1e-10)


@pytest.mark.parametrize("options", [{}, {"deletion": "observation"}, {"stayers": "both", "centering": "mean", "frequency": "frequency", "target": "target_mass"}, {"controls": ("productivity", "spell"), "centering": "mean"}, {"controls": ("productivity",), "deletion": "observation", "frequency": "frequency"}])
def test_random_probes_come_near_the_exact_correction(spark, options):
    df = sources.simulate(spark, "ex3")
    spec = PanelSpec("log_wage", "worker_id", "firm_id", **options)
    want = TwoWay(spec).fit(df)
    got = TwoWay(replace(spec, algorithm="jla", probes=600)).fit(df)
    assert got.plugin == pytest.approx(want.plugin, abs=1e-9)
    for a, b, e in zip(got.bias, want.bias, got.mcse, strict=True):
        assert e > 0 and abs(a - b) < 5 * e + 0.02 * abs(b)


def test_conjugate_gradients_equal_the_dense_solver_and_partitions_do_not_matter(spark):
    df = sources.simulate(spark, "ex3").withColumn("spell2", (F.col("spell") * F.col("worker_id") % 5).cast("double"))
    spec = PanelSpec("log_wage", "worker_id", "firm_id", algorithm="jla", probes=8, controls=("spell2",), nuisance="fixed_offset")
    a = TwoWay(spec).fit(df)
    b = TwoWay(replace(spec, exact_limit=1)).fit(df.repartition(7))
    c = TwoWay(replace(spec, firm_cells=60)).fit(df)
    for x in (b, c):
        assert x.plugin == pytest.approx(a.plugin, rel=1e-7) and x.bias == pytest.approx(a.bias, rel=1e-6)


def dense_kernels(u, centre):
    """(B of the three targets, residual maker, centring) of units, as dense matrices."""
    w, j = (np.unique(u[c], return_inverse=True)[1] for c in ("w", "j"))
    n, root = u["n"].to_numpy(), np.sqrt(u["n"].to_numpy())
    x = np.hstack([np.eye(w.max() + 1)[w], np.eye(j.max() + 1)[j][:, :-1]])
    a = np.linalg.inv(x.T @ (n[:, None] * x))
    s = u["s"].to_numpy()
    c = np.diag(s) - np.outer(s, s)
    d, f = x.copy(), x.copy()
    d[:, w.max() + 1 :], f[:, : w.max() + 1] = 0, 0
    xs = root[:, None] * x
    m = np.eye(len(n)) - xs @ a @ xs.T
    centring = np.eye(len(n)) - (np.outer(root, root) / n.sum() if centre else 0)
    return [xs @ a @ q @ a @ xs.T for q in (d.T @ c @ d, f.T @ c @ f, (d.T @ c @ f + f.T @ c @ d) / 2)], m, centring


def dense_covariance(u, centre, r):
    """The covariance of operators/inference.py from dense matrices, with the exact trace."""
    b3, m, centring = dense_kernels(u, centre)
    ks = []
    for b in b3:
        ratio = np.diag(b) / np.diag(m)
        ks.append(centring @ (b - (ratio[:, None] * m + m * ratio[None, :]) / 2) @ centring)
    y, v = u["y"].to_numpy(), u["v"].to_numpy()
    g = [k @ y for k in ks]
    trace = [[np.trace(p @ np.diag(v) @ q @ np.diag(v)) for q in ks] for p in ks]
    return [y @ k @ y for k in ks], np.array([[4 * np.sum(v * p * q) for q in g] for p in g]), np.array(trace)


OPTIONS = [{"centering": "mean"}, {"deletion": "observation"}, {"stayers": "both", "frequency": "frequency", "target": "target_mass", "centering": "mean"}]


def inference_panel(spark, options):
    """ex3, with stayers or more copies where the options ask for them."""
    df = sources.simulate(spark, "ex3")
    if options.get("stayers"):
        more = df.where("spell = 1").withColumn("worker_id", F.col("worker_id") + 1000).withColumn("frequency", F.lit(2))
        df = df.unionByName(more).unionByName(more.withColumn("log_wage", F.col("log_wage") + 0.1 * (F.col("worker_id") % 4)))
    if options.get("deletion"):
        df = df.unionByName(df.where("worker_id % 2 = 0").withColumn("log_wage", F.col("log_wage") + 0.1 * (F.col("worker_id") % 3)))
    return df


@pytest.mark.parametrize("options", OPTIONS)
def test_leading_directions_equal_dense_eigenvectors(spark, options):
    spec = PanelSpec("log_wage", "worker_id", "firm_id", inference_draws=60, **options)
    r = TwoWay(spec).fit(inference_panel(spark, options))
    mean = r._mean()
    at, lead = leading.directions(r.kernels, r.solver, spec, 1e-7, 400)
    assert lead.converged.all()
    u = cut(leading.attach(inference.variances(inference.units(r.rows, r.kernels, r.firms, spec, mean))[0], at, lead))
    found, c = inference.images(u, r.solver, spec, lead.value)
    found = found.join(u.select("key", "y", "product", "w1", "w2", "w3", "w4"), "key")
    got = leading.scalars(found, c, lead, np.zeros(4), np.eye(3))
    t = u.toPandas().sort_values("key")
    b3, m, centring = dense_kernels(t, "centering" in options)
    y, v, h = (t[x].to_numpy() for x in ("y", "v", "h"))
    for i, b in enumerate((*b3, b3[0] + b3[1] + 2 * b3[2])):
        size = np.abs(np.linalg.eigvalsh(b))
        w = t[f"w{i + 1}"].to_numpy()
        assert size.max() == pytest.approx(abs(lead.value[i]), rel=1e-8) and w @ w == pytest.approx(1) and np.allclose(b @ w, lead.value[i] * w, atol=1e-6 * size.max())
        rest = b - lead.value[i] * np.outer(w, w)
        ratio = np.diag(rest) / (1 - h)
        k = centring @ (rest - (ratio[:, None] * m + m * ratio[None, :]) / 2) @ centring
        g = k @ y
        x = got[i]
        assert (x["score"], x["direct"]) == pytest.approx((w @ y, y @ g), abs=1e-9) and x["fitted"] == pytest.approx(np.sum(w * w * v))
        assert (x["linear"], x["covariance"]) == pytest.approx((4 * np.sum(v * g * g), 2 * np.sum(w * v * g)), rel=1e-7, abs=1e-12)
        trace = np.trace(k @ np.diag(v) @ k @ np.diag(v))
        assert abs(x["trace"] / (c - 1) - trace) < 0.7 * trace


def test_pair_terms_of_remainders_by_hand(spark):
    """One cell of a mover and one of a stayer, three copies each."""
    rows = [(w, 0, False, 3, 0.5, w == 1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, *[0.01 * t for t in range(4)], *[0.2 + 0.1 * t for t in range(4)]) for w in (1, 2) for _ in range(3)]
    names = "w j whole size sample cell_mover r1 r2 r3 d1 d2 d3 q1 q2 q3 q4 w1 w2 w3 w4".split()
    u = spark.createDataFrame(rows, names)
    lam = np.array([0.5, 0.25, 0.1, 0.2])
    ratio, worker = (0.1, 0.2, 0.3, 0.9), (0.4, 0, 0, 0.4)
    scale = 4 * 0.5**2 * (3 - 2) * (3 - 1) / (3 + 1)
    want = [scale * ((ratio[t] - 0.01 * t) ** 2 + ((worker[t] - lam[t] * (0.2 + 0.1 * t) ** 2) * 3 / 2) ** 2) for t in range(4)]
    assert leading.pairs(u, leading.Leading(lam, lam, lam, lam > 0, 1)) == pytest.approx(want)


def test_interval_of_a_curved_map():
    assert leading.critical(0, 95, 1) == pytest.approx(1.96, abs=0.02) and leading.critical(1e6, 95, 1) == pytest.approx(2.448, abs=0.02)
    assert 1.96 < leading.critical(1.0, 95, 1) < 2.448
    for seed in range(40):
        r = np.random.default_rng(seed)
        root = np.tril(r.standard_normal((2, 2)))
        root[[0, 1], [0, 1]] = np.abs(root[[0, 1], [0, 1]]) + 0.05
        b, theta, lam, radius = *r.standard_normal(2), 3 * r.standard_normal(), 1 + r.random()
        a = np.linspace(-np.pi, np.pi, 1_000_001)
        x, z = np.array([[b], [theta]]) + radius * root @ np.array([np.cos(a), np.sin(a)])
        f = lam * x * x + z
        assert leading.extremes(b, theta, root @ root.T, radius, lam) == pytest.approx((f.min(), f.max()), abs=1e-9)
    assert leading.interval({"variance": 1.0, "remainder": -1.0, "covariance": 0.0, "value": 1.0}, 95, 1) == {"status": 1}
    assert leading.interval({"variance": 1.0, "remainder": 1.0, "covariance": 1.0, "value": 1.0}, 95, 1) == {"status": 2}


def test_the_rule_of_intervals():
    lead = leading.Leading(np.ones(4), np.zeros(4), np.zeros(4), np.ones(4, bool), 1)
    x = {"score": 3.0, "variance": 1.0, "remainder": 1.0, "covariance": 0.1, "value": 0.5, "theta": 1.0, "point": 5.0, "eigen_share": 0.5, "max_weight": 0.2}
    rows = lambda v, **o: [dict(zip([c.split()[0] for c in leading.SCHEMA.split(", ")], a, strict=True)) for a in leading.table((5.0,) * 4, np.diag(v), [x] * 4, lead, PanelSpec("y", "w", "f", **o))]
    share = 4 * 0.25 * 8 + 2 * 0.25
    got = rows([share / 0.2, share / 0.05, -1.0, share / 0.2])
    assert [a["regime"] for a in got] == ["q1", "normal", "q1", "normal"] and got[0]["variance_share"] == pytest.approx(0.2)
    assert got[2]["highrank_se"] is None and got[2]["lower"] == got[2]["q1_lower"] < 5 < got[2]["q1_upper"]
    assert [a["regime"] for a in rows([1.0] * 4, inference="q1")] == ["q1"] * 4
    x["remainder"] = -1.0
    got = rows([1.0, -1.0, 1.0, 1.0], inference="q1")
    assert [a["regime"] for a in got] == ["normal", None, "normal", "normal"] and {a["q1_status"] for a in got} == {"nonpositive_variance"}


def test_a_leading_direction_withholds_the_joint_covariance(spark):
    r = TwoWay(PanelSpec("log_wage", "worker_id", "firm_id", centering="mean", inference="q1")).fit(sources.simulate(spark, "ex4"))
    t = {x.component: x for x in r.intervals().collect()}
    assert t["firm_variance"].regime == "q1" and t["firm_variance"].lower < t["firm_variance"].estimate < t["firm_variance"].upper
    with pytest.raises(Withheld, match="INTERVALS_NOT_NORMAL"):
        r.lincom((1, 0, 0, 0))
    r.spec = replace(r.spec, inference="none")
    del r._sampling
    with pytest.raises(Withheld, match="INVALID_OPTION"):
        r.inference()


@pytest.mark.parametrize("options", OPTIONS)
def test_standard_errors_equal_dense_kernels(spark, options):
    spec = PanelSpec("log_wage", "worker_id", "firm_id", inference_draws=60, inference="highrank", **options)
    r = TwoWay(spec).fit(inference_panel(spark, options))
    mean = r.rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0] if "centering" in options else 0.0
    u, pair = inference.variances(inference.units(r.rows, r.kernels, r.firms, spec, mean))
    u = u.toPandas().sort_values("key")
    assert (u["v"] > 0).all() and (pair[0, 0] > 0) == ("stayers" in options)
    point, linear, trace = dense_covariance(u, "centering" in options, r)
    assert point == pytest.approx(r.corrected[:3], abs=1e-9)
    want, got = linear - 2 * trace + pair, r.covariance
    assert np.allclose(got[:3, :3], want, atol=0.5 * np.abs(trace).max())
    size = np.sqrt(np.outer(np.diag(trace), np.diag(trace)))
    assert (np.abs(got[:3, :3] - want) < 1.0 * size).all()
    t = r.inference().collect()
    assert [x.component for x in t][3] == "total_variance" and all(x.se is None or x.lower < x.estimate < x.upper for x in t)
    assert r.lincom((1, 1, 2, -1))[0] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("effect", ["worker", "firm"])
def test_projection_equals_the_dense_regression(spark, effect):
    spec = PanelSpec("log_wage", "worker_id", "firm_id", frequency="frequency", target="target_mass", project=("size",), project_effect=effect, project_weight="target", centering="mean")
    r = TwoWay(spec).fit(sources.simulate(spark, "ex3").withColumn("size", F.col("firm_id") * F.col("frequency") * 1.0))
    rows = r.rows.toPandas()
    w, f = (np.unique(rows[c], return_inverse=True)[1] for c in ("w", "f"))
    d, ff = np.eye(w.max() + 1)[w], np.eye(f.max() + 1)[f][:, :-1]
    x, n, y = np.hstack([d, ff]), rows["n"].to_numpy(), rows["y"].to_numpy()
    a = np.linalg.inv(x.T @ (n[:, None] * x))
    e, v, h = y - x @ a @ x.T @ (n * y), y - n @ y / n.sum(), n * np.einsum("ij,jk,ik->i", x, a, x)
    part = np.hstack([d, 0 * ff]) if effect == "worker" else np.hstack([0 * d, ff])
    z, t = np.column_stack([np.ones(len(y)), rows["x1"]]), rows["t"].to_numpy()
    load = np.linalg.solve(z.T @ (t[:, None] * z), z.T @ (t[:, None] * part))
    got = r.projection()
    c = np.sqrt(n)[:, None] * (x @ a @ load.T)
    assert not rows.duplicated(["w", "f"]).any()
    robust, naive = (c.T @ (q[:, None] * c) for q in (n * v * e / (1 - h), n * e * e))
    want = load @ (a @ x.T @ (n * y))
    assert [x.coefficient for x in got.collect()][1] == pytest.approx(want[1], abs=1e-9)
    assert [x.se for x in got.collect()][1] == pytest.approx(max(robust[1, 1], 0) ** 0.5, abs=1e-9)
    assert [x.naive_se for x in got.collect()][1] == pytest.approx(naive[1, 1] ** 0.5, abs=1e-9)


@pytest.mark.parametrize("deletion", ["match", "observation"])
def test_corrected_centering_equals_the_expanded_system(spark, deletion):
    df = sources.simulate(spark, "ex3")
    spec = PanelSpec("log_wage", "worker_id", "firm_id", frequency="frequency", target="target_mass", deletion=deletion)
    mean, got = (TwoWay(replace(spec, centering=c)).fit(df) for c in ("mean", "corrected"))
    rows = got.rows.toPandas()
    s = rows["t"].to_numpy() / rows["t"].sum()
    w, f = (np.unique(rows[c], return_inverse=True)[1] for c in ("w", "f"))
    x = np.hstack([np.eye(w.max() + 1)[w], np.eye(f.max() + 1)[f][:, :-1]])
    c, nw = np.diag(s) - np.outer(s, s), w.max() + 1
    d, ff = x.copy(), x.copy()
    d[:, nw:], ff[:, :nw] = 0, 0
    times = rows["n"].astype(int).to_numpy()
    at = np.repeat(np.arange(len(rows)), times)
    xe, ye = x[at], rows["y"].to_numpy()[at]
    a = np.linalg.inv(xe.T @ xe)
    m = np.eye(len(at)) - xe @ a @ xe.T
    n, e, z = len(at), m @ ye, ye - ye.mean()
    group = at if deletion == "match" else np.arange(n)
    member = np.eye(group.max() + 1)[group]
    assert not rows.duplicated(["w", "f"]).any()
    t, xi, share = np.zeros(n), np.zeros(n), np.zeros(member.shape[1])
    for g in range(member.shape[1]):
        i = np.flatnonzero(group == g)
        r = np.linalg.solve(m[np.ix_(i, i)], e[i])
        t[i], xi[i] = z[i] * r.sum(), (z[i] * r.sum() - r * z[i].sum()) / len(i)
        share[g] = m[np.ix_(i, i)].sum() / len(i)
    b = member.T @ (m @ t)
    for g in range(len(b)):
        i = np.flatnonzero(group == g)
        b[g] -= n * (m[np.ix_(i, i)] @ xi[i]).sum()
    kappa = np.linalg.solve(n * np.diag(share) - member.T @ m @ member, b)
    chat = xi + (kappa / member.sum(0))[group]
    same = group[:, None] == group[None, :]
    for k, q in enumerate((d.T @ c @ d, ff.T @ c @ ff, (d.T @ c @ ff + ff.T @ c @ d) / 2)):
        want = -((xe @ a @ q @ a @ xe.T) * same).sum(0) @ chat
        assert got.corrected[k] - mean.corrected[k] == pytest.approx(want, abs=1e-11) and abs(want) > 1e-9


def test_signs_have_the_moments_of_sums_of_signs():
    s = jla.signs(np.arange(300), np.tile([1, 5, 200], 100), np.arange(100), 3, 1)
    assert set(np.unique(s[::3])) == {-1.0, 1.0} and (np.abs(s[1::3]) <= 5).all()
    for k, n in enumerate((1, 5, 200)):
        assert abs(s[k::3].mean()) < 4 * (n / 10_000) ** 0.5 and abs((s[k::3] ** 2).mean() / n - 1) < 0.06
    assert np.abs(np.corrcoef(s[:, :20].T) - np.eye(20)).max() < 0.3


def test_frequency_equals_literal_copies(spark):
    _, df = panel(spark)
    a = TwoWay(PanelSpec("y", "worker", "firm", unit="m", frequency="fw")).fit(df)
    b = TwoWay(PanelSpec("y", "worker", "firm", unit="m")).fit(df.withColumn("k", F.explode(F.sequence(F.lit(1), "fw"))))
    assert a.plugin == pytest.approx(b.plugin, abs=1e-11) and a.bias == pytest.approx(b.bias, abs=1e-11)


def graph_rows(spark, edges):
    return spark.createDataFrame([(float(k), w, f, u) for k, (w, f, u) in enumerate(edges)], "y double, worker long, firm long, m long")


def select(spark, edges, **options):
    spec = PanelSpec("y", "worker", "firm", unit="m", **options)
    return graph.select(sources.freeze(graph_rows(spark, edges), spec), spec)


def test_tied_components_are_refused(spark):
    two = [(1, 1, 11), (1, 2, 12), (2, 1, 21), (2, 2, 22)]
    with pytest.raises(Withheld) as e:
        select(spark, two + [(w + 10, f + 10, u + 100) for w, f, u in two])
    assert e.value.status == "AMBIGUOUS_LARGEST_COMPONENT"


def test_a_cut_worker_goes(spark):
    rows, facts = select(spark, [(1, 1, 11), (1, 2, 12), (2, 1, 21), (2, 2, 22), (3, 1, 31), (3, 3, 33)])
    assert {x.w for x in rows.collect()} == {1, 2} and facts["rows_out"] == 4
    with pytest.raises(Withheld) as e:
        select(spark, [(1, 1, 11), (1, 2, 12), (2, 2, 22), (2, 3, 23)])
    assert e.value.status == "NO_LEAVEOUT_COMPONENT"


def brute_weak(edges):
    def parts(es, nodes):
        near = {x: set() for x in nodes}
        for _, a, b in es:
            near[a].add(b)
            near[b].add(a)
        left, n = set(nodes), 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                for y in near[todo.pop()] & left:
                    left.discard(y)
                    todo.append(y)
        return n

    nodes = {x for _, a, b in edges for x in (a, b)}
    base = parts(edges, nodes)
    bridges = {k for k, _, _ in edges if parts([e for e in edges if e[0] != k], nodes) > base}
    cuts = {x for x in nodes if parts([e for e in edges if x not in e[1:]], nodes - {x}) > base}
    return bridges, cuts


def test_bridges_and_cut_vertices_equal_brute_force():
    r = random.Random(2)
    for _ in range(400):
        edges = [(k, r.randint(0, 4), 10 + r.randint(0, 3)) for k in range(r.randint(1, 9))]
        assert graph.weak_points(edges) == brute_weak(edges)


def test_the_spread_search_equals_brute_force(spark):
    r, rows, bridges, cuts = random.Random(5), [], set(), set()
    for g in range(150):
        edges = [(100 * g + k, 100 * g + r.randint(0, 4), 100 * g + 50 + r.randint(0, 4)) for k in range(r.randint(1, 11))]
        found = brute_weak(edges)
        bridges, cuts = bridges | found[0], cuts | {x for x in found[1] if x % 100 < 50}
        rows += edges
    ring = [(10**6 + 2 * i + k, 10**6 + i, 10**6 + 50 + (i + k) % 12) for i in range(12) for k in (0, 1)]  # no weak point
    cells = spark.createDataFrame(rows + ring, "u long, a long, b long").groupBy("a", "b").agg(F.count("*").alias("units"), F.min("u").alias("u"))
    got = graph.spread_weak(cells).collect()
    assert {x.key for x in got if x.kind == "bridge"} == bridges and {x.key for x in got if x.kind == "cut"} == cuts
    assert len(got) == len(bridges) + len(cuts)


def weak_units(r, groups):
    """Units (unit, w, f) of many small graphs, with workers of the same firms and parallel units among them."""
    edges = []
    for g in range(groups):
        cells = [(w, f) for w in range(r.randint(1, 9)) for f in r.sample(range(4), r.randint(1, 3))]
        edges += [(len(edges) + i, 100 * g + w, 100 * g + 50 + f) for i, (w, f) in enumerate(cells + r.choices(cells, k=r.randint(0, 3)))]
    return edges


@pytest.mark.parametrize("local_cells", [5_000_000, 0])
def test_weak_points_of_workers_of_the_same_firms_equal_brute_force(spark, local_cells):
    edges = weak_units(random.Random(11), 120)
    bridges, cuts = set(), set()
    for g in range(120):
        found = brute_weak([x for x in edges if x[1] // 100 == g])
        bridges, cuts = bridges | found[0], cuts | {x for x in found[1] if x % 100 < 50}
    df = spark.createDataFrame(edges, "unit long, w long, f long")
    found = graph.weak(df, local_cells).collect()
    hashed = df.select("unit", F.xxhash64("unit").alias("hu"), "w", F.xxhash64(F.lit("w"), "w").alias("hw")).collect()
    unit, worker = {x.hu: x.unit for x in hashed}, {x.hw: x.w for x in hashed}
    assert sorted(unit[x.key] for x in found if x.kind == "bridge") == sorted(bridges)
    assert sorted(worker[x.key] for x in found if x.kind == "cut") == sorted(cuts)


def test_few_firms_leave_few_cells_to_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "spread_weak", lambda cells: pytest.fail(f"{cells.count()} cells are left"))
    units = spark.range(4000).selectExpr("id as unit", "id div 4 as w", "(id + id div 4) % 5 as f")  # 1000 workers, five sets of four firms
    assert graph.weak(units, 40).isEmpty()


def test_the_search_in_one_task_takes_few_bytes_a_cell():
    r = np.random.default_rng(3)
    a, b = np.repeat(np.arange(10_000), 2), r.integers(0, 400, 20_000)
    t = pa.table({"a": a, "b": b, "u": np.arange(20_000), "units": np.ones(20_000, np.int64)})
    tracemalloc.start()
    graph._weak(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(a)


def test_typed_refusals(spark):
    df = panel(spark)[1]
    cases = [
        (df.withColumn("y", F.when(F.col("m") > 10, F.col("y"))), {}, "MATCH_INPUT_MISSING"),
        (df.withColumn("fw", F.lit(0)), {"frequency": "fw"}, "INVALID_FREQUENCY"),
        (df.withColumn("tw", F.lit(-1.0)), {"target": "tw"}, "INVALID_TARGET"),
        (df.withColumn("fw", F.lit(2**52)), {"frequency": "fw"}, "PHYSICAL_TOTAL_LIMIT"),
        (df.withColumn("m", F.lit(1)), {}, "CROSS_COORDINATE_MATCH"),
        (df, {"exact_limit": 2, "algorithm": "exact"}, "EXACT_LIMIT"),
        (df, {"deletion": "none"}, "INVALID_OPTION"),
        (df, {"inference_model": "target_lowess"}, "INFERENCE_MODEL_REMOVED"),
        (df.withColumn("c2", F.col("c1") * 2), {"controls": ("c1", "c2"), "nuisance": "fixed_offset"}, "RANK_DEFICIENT_CONTROLS"),
        (df.limit(0), {}, "NO_LEAVEOUT_COMPONENT"),
    ]
    for data, options, status in cases:
        with pytest.raises(Withheld) as e:
            TwoWay(PanelSpec("y", "worker", "firm", unit="m", **options)).fit(data)
        assert e.value.status == status and e.value.hint


def test_midranks(spark):
    r = random.Random(1)
    v = [float(r.randint(0, 50)) for _ in range(300)]
    got = fn.with_midrank(spark.createDataFrame(list(enumerate(v)), "i long, v double"), "v").collect()
    x = np.array(v)
    for g in got:
        first, last = (x < g.v).sum() + 1, (x <= g.v).sum()
        assert g.midrank == pytest.approx((first + last - 1) / len(v) - 1)


def test_null_values_have_no_midrank_but_stay(spark):
    got = fn.with_midrank(spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "i long, v double"), "v").collect()
    assert {g.i: g.midrank for g in got} == {1: 0.5, 2: None, 3: -0.5}


def test_simulated_panels(spark):
    shape = {"ex1": 60_000, "ex2": 1200, "ex3": 180, "ex4": 440, "ex5": 24}
    for name, n in shape.items():
        df = sources.simulate(spark, name)
        assert df.count() == n and df.exceptAll(sources.simulate(spark, name).repartition(5)).isEmpty()
    df = sources.simulate(spark, "ex2")
    r = TwoWay(PanelSpec("log_wage", "worker_id", "firm_id", controls=("productivity",), factors=("period",), nuisance="fixed_offset", centering="mean")).fit(df)
    assert np.isfinite(r.bias).all() and r.facts["rows_out"] > 500
    assert sources.true_moments(df, "worker_fe", "firm_fe").first().total_variance > 0
    assert sources.simulate(spark, "ex4").groupBy("worker_id").agg(F.countDistinct("firm_id").alias("k")).where("k = 2").count() == 110
    fixed = TwoWay(PanelSpec("log_wage", "worker_id", "firm_id", controls=("productivity", "policy"))).fit(sources.simulate(spark, "ex5"))
    assert fixed.plugin == pytest.approx(PLUGIN, abs=1e-10)


def test_registry_and_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_components_and_movers_of_the_whole_table_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    li = [(w, 1000 * (w % 4) + r.randint(1, 3), float(r.randint(1, 50)), 10.0) for w in range(1, 41) for _ in range(r.randint(1, 4))]
    spark.createDataFrame(li, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = {(w, f) for w, f, _, _ in li}
    left, want = set(cells), []
    while left:
        group = {left.pop()}
        while more := {c for c in left if any(c[0] == g[0] or c[1] == g[1] for g in group)}:
            group |= more
            left -= more
        want.append((min(w for w, _ in group), len({w for w, _ in group}), len({f for _, f in group}), len(group)))
    got = [(x.least_worker, x.workers, x.firms, x.cells) for x in QUERIES["components"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) >= 4
    firms = {w: len({f for v, f in cells if v == w}) for w, _ in cells}
    rows = {w: sum(x[0] == w for x in li) for w in firms}
    got = {x.w: (x.units, x.firms, x.physical, x.mover) for x in QUERIES["mover_stayer"](spark, str(tmp_path)).collect()}
    assert got == {w: (firms[w], firms[w], rows[w], firms[w] > 1) for w in firms}


def test_rank_bins_with_ties_nulls_and_any_partitions(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 1.0, 1.0, 2.5, rng.random()])) for k in range(500)]
    want = {k: i * 7 // sum(v is not None for _, v in rows) + 1 for i, (v, k) in enumerate(sorted((v, k) for k, v in rows if v is not None))}
    for parts in (1, 6):
        got = {r.k: r.bin for r in fn.with_rank_bin(spark.createDataFrame(rows, "k long, v double").repartition(parts), "v", "k", 7).collect()}
        assert len(got) == 500 and got == {k: want.get(k) for k, _ in rows}
    assert fn.with_rank_bin(spark.createDataFrame([], "k long, v double"), "v", "k", 7).count() == 0


def test_linked_copies_have_the_stated_counts(spark):
    df = panel(spark)[1]
    for design, copies in (("ring", 2), ("ring", 5), ("replicated_blocks", 4)):
        got = sources.connected_copies(df, "worker", "firm", "y", design, copies)
        cells = df.select("worker", "firm").distinct().count()
        want = sources.copies_facts(design, copies, 24, 6, 4, cells)
        assert (got.count(), got.select("worker").distinct().count(), got.select("firm").distinct().count()) == (want["rows"], want["workers"], want["firms"])
        assert got.select("worker", "firm").distinct().count() == want["cells"]


def test_numerical_covariance_and_texts():
    draws = np.random.default_rng(1).normal(size=(3, 50))
    status, v, mcse = numerical.finalize(numerical.of_mean(draws))
    total = draws[0] + draws[1] + 2 * draws[2]
    assert status == "ok_local" and mcse == pytest.approx([x.std(ddof=1) / 50**0.5 for x in (*draws, total)])
    assert numerical.finalize(np.diag([1.0, 1.0, -1.0]))[0] == "unstable_nonpsd"
    assert numerical.finalize(np.ones((3, 3)) - np.diag([0, 0, 1e-14]))[0] == "ok_local_psd_adjusted"
    assert numerical.finalize(np.full((3, 3), np.nan))[0] == "nonfinite_derivative" and numerical.finalize(np.zeros((3, 3)))[2] == (0,) * 4
    assert [report.share_text(x) for x in (None, 1.2, 0.0001, 0.1234)] == [".", ">100%", "<0.1%", "12.3%"]
    assert "raise probes" in report.mcse_line((1, 1, 1, 1), 200, (5, 50, 50, 50)) and "raise" not in report.mcse_line((1, 1, 1, 1), 200)


def test_surface_of_a_default_fit(spark):
    df = sources.simulate(spark, "ex3").withColumn("worker_id", F.concat(F.lit("w"), "worker_id"))
    assert (options_.PanelSpec("y", "w", "f").stayers, options_.PanelSpec("y", "w", "f").centering, options_.PanelSpec("y", "w", "f").seed) == ("both", "mean", 8675309)
    r = TwoWay(options_.PanelSpec("log_wage", "worker_id", "firm_id", algorithm="jla", probes=20)).fit(df)
    fitted = r.effects("worker").collect()
    assert {x.w for x in fitted} == {x.worker_id for x in df.select("worker_id").distinct().collect()}
    effects = {x.w: x.alpha for x in fitted}, {x.f: x.psi for x in r.effects("firm").collect()}
    left = np.array([x.y - effects[0][x.w] - effects[1][x.f] for x in r.rows.collect()])
    got = {x.component: x for x in r.decomposition(full=True).collect()}
    assert got["residual"].plugin == pytest.approx((left**2).mean()) and got["outcome"].plugin_outcome_share == 1 and got["residual"].bias is None
    facts = {x["item"]: x.value for x in r.computation().collect()}
    assert facts["algorithm"] == "jla" and facts["probes"] == "20" and {"seconds_read", "seconds_sample", "seconds_fit"} <= set(facts)
    assert [x.status for x in r.numerical().collect()] == ["ok_local"] * 4 and len(r.mcse) == 4 and r.mcse[0] > 0


def test_firms_are_numbered_alike_on_the_driver_and_by_ranges(spark):
    cells = spark.createDataFrame([(f"f{k * 37 % 500:03d}",) for k in range(1000)], "f string")
    (a, few), (b, many) = exact.index_firms(cells, 1000), exact.index_firms(cells, 1000, local=60)
    assert a == b == 500 and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(k, f"f{k:03d}") for k in range(500)]


def test_small_tables_start_no_python_workers_of_their_own(spark):
    r = TwoWay(PanelSpec("y", "worker", "firm", centering="mean", inference="highrank")).fit(panel(spark)[1].where("y is not null"))
    cells = r.rows.select("f")
    for df in (r.results(), r.sample(), r.computation(), r.numerical(), r.decomposition(full=True), *(exact.index_firms(cells, 100, local=k)[1] for k in (100, 2))):
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert r.decomposition(full=True).where("component = 'outcome'").first()["bias"] is None and r.sample().schema["count"].dataType.simpleString() == "bigint"


def test_blocks_bound_the_pairs_and_lose_no_row():
    w = np.repeat([1, 2, 3, 4, 5], [30, 3, 40, 1, 5])
    t = pa.table({"w": w, "j": np.arange(len(w)), "n": np.ones(len(w)), "sy": np.ones(len(w)), "s": np.ones(len(w))})
    got = list(exact.blocks(t.to_batches(), pairs=1000))
    assert np.concatenate([b.j for b in got]).tolist() == list(range(len(w))) and len(got) > 1
    assert all(len(b.a) <= 1000 + 40**2 for b in got) and sum(len(b.a) for b in got) == 900 + 9 + 1600 + 1 + 25


def test_tables_hold_whole_workers_and_no_more_rows_than_asked():
    w = np.repeat(np.arange(9), [1, 2, 700, 30, 40, 50, 1, 99, 100])
    t = pa.table({"w": w, "x": np.arange(len(w))})
    for chunk in (7, 64, 5000):
        got = [x.to_pydict() for x in exact.tables(t.to_batches(max_chunksize=chunk), 100)]
        assert [x for y in got for x in y["x"]] == list(range(len(w))) and [len(set(y["w"])) for y in got if len(y["w"]) > 100] == [1]
        assert sum(len(set(y["w"])) for y in got) == 9


def test_sums_of_a_task_are_added_up_before_they_are_sent():
    r = np.random.default_rng(5)
    for firms, columns in ((5, 40), (9000, 70)):
        parts = [(r.integers(0, firms, 3000), r.integers(-9, 9, (3000, columns)).astype(float)) for _ in range(12)]
        want, got = np.zeros((firms, -(-columns // 32) * 32)), np.zeros((firms, -(-columns // 32) * 32))
        for j, x in parts:
            np.add.at(want[:, :columns], j, x)
        batches = list(firmwise.summed(iter(parts)))
        for b in batches:
            part = b["part"].to_numpy()[0] * 32
            got[b["j"].to_numpy(), part : part + 32] += np.column_stack([b[c].to_numpy() for c in firmwise.COLUMNS])
        assert (got == want).all() and (firms > 5 or len(batches) == 2)


class Task:
    """A task of whole workers with five cells each, in place of a table."""

    def __init__(self, rows):
        r, w = np.random.default_rng(1), np.arange(rows) // 5
        self.t = pa.table({"w": w, "j": (np.arange(rows) % 5).astype(np.int32), "key": np.arange(rows), "n": np.ones(rows), "whole": np.ones(rows, bool), **{c: r.random(rows) for c in ("uy", "sy", "s", "y", "v", "r1", "r2", "r3")}})
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run(iter(self.t.to_batches(max_chunksize=10_000)))


class NoSolver:
    k = 5

    def __call__(self, rhs):
        return np.zeros(rhs.shape)


@pytest.mark.parametrize("step", ["kernels", "moments", "images"])
def test_a_task_needs_no_more_memory_for_more_rows_or_columns(monkeypatch, step):
    for module in (jla, inference):
        monkeypatch.setattr(module, "cut", lambda df: df)
    monkeypatch.setattr(jla, "deal", lambda df, *order: df)
    monkeypatch.setattr(firmwise, "collect", lambda *a: np.zeros(a[-2:]))
    fit, spec = exact.Fit(*(np.zeros((5, 5)) for _ in range(4)), *(np.zeros(5) for _ in range(3)), 0.0, 1.0), PanelSpec("y", "w", "f", probes=200, inference_draws=40)
    run = {"kernels": lambda t: exact.kernels(t, fit), "moments": lambda t: jla.moments(t, NoSolver(), spec), "images": lambda t: inference.images(t, NoSolver(), spec)[0]}[step]
    task, rows = Task(200_000 if step == "kernels" else 40_000), 0
    tracemalloc.start()
    for batch in run(task):
        rows += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == task.t.num_rows and peak < 45e6


def test_workers_of_one_hash_are_refused(spark):
    rows = [((None, 1), "a", 1.0), ((None, 1), "b", 2.0), ((1, None), "a", 1.5), ((1, None), "b", 2.5)]  # a hash skips nulls
    with pytest.raises(Withheld, match="WORKER_COLLISION"):
        TwoWay(PanelSpec("y", "w", "f")).fit(spark.createDataFrame(rows, "w struct<a: int, b: int>, f string, y double"))
