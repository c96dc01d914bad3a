"""Sampling covariance of the three targets by repeat measurements, on deletion units.

A unit's row is scaled by the root of its mass. The estimate of target t is y' K_t y with
K_t v = B_t v - (r_t o M v + M (r_t o v)) / 2, M the residual maker, B_t = X A Q_t A X' and r_t the
diagonal of B_t over that of M. The covariance is 4 sum v g_s g_t - 2 tr(K_s V K_t V) + pairs with g_t = K_t y;
the trace comes from a few draws of noise with the unit variances v. All columns share two batched solves.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import with_midrank
from ..spec import PanelSpec, Withheld
from . import cut, exact, firmwise, jla

Q = ("q_worker", "q_firm", "q_cov")


def normals(key: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """rows x draws standard normal numbers by key (Box-Muller on two mixed counters)."""
    u = jla.U
    with np.errstate(over="ignore"):
        base = jla.mix(key.astype(np.int64).view(u))[:, None] ^ jla.mix(jla.mix(np.array([seed], u)) + draws.astype(u) * u(0xD1342543DE82EF95) + u(3))[None, :]
        a, b = ((jla.mix(base + u(k)) >> u(11)).astype(float) + 0.5 for k in (1, 2))
    return np.sqrt(-2 * np.log(a / 2**53)) * np.cos(2 * np.pi * b / 2**53)


def units(rows: DataFrame, kernels: DataFrame, firms: DataFrame, spec: PanelSpec, mean: float) -> DataFrame:
    """One row a unit: key, w, j, n, s (its part of the cell's target share), y and e scaled, h, ratios r1..r3, d1..d3, product, alpha, psi, set, size of the set, mover."""
    u = jla.leverage_units(rows, spec).join(firms, "f").withColumn("w", F.xxhash64("w")).select("key", "w", "j", F.col("n").alias("m"), "uy", "whole")
    x = u.join(kernels.withColumnRenamed("n", "cell_n"), ["w", "j"])
    root, n = F.sqrt("m"), F.col("m")
    h = n * F.col("leverage")
    y = (F.col("uy") - n * float(mean)) / root
    e = (F.col("uy") - n * (F.col("alpha") + F.col("psi"))) / root
    x = x.select("key", "w", "j", n.alias("n"), "whole", (F.col("s") * n / F.col("cell_n")).alias("s"), y.alias("y"), e.alias("e"), h.alias("h"), *[(n * F.col(q)).alias(f"d{i}") for i, q in enumerate(Q, 1)], "alpha", "psi")
    for i in (1, 2, 3):
        x = x.withColumn(f"r{i}", F.col(f"d{i}") / (1 - F.col("h")))
    return cut(x.withColumn("product", F.col("y") * F.col("e") / (1 - F.col("h"))))


def _least_squares(df: DataFrame, basis: list, y: str) -> np.ndarray:
    k = len(basis)
    got = df.agg(*[F.sum(basis[i] * basis[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(b * F.col(y)).alias(f"r{i}") for i, b in enumerate(basis)]).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ np.array([got[f"r{i}"] for i in range(k)])


def _tied(df: DataFrame, c: str) -> DataFrame:
    """c on a grid of 2^-40 of its size, so that round-off makes no ranks."""
    top = df.agg(F.max(F.abs(c))).first()[0]
    return df if not top else df.withColumn(c, F.floor(F.col(c) / float(2.0 ** (np.floor(np.log2(top)) - 40)) + 0.5).cast("double"))


def _linear(basis: list, b: np.ndarray):
    out = F.lit(0.0)
    for x, c in zip(basis, b, strict=True):
        out = out + x * float(c)
    return out


def variances(u: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(units with v, 3 x 3 pair term). Copies that share a cell are a set and get the sample variance of their outcomes.

    Units alone in their cell get a scale (ranks of leverage and mass) times a quadratic in both effects, by least
    squares on leave-out products; fewer than 100 of them are fitted with all units of movers. The floor is 1e-8 of an
    approximate median.
    """
    floor = 1e-8 * u.agg(F.percentile_approx(F.col("e") ** 2 / (1 - F.col("h")), 0.5, 10_000)).first()[0]
    if not floor > 0:
        raise Withheld("INFERENCE_VARIANCE_INVALID")
    cells = u.where("not whole").groupBy("w", "j").agg(F.count("*").alias("size"), F.var_samp("y").alias("sample"), *[F.avg(f"r{i}").alias(f"a{i}") for i in (1, 2, 3)], F.avg("d1").alias("dw"))
    many = cells.groupBy("w").agg((F.count("*") > 1).alias("mover"))
    cells = cut(cells.join(many, "w"))
    if not cells.where("size = 1 and not mover").isEmpty():
        raise Withheld("INFERENCE_VARIANCE_INVALID", "a stayer with one copy")
    t = F.col("size")
    weight = [F.when(F.col("mover"), F.col("a1")).otherwise(F.col("dw") * t / (t - 1)), F.when(F.col("mover"), F.col("a2")).otherwise(0.0), F.when(F.col("mover"), F.col("a3")).otherwise(0.0)]
    got = cells.where("size > 1").agg(*[F.coalesce(F.sum(4 * F.col("sample") ** 2 * (t - 2) * (t - 1) / (t + 1) * weight[a] * weight[b]), F.lit(0.0)).alias(f"p{a}{b}") for a in range(3) for b in range(3)]).first()
    pair = np.array(list(got)).reshape(3, 3)
    u = u.join(cells.select("w", "j", "size", "sample", F.col("mover").alias("cell_mover")), ["w", "j"], "left")
    single = F.col("whole") | (F.col("size") == 1)
    u = cut(u.withColumn("single", single).withColumn("of_mover", F.col("whole") | F.col("cell_mover")))
    v = F.when(~F.col("single"), F.greatest("sample", F.lit(floor)))
    alone = u.where("single").count()
    if not alone:
        return u.withColumn("v", v), pair
    m = u.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("alpha", "psi")]).first()
    mean = {c: m[c] / m["n"] for c in ("alpha", "psi")}
    dev = u.agg(*[F.sqrt(F.sum(F.col("n") * (F.col(c) - mean[c]) ** 2) / m["n"]).alias(c) for c in ("alpha", "psi")]).first()
    fit = u.where("single" if alone >= 100 else "of_mover").select("key", "single", "product", "h", F.col("n").alias("mass"), "alpha", "psi")
    for c, out in (("h", "lever"), ("mass", "heavy")):
        fit = with_midrank(_tied(fit, c), c, out)
    fit = cut(fit)
    rows = alone if alone >= 100 else fit.count()
    lever, heavy = F.col("lever"), F.col("heavy")
    basis = [F.lit(1.0), lever, heavy, lever**2, heavy**2][: max(1, min(5, rows // 100))]
    least = 0.05 * fit.agg(F.avg("product")).first()[0]
    if not least > 0:
        raise Withheld("INFERENCE_VARIANCE_INVALID")
    fit = fit.withColumn("scale", F.greatest(_linear(basis, _least_squares(fit, basis, "product")), F.lit(least)))
    a, f = (F.greatest(F.least((F.col(c) - mean[c]) / (dev[c] or float("inf")), F.lit(3.0)), F.lit(-3.0)) for c in ("alpha", "psi"))
    profile = [F.col("scale") * x for x in (F.lit(1.0), a, a * a, f, f * f, a * f)[: max(1, min(6, rows // 100))]]
    fit = fit.withColumn("fitted", _linear(profile, _least_squares(fit, profile, "product"))).where("single").select("key", F.greatest("fitted", F.lit(floor)).alias("fitted"))
    return u.join(fit, "key", "left").withColumn("v", F.coalesce(v, "fitted")), pair


def images(u: DataFrame, solver: firmwise.Solver, spec: PanelSpec, values: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """(key, n, v and, for each draw d, k{d}_1..3: images of the outcome (d = 0) and of noise under the three kernels; columns).

    values: eigenvalues of the leading directions of the four targets. Then also x{d}_1..4, the images under the kernels less their
    leading directions, and u must hold those (w1..w4) and their part in the ratios (q1..q4).
    """
    draws, k = spec.inference_draws, solver.k
    centre = spec.centering == "mean"
    lead = 0 if values is None else 4
    more = [f"{x}{t}" for x in "wq" for t in range(1, lead + 1)]
    u = jla.deal(u.select("key", "w", "j", "n", "s", "y", "v", "r1", "r2", "r3", *more), "j", "key")
    sc = u.sparkSession.sparkContext
    numbers = np.arange(draws)
    noise = lambda b: np.sqrt(b.col["v"])[:, None] * normals(b.col["key"], numbers, spec.inference_seed)
    shift = np.zeros(draws)
    if centre:

        def total(batches):
            for b in firmwise.whole_workers(batches, draws + 1):
                x = np.sqrt(b.n)[:, None] * np.column_stack([noise(b), np.sqrt(b.n)])
                yield np.zeros(1, np.int64), x.sum(0)[None, :]

        x = firmwise.collect(u, total, 1, draws + 1)[0]
        shift = x[:-1] / x[-1]
    c = 1 + draws

    def columns(b):
        """[v, r1 v, r2 v, r3 v, q1 v, ...] for the outcome and every draw."""
        v = np.column_stack([b.col["y"], noise(b) - np.sqrt(b.n)[:, None] * shift])
        return np.column_stack([v, *[b.col[f"r{i}"][:, None] * v for i in (1, 2, 3)], *[b.col[f"q{t}"][:, None] * v for t in range(1, lead + 1)]])

    def rhs(batches):
        for b in firmwise.whole_workers(batches, (4 + lead) * c):
            x = columns(b)
            scores = [b.col[f"w{t}"] @ x[:, :c] for t in range(1, lead + 1)]
            x = np.sqrt(b.n)[:, None] * x
            yield b.j, x - b.p[:, None] * b.total(x)
            if lead:  # one more row: the columns' products with the directions
                yield np.array([k]), np.concatenate([*scores, np.zeros(4 * c)])[None, :]

    got = firmwise.collect(u, rhs, k + 1, (4 + lead) * c)
    psi, scores = solver(got[:k]), got[k, : lead * c].reshape(lead, c)
    first = sc.broadcast(psi)

    def alphas(b):
        x = columns(b)
        return x, b.total(np.sqrt(b.n)[:, None] * x) / b.nw[:, None] - b.total(b.p[:, None] * first.value[b.j])

    def sums(batches):
        for b in firmwise.whole_workers(batches, (4 + lead) * c):
            a, s, sw = alphas(b)[1][:, :c], b.col["s"], b.total(b.col["s"])
            sp = b.total(s[:, None] * first.value[b.j, :c])
            yield b.j, np.column_stack([(b.p * sw)[:, None] * a, b.p[:, None] * sp, s[:, None] * a, b.p * sw, s])

    got = firmwise.collect(u, sums, k, 3 * c + 2)
    s1, s2, s3, m, s = got[:, :c], got[:, c : 2 * c], got[:, 2 * c : 3 * c], got[:, -2:-1], got[:, -1:]
    amean, pmean = s3.sum(0), (s * psi[:, :c]).sum(0)
    second = sc.broadcast(solver(np.column_stack([m * amean - s1, s * (psi[:, :c] - pmean), (s3 - s * amean) / 2 - (s2 - m * pmean) / 2])))
    names = ["key", "n", "v", *[f"k{d}_{t}" for t in (1, 2, 3) for d in range(c)], *[f"x{d}_{t}" for t in range(1, lead + 1) for d in range(c)]]

    def run(batches):
        for b in firmwise.whole_workers(batches, (4 + lead) * c):
            x, a = alphas(b)
            root, s, sw = np.sqrt(b.n)[:, None], b.col["s"], b.total(b.col["s"])[:, None]
            fitted = root * (a + first.value[b.j])
            at = np.column_stack([sw * (a[:, :c] - amean), np.zeros((len(s), c)), (b.total(s[:, None] * first.value[b.j, :c]) - sw * pmean) / 2])
            image = root * (at / b.nw[:, None] + b.away(second.value))
            rest = x - fitted
            for t in (1, 2, 3):
                image[:, (t - 1) * c : t * c] -= (b.col[f"r{t}"][:, None] * rest[:, :c] + rest[:, t * c : (t + 1) * c]) / 2
            if lead:
                k1, k2, k3 = (image[:, i * c : (i + 1) * c] for i in range(3))
                left = []
                for t, kernel in enumerate((k1, k2, k3, k1 + k2 + 2 * k3)):
                    w, q = b.col[f"w{t + 1}"][:, None], b.col[f"q{t + 1}"][:, None]
                    left.append(kernel - values[t] * w * scores[t] + (q * rest[:, :c] + rest[:, (4 + t) * c : (5 + t) * c]) / 2)
                image = np.column_stack([image, *left])
            yield pa.RecordBatch.from_arrays([pa.array(b.col["key"]), pa.array(b.n), pa.array(b.col["v"]), *(pa.array(np.ascontiguousarray(q)) for q in image.T)], names)

    out = cut(u.mapInArrow(run, "key long, n double, v double, " + ", ".join(f"{q} double" for q in names[3:])))
    if centre:  # the kernels are those of the centred outcome
        got = out.agg(F.sum("n").alias("n"), *[F.sum(F.sqrt("n") * F.col(q)).alias(q) for q in names[3:]]).first()
        out = out.select("key", "n", "v", *[(F.col(q) - F.sqrt("n") * float(got[q] / got["n"])).alias(q) for q in names[3:]])
    return out, c


def covariance(images: DataFrame, c: int, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3 x 3 covariance, 3 x 3 mean trace)."""
    pairs = [(a, b) for a in (1, 2, 3) for b in range(a, 4)]
    v = F.col("v")
    got = images.agg(*[F.sum(v * F.col(f"k0_{a}") * F.col(f"k0_{b}")).alias(f"g{a}{b}") for a, b in pairs], *[F.sum(v * sum((F.col(f"k{d}_{a}") * F.col(f"k{d}_{b}") for d in range(2, c)), F.col(f"k1_{a}") * F.col(f"k1_{b}"))).alias(f"t{a}{b}") for a, b in pairs]).first()
    full = lambda x: np.array([[got[f"{x}{min(a, b)}{max(a, b)}"] for b in (1, 2, 3)] for a in (1, 2, 3)])
    trace = full("t") / (c - 1)
    return 4 * full("g") - 2 * trace + pair, trace


def expand(v: np.ndarray) -> np.ndarray:
    """3 x 3 to 4 x 4: the total is worker + firm + 2 covariance."""
    t = np.vstack([np.eye(3), [1, 1, 2]])
    return t @ v @ t.T


def estimate(rows: DataFrame, kernels: DataFrame, firms: DataFrame, spec: PanelSpec, solver: firmwise.Solver, corrected: tuple, mean: float) -> tuple:
    """(4 x 4 covariance of the corrected targets, pieces of the intervals of leading directions and what was found on those; None under highrank).

    The outcomes' products with their images must give the estimates.
    """
    from . import leading

    u, pair = variances(units(rows, kernels, firms, spec, mean))
    lead = None
    if spec.inference != "highrank":
        at, lead = leading.directions(kernels, solver, spec)
        u = leading.attach(u, at, lead)
    u = cut(u)
    found, c = images(u, solver, spec, lead.value if lead else None)
    found = cut(found.join(u.select("key", "y", "product", *([f"w{t}" for t in (1, 2, 3, 4)] if lead else [])), "key"))
    point = found.agg(*[F.sum(F.col("y") * F.col(f"k0_{t}")).alias(f"p{t}") for t in (1, 2, 3)]).first()
    for p, q in zip(point, corrected, strict=False):
        if abs(p - q) > 1e-9 * max(1, abs(q)):
            raise Withheld("TARGET_IDENTITY_FAILED", f"{p} and {q}")
    v, trace = covariance(found, c, pair)
    pieces = leading.scalars(found, c, lead, leading.pairs(u, lead), trace) if lead else None
    return expand(v), pieces, lead


def intervals(corrected: tuple, v: np.ndarray, level: float) -> list[tuple]:
    """(component, estimate, se, lower, upper); none where the variance isn't positive."""
    z = NormalDist().inv_cdf(0.5 + level / 200)
    out = []
    for t, b, x in zip(exact.TARGETS, corrected, np.diag(v), strict=True):
        se = float(np.sqrt(x)) if x > 0 else None
        out.append((t, float(b), se, None if se is None else float(b - z * se), None if se is None else float(b + z * se)))
    return out
