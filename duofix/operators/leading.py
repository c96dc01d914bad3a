"""Intervals where one direction carries an estimate's sampling variance.

The kernel B_t = X A Q_t A X' of target t has a leading direction w of unit length with eigenvalue lam. The estimate is
lam (b^2 - V) + theta with b = w'y, V the leave-out estimate of its variance, and theta the estimate of the remaining kernel.
(b, theta) are taken as normal, and the interval is the range of lam b^2 + theta on their ellipse, with a radius that allows for
the curvature of that map.

Directions come from Ritz values on the span of the last directions, their residuals and the last steps, all four targets in one
batch: firm vectors on the driver, worker effects in the table. One round is one sum over cells, one batched solve and one cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import cut, exact, firmwise, inference, jla

BLOCK = 4  # directions a target; each with its residual and its last step
SPAN = 3 * BLOCK
WIDE = 4 * SPAN
A = [f"a{i}" for i in range(WIDE)]
TARGET = np.repeat(np.arange(4), BLOCK)
ON_WORKER = np.isin(TARGET, (0, 3)).astype(float)
ON_FIRM = np.isin(TARGET, (1, 3)).astype(float)
ON_BOTH = np.select([TARGET == 2, TARGET == 3], [1.0, 2.0], 0.0)
DRAWS = 100_000


@dataclass
class Leading:
    """Per target: eigenvalue, the next one, relative residual of the direction, whether it is within the tolerance; rounds."""

    value: np.ndarray
    second: np.ndarray
    residual: np.ndarray
    converged: np.ndarray
    rounds: int


def _ritz(gram: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values by size, vectors) of a form on the span of columns with this Gram matrix; what is null becomes zero columns."""
    size = np.diag(gram)
    unit = np.where(size > 1e-26, 1 / np.sqrt(np.where(size > 1e-26, size, 1)), 0)
    value, vector = np.linalg.eigh(unit[:, None] * (gram + gram.T) / 2 * unit)
    good = value > 1e-12 * max(value[-1], 1e-300)
    root = unit[:, None] * vector * np.where(good, 1 / np.sqrt(np.where(good, value, 1)), 0)
    lam, u = np.linalg.eigh(root.T @ (form + form.T) @ root / 2)
    order = np.argsort(-np.abs(lam), kind="stable")
    return lam[order], (root @ u)[:, order]


def _side_by_side(x: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Directions, residuals and steps, target by target."""
    parts = [y[:, t * BLOCK : (t + 1) * BLOCK] for t in range(4) for y in (x, r, p)]
    return np.ascontiguousarray(np.column_stack(parts))


def directions(kernels: DataFrame, solver: firmwise.Solver, spec: PanelSpec, tolerance: float = 1e-4, rounds: int = 40) -> tuple[DataFrame, Leading]:
    """(w, j, d1..d4: the direction's value for one copy in the cell, of unit length over copies; what was found).

    A repeated leading eigenvalue has no direction of its own: the one found then depends on `inference_seed`.
    """
    k, wide = solver.k, WIDE
    state = jla.deal(kernels.select("w", "j", "n", "s"), "j")
    sc = state.sparkSession.sparkContext
    psi = np.random.default_rng(spec.inference_seed).standard_normal((k, wide))
    psi[-1] = 0

    def start(batches):
        for b in firmwise.whole_workers(batches, wide):
            a = inference.normals(b.col["w"], np.arange(wide), spec.inference_seed)
            yield pa.RecordBatch.from_arrays([pa.array(b.col[c]) for c in ("w", "j", "n", "s")] + [pa.array(np.ascontiguousarray(x)) for x in a.T], ["w", "j", "n", "s", *A])

    schema = "w long, j int, n double, s double, " + ", ".join(f"{a} double" for a in A)
    state = cut(state.mapInArrow(start, schema))
    effects = lambda b: np.column_stack([b.col[a] for a in A])
    found = Leading(*(np.zeros(4) for _ in range(3)), np.zeros(4, bool), 0)
    for step in range(1, rounds + 1):
        firm = sc.broadcast(psi)

        def sums(batches, firm=firm):
            for b in firmwise.whole_workers(batches, 3 * wide + 2):
                a, p, s, sw = effects(b), firm.value[b.j], b.col["s"], b.total(b.col["s"])
                f = a + p
                yield b.j, np.column_stack([(b.p * sw)[:, None] * a, b.p[:, None] * b.total(s[:, None] * p), s[:, None] * a, b.p * sw, s])
                both = np.column_stack([f.T @ (b.n[:, None] * f), a.T @ (s[:, None] * a), np.zeros((wide, wide + 2))])
                yield k + np.arange(wide), both

        got = firmwise.collect(state, sums, k + wide, 3 * wide + 2)
        gram, square = got[k:, :wide], got[k:, wide : 2 * wide]
        s1, s2, s3, m, s = got[:k, :wide], got[:k, wide : 2 * wide], got[:k, 2 * wide : 3 * wide], got[:k, -2:-1], got[:k, -1:]
        amean, pmean = s3.sum(0), (s * psi).sum(0)
        cross = s3.T @ psi - np.outer(amean, pmean)
        forms = [square - np.outer(amean, amean), psi.T @ (s * psi) - np.outer(pmean, pmean), (cross + cross.T) / 2]
        forms.append(forms[0] + forms[1] + 2 * forms[2])
        turn, steps, values = np.zeros((wide, 4 * BLOCK)), np.zeros((wide, 4 * BLOCK)), np.zeros(4 * BLOCK)
        for t in range(4):
            at, mine = slice(t * SPAN, (t + 1) * SPAN), slice(t * BLOCK, (t + 1) * BLOCK)
            if step > 1:
                found.residual[t] = np.sqrt(max(gram[t * SPAN + BLOCK, t * SPAN + BLOCK], 0))
            lam, u = _ritz(gram[at, at], forms[t][at, at])
            turn[at, mine], values[mine] = u[:, :BLOCK], lam[:BLOCK]
            steps[t * SPAN + BLOCK : (t + 1) * SPAN, mine] = u[BLOCK:, :BLOCK] if step > 1 else 0
            found.value[t], found.second[t] = lam[0], lam[1]
        found.rounds = step
        found.converged = (found.residual <= tolerance) & (step > 1)
        if found.converged.all() or step == rounds:
            break
        x1, x2, x3, px, am, pm = (x @ turn for x in (s1, s2, s3, psi, amean, pmean))
        new = solver(ON_WORKER * (m * am - x1) + ON_FIRM * s * (px - pm) + ON_BOTH * ((x3 - s * am) - (x2 - m * pm)) / 2)
        inv = np.where(np.abs(values) > 1e-300, 1 / np.where(values == 0, 1, values), 0)
        shared = sc.broadcast((turn, steps, inv, px, new, am, pm))

        def apply(batches, shared=shared):
            turn, steps, inv, px, new, am, pm = shared.value
            for b in firmwise.whole_workers(batches, wide):
                old, s, sw = effects(b), b.col["s"], b.total(b.col["s"])[:, None]
                a = old @ turn
                at = ON_WORKER * sw * (a - am) + ON_BOTH * (b.total(s[:, None] * px[b.j]) - sw * pm) / 2
                image = at / b.nw[:, None] - b.total(b.p[:, None] * new[b.j])
                a = _side_by_side(a, image * inv - a, old @ steps)
                yield pa.RecordBatch.from_arrays([pa.array(b.col[c]) for c in ("w", "j", "n", "s")] + [pa.array(np.ascontiguousarray(x)) for x in a.T], ["w", "j", "n", "s", *A])

        state = cut(state.mapInArrow(apply, schema))
        psi = _side_by_side(px, new * inv - px, psi @ steps)
    first = sc.broadcast((turn[:, ::BLOCK], psi))

    def leading(batches):
        turn, psi = first.value
        for b in firmwise.whole_workers(batches, wide):
            d = (effects(b) + psi[b.j]) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(b.col["w"]), pa.array(b.col["j"]), *(pa.array(np.ascontiguousarray(x)) for x in d.T)], ["w", "j", "d1", "d2", "d3", "d4"])

    return cut(state.mapInArrow(leading, "w long, j int, d1 double, d2 double, d3 double, d4 double")), found


def attach(u: DataFrame, found: DataFrame, lead: Leading) -> DataFrame:
    """Units with the directions w1..w4 and q1..q4, their part in the ratios of the kernels."""
    u = u.join(found.select("w", "j", *[F.col(f"d{t}").alias(f"lead{t}") for t in (1, 2, 3, 4)]), ["w", "j"])
    for t in (1, 2, 3, 4):
        w = F.sqrt("n") * F.col(f"lead{t}")
        u = u.withColumn(f"w{t}", w).withColumn(f"q{t}", float(lead.value[t - 1]) * w * w / (1 - F.col("h")))
    return u.drop("lead1", "lead2", "lead3", "lead4")


def pairs(u: DataFrame, lead: Leading) -> np.ndarray:
    """Pair terms of the four remainders: sets of copies that share a cell."""
    size, sample = F.col("size"), F.col("sample")
    cells = u.where("not whole and size > 1").groupBy("w", "j").agg(
        F.first("size").alias("size"),
        F.first("sample").alias("sample"),
        F.first("cell_mover").alias("mover"),
        *[F.avg(x).alias(x) for t in (1, 2, 3) for x in (f"r{t}", f"d{t}")],
        *[F.avg(f"q{t}").alias(f"q{t}") for t in (1, 2, 3, 4)],
        *[F.avg(F.col(f"w{t}") ** 2).alias(f"s{t}") for t in (1, 2, 3, 4)],
    )
    ratio = [F.col("r1"), F.col("r2"), F.col("r3"), F.col("r1") + F.col("r2") + 2 * F.col("r3")]
    worker = [F.col("d1"), F.lit(0.0), F.lit(0.0), F.col("d1")]  # a stayer's cell has no part in the firm variance and the covariance
    out = []
    for t in range(4):
        alone = (worker[t] - float(lead.value[t]) * F.col(f"s{t + 1}")) * size / (size - 1)
        weight = F.when(F.col("mover"), ratio[t] - F.col(f"q{t + 1}")).otherwise(alone)
        out.append(F.coalesce(F.sum(4 * weight**2 * sample**2 * (size - 2) * (size - 1) / (size + 1)), F.lit(0.0)))
    return np.array(list(cells.agg(*[x.alias(f"p{i}") for i, x in enumerate(out)]).first()))


def scalars(images: DataFrame, c: int, lead: Leading, pair: np.ndarray, trace: np.ndarray) -> list[dict]:
    """Per target, the pieces of the interval. images: of inference.images with y, product and w1..w4."""
    v, y = F.col("v"), F.col("y")
    want = {}
    for t in (1, 2, 3, 4):
        w, g = F.col(f"w{t}"), F.col(f"x0_{t}")
        k = F.col(f"k0_{t}") if t < 4 else F.col("k0_1") + F.col("k0_2") + 2 * F.col("k0_3")
        noise = F.lit(0.0)
        for d in range(1, c):
            noise = noise + F.col(f"x{d}_{t}") ** 2
        parts = {"score": w * y, "leave_out": w * w * F.col("product"), "fitted": w * w * v, "direct": y * g, "point": y * k, "linear": 4 * v * g * g, "covariance": 2 * w * v * g, "trace": v * noise}
        want |= {f"{name}{t}": F.sum(x) for name, x in parts.items()} | {f"max_weight{t}": F.max(w * w)}
    got = images.agg(*[x.alias(name) for name, x in want.items()]).first()
    total = inference.expand(trace)
    out = []
    for t in (1, 2, 3, 4):
        x = {name: float(got[f"{name}{t}"]) for name in ("score", "leave_out", "fitted", "direct", "point", "linear", "covariance", "trace", "max_weight")}
        lam = float(lead.value[t - 1])
        theta = x["point"] - lam * (x["score"] ** 2 - x["leave_out"])
        if abs(theta - x["direct"]) > 1e-9 * max(1, abs(x["point"]), abs(x["direct"])):
            raise Withheld("TARGET_IDENTITY_FAILED", f"{theta} and {x['direct']}")
        rest = x["linear"] - 2 * x["trace"] / (c - 1) + float(pair[t - 1])
        share = float((lam * x["fitted"]) ** 2 / total[t - 1, t - 1]) if total[t - 1, t - 1] > 0 else None
        out.append(x | {"value": lam, "theta": theta, "variance": max(x["fitted"], x["leave_out"]), "remainder": float(rest), "eigen_share": share})
    return out


def critical(curvature: float, level: float, seed: int) -> float:
    """Quantile of the distance of a standard normal pair from a circle of this curvature that goes through its mean."""
    a, b = np.abs(np.random.default_rng(seed).standard_normal((2, DRAWS)))
    if curvature > 1e-10:
        r = 1 / curvature
        a = (a * a + b * b + 2 * a * r) / (np.hypot(b, a + r) + r)
    return float(np.sort(a)[min(DRAWS, max(1, int(np.ceil(level / 100 * DRAWS)))) - 1])


def extremes(b: float, theta: float, covariance: np.ndarray, radius: float, lam: float) -> tuple[float, float]:
    """Least and largest lam x^2 + z over the ellipse of (x, z) around (b, theta).

    In t = tan(angle / 2) the slope is a polynomial of degree four; its roots and a coarse grid are tried.
    """
    low = np.linalg.cholesky(covariance)
    one, circle = np.array([1.0, 0, 1]), np.array([-1.0, 0, 1])
    bend = np.polymul([-4 * lam * low[0, 0], 0], b * one + radius * low[0, 0] * circle)
    tilt = np.polymul(np.polyadd([-2 * low[1, 0], 0], low[1, 1] * circle), one)
    angle = np.append(2 * np.arctan(np.roots(np.polyadd(bend, tilt)).real), np.linspace(-np.pi, np.pi, 4097))
    x, z = b + radius * low[0, 0] * np.cos(angle), theta + radius * (low[1, 0] * np.cos(angle) + low[1, 1] * np.sin(angle))
    values = lam * x * x + z
    return float(values.min()), float(values.max())


STATUS = ("ok", "nonpositive_variance", "singular", "interval_failed")
SCHEMA = (
    "component string, estimate double, highrank_se double, normal_lower double, normal_upper double, q1_lower double, q1_upper double, regime string, lower double, upper double, "
    "variance_share double, curvature double, critical double, eigenvalue double, eigen_share double, max_weight_sq double, converged boolean, q1_status string"
)


def interval(x: dict, level: float, seed: int) -> dict:
    """Status, curvature, critical value and bounds of one target."""
    v, r, cov, lam = x["variance"], x["remainder"], x["covariance"], x["value"]
    if not (v > 0 and r > 0):
        return {"status": 1}
    rho = cov / np.sqrt(v * r)
    free = (1 - abs(rho)) * (1 + abs(rho))
    if not free > 1e-8:
        return {"status": 2}
    curvature = 2 * abs(lam) * v / np.sqrt(r * free)
    z = critical(curvature, level, seed)
    low, high = extremes(x["score"], x["theta"], np.array([[v, cov], [cov, r]]), z, lam)
    return {"status": 0, "curvature": float(curvature), "critical": z, "low": low, "high": high} if np.isfinite([low, high]).all() else {"status": 3}


def table(corrected: tuple, v: np.ndarray, pieces: list[dict], lead: Leading, spec: PanelSpec) -> list[tuple]:
    """Rows of SCHEMA. auto takes the interval of the leading direction where that carries over a tenth of the variance or there is no
    normal one, but never for the total; highrank never; q1 wherever it exists."""
    z = NormalDist().inv_cdf(0.5 + spec.level / 200)
    out = []
    for t, (name, b, var, x) in enumerate(zip(exact.TARGETS, corrected, np.diag(v), pieces, strict=True)):
        i = interval(x, spec.level, spec.inference_seed + t + 1)
        normal = se = share = None
        if var > 0:
            se, lam, w = float(np.sqrt(var)), x["value"], x["variance"]
            normal = (b - z * se, b + z * se)
            share = (4 * lam**2 * max(x["score"] ** 2 - w, 0) * w + 2 * lam**2 * w**2) / float(var)
        q1 = (i["low"] + b - x["point"], i["high"] + b - x["point"]) if i["status"] == 0 else None
        wanted = spec.inference == "q1" or (spec.inference == "auto" and t < 3 and (normal is None or share > 0.1))
        regime = "q1" if q1 and wanted else "normal" if normal else None
        low, high = {"q1": q1, "normal": normal}.get(regime) or (None, None)
        out.append((name, float(b), se, *(normal or (None, None)), *(q1 or (None, None)), regime, low, high, share, i.get("curvature"), i.get("critical"), x["value"], x["eigen_share"], x["max_weight"], bool(lead.converged[t]), STATUS[i["status"]]))
    return out
