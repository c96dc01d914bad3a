"""TwoWay(spec).fit(df): sample, fit, correction, and the tables to report."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .operators import centering, collapse, controls, cut, exact, firmwise, graph, inference, leading, numerical, projection, small_table
from .operators import jla as random_probes, joint as joint_controls
from .sources import freeze
from .spec import PanelSpec, Withheld


@dataclass
class FitResult:
    spec: PanelSpec
    rows: DataFrame
    facts: dict
    kernels: DataFrame
    firms: DataFrame
    plugin: tuple
    bias: tuple
    max_leverage: float
    by_source: DataFrame
    draws: np.ndarray | None = None
    seconds: dict | None = None
    solver: firmwise.Solver | None = None
    exact: bool = True

    @property
    def spark(self):
        return self.rows.sparkSession

    def results(self) -> DataFrame:
        """Rows plugin, bias_correction, corrected, mcse_conditional (see numerical); the four targets as columns."""
        rows = [("plugin", *self.plugin), ("bias_correction", *self.bias), ("corrected", *(a - b for a, b in zip(self.plugin, self.bias, strict=True))), ("mcse_conditional", *self.mcse)]
        return small_table(self.spark, [(a, *map(float, b)) for a, *b in rows], "row string, " + ", ".join(f"{t} double" for t in exact.TARGETS))

    @cached_property
    def _numerical(self) -> tuple:
        return numerical.finalize(numerical.of_mean(self.draws) if self.draws is not None else np.zeros((3, 3)))

    @property
    def mcse(self) -> tuple:
        return self._numerical[2]

    def numerical(self) -> DataFrame:
        """Covariance of the corrected targets over the target draws, given the leverages (0 for exact): target, mcse, a row of the 4 x 4 covariance, status."""
        status, v, mcse = self._numerical
        full = inference.expand(v)
        return small_table(self.spark, [(t, float(m), *map(float, r), status) for t, m, r in zip(exact.TARGETS, mcse, full, strict=True)], "target string, mcse double, " + ", ".join(f"{t} double" for t in exact.TARGETS) + ", status string")

    def moments(self) -> DataFrame:
        """Variances of the outcome and of the residual, and the explained share: one row."""
        return collapse.residual_moments(self.rows, self.kernels, self.firms)

    def computation(self) -> DataFrame:
        """How the result was computed: item, value."""
        spec, s = self.spec, self.solver
        facts = {"algorithm": "exact" if self.exact else "jla", "requested": spec.algorithm, "solver": "dense" if s.inverse is not None else "conjugate gradients", "firms": s.k, "max_leverage": self.max_leverage}
        if not self.exact:
            facts |= {"probes": spec.probes, "seed": spec.seed, "tolerance": spec.tolerance, "maxiter": spec.maxiter, "iterations": s.iterations, "numerical": self._numerical[0]}
        facts |= {f"seconds_{k}": round(v, 3) for k, v in (self.seconds or {}).items()}
        return small_table(self.spark, [(k, str(v)) for k, v in facts.items()], "item string, value string")

    def decomposition(self, full: bool = False) -> DataFrame:
        """Components worker, firm, sorting (twice the covariance), total: plug-in and corrected values and shares of the total and of the outcome's variance.

        full: also residual and outcome by frequency mass, plug-in values only.
        """
        var = collapse.outcome_moments(self.rows).first()["target_variance"]
        corrected = [a - b for a, b in zip(self.plugin, self.bias, strict=True)]
        out = []
        for name, k, c in (("worker", 0, 1), ("firm", 1, 1), ("sorting", 2, 2), ("total", 3, 1)):
            p, q = c * self.plugin[k], c * corrected[k]
            out.append((name, p, p / self.plugin[3], p / var, p - q, q, q / corrected[3], q / var))
        if full:
            m = self.moments().first()
            whole = m["regression_outcome_variance"]
            out += [(name, x, None, x / whole, None, None, None, None) for name, x in (("residual", m["residual_variance"]), ("outcome", whole))]
        return small_table(self.spark, [(a, *(None if x is None else float(x) for x in b)) for a, *b in out], "component string, plugin double, plugin_share double, plugin_outcome_share double, bias double, corrected double, corrected_share double, corrected_outcome_share double")

    @property
    def corrected(self) -> tuple:
        return tuple(a - b for a, b in zip(self.plugin, self.bias, strict=True))

    @cached_property
    def _sampling(self) -> tuple:
        if self.spec.inference == "none":
            raise Withheld("INVALID_OPTION", "inference='none'")
        if not self.exact or self.spec.centering == "corrected" or any(c[0] == "z" and c[1:].isdigit() for c in self.rows.columns):
            raise Withheld("INVALID_OPTION", "standard errors need the exact algorithm, no controls, and centering none or mean")
        return inference.estimate(self.rows, self.kernels, self.firms, self.spec, self.solver, self.corrected, self._mean())

    @cached_property
    def _intervals(self) -> list[tuple]:
        v, pieces, lead = self._sampling
        return leading.table(self.corrected, v, pieces, lead, self.spec)

    @property
    def covariance(self) -> np.ndarray:
        """4 x 4 sampling covariance of the corrected targets (exact algorithm without controls); only where all four intervals are normal."""
        v, pieces, _ = self._sampling
        if pieces and any(x[7] != "normal" for x in self._intervals):
            raise Withheld("INTERVALS_NOT_NORMAL")
        return v

    def _mean(self) -> float:
        return self.rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0] if self.spec.centering == "mean" else 0.0

    def projection(self) -> DataFrame:
        """Regression of the effect named by the options on a constant and covariates: coefficient, leave-out and naive standard errors."""
        if not self.exact or not self.spec.project or self.spec.centering == "corrected" or any(c[0] == "z" and c[1:].isdigit() for c in self.rows.columns):
            raise Withheld("INVALID_OPTION", "a projection needs project=..., the exact algorithm, no controls, and centering none or mean")
        units = inference.units(self.rows, self.kernels, self.firms, self.spec, self._mean())
        b, robust, naive = projection.regress(self.rows, self.kernels, self.firms, units, self.spec, self.solver)
        rows = zip(("constant", *self.spec.project), b, np.sqrt(np.diag(robust)), np.sqrt(np.diag(naive)), strict=True)
        return small_table(self.spark, [(t, *map(float, x)) for t, *x in rows], "term string, coefficient double, se double, naive_se double")

    def inference(self) -> DataFrame:
        """Standard errors of the four corrected targets (null where the variance isn't positive) and the interval that the rule takes."""
        v, pieces, _ = self._sampling
        rows = [(x[0], x[1], x[2], x[8], x[9]) for x in self._intervals] if pieces else inference.intervals(self.corrected, v, self.spec.level)
        return small_table(self.spark, rows, "component string, estimate double, se double, lower double, upper double")

    def intervals(self) -> DataFrame:
        """Normal intervals, those of the leading direction, which of them the rule takes, and what it goes by."""
        if self.spec.inference == "highrank":
            raise Withheld("INVALID_OPTION", "inference='highrank' looks for no leading direction")
        return small_table(self.spark, self._intervals, leading.SCHEMA)

    def lincom(self, weights: tuple) -> tuple[float, float]:
        """(value, standard error) of a linear combination of the four corrected targets."""
        a = np.asarray(weights, float)
        return float(a @ self.corrected), float(np.sqrt(a @ self.covariance @ a))

    def sample(self) -> DataFrame:
        """Counts of the selection, step by step."""
        return small_table(self.spark, [(k, int(v)) for k, v in self.facts.items()], "step string, count long")

    def diagnostics(self) -> DataFrame:
        return self.by_source

    def effects(self, which: str) -> DataFrame:
        """Worker effects (w, alpha) or firm effects (f, psi)."""
        if which == "firm":
            return self.kernels.select("j", "psi").distinct().join(self.firms, "j").select("f", "psi")
        found = self.kernels.groupBy(F.col("w").alias("hw")).agg(F.max("alpha").alias("alpha"))
        return self.rows.select("w").distinct().withColumn("hw", F.xxhash64("w")).join(found, "hw").select("w", "alpha")


class TwoWay:
    def __init__(self, spec: PanelSpec):
        self.spec = spec.validate()

    def fit(self, df: DataFrame) -> FitResult:
        started = time.monotonic()
        spec = self.spec
        rows = cut(freeze(df, spec))
        read = time.monotonic()
        rows, facts = graph.select(rows, spec)
        done = time.monotonic()
        result = self._solve(rows, facts)
        result.seconds = {"read": read - started, "sample": done - read, "fit": time.monotonic() - done}
        return result

    def _solve(self, rows: DataFrame, facts: dict) -> FitResult:
        spec = self.spec
        jla = spec.algorithm == "jla"
        if spec.algorithm == "auto":
            firms, columns = rows.select("f").distinct().count(), sum(c[0] == "z" and c[1:].isdigit() for c in rows.columns)
            jla = firms + columns > spec.exact_limit
        names, b, gram = controls.coefficients(rows, spec, spec.firm_cells if jla else spec.exact_limit)
        joint = bool(names) and spec.nuisance == "joint"
        if spec.centering == "corrected":
            if jla or joint:
                raise Withheld("INVALID_OPTION", "corrected centering needs the exact algorithm, and no joint controls")
        rows = rows.withColumn("yo", controls.offset(b))
        if names and not joint:
            rows = rows.withColumn("y", F.col("yo"))
        rows = cut(rows)
        if jla:
            return self._random(rows, facts, names if joint else None, gram)
        _, _, firms, fit, k = exact.fit(rows.withColumn("y", F.col("yo")), spec)
        solver = firmwise.Solver(None, len(fit.inverse), spec, fit.inverse)
        if joint:
            cells, big_m = joint_controls.geometry(rows, firms, names, solver)
            by = cut(joint_controls.correction(rows, k, firms, cells, gram, big_m, names, spec))
        else:
            units = collapse.units(rows).join(rows.select("unit", "mover").distinct(), "unit") if spec.deletion == "match" else collapse.units(rows).withColumn("mover", F.lit(True))
            by = cut(exact.correction(units, k, firms, replace(spec, centering="mean") if spec.centering == "corrected" else spec, fit.mean))
        got = by.agg(F.max("max_leverage").alias("h"), *[F.sum(t).alias(t) for t in exact.TARGETS]).first()
        if got["h"] >= 1 - 1e-10:
            raise Withheld("NONESTIMABLE_UNIT", f"largest leverage {got['h']}")
        bias = tuple(got)[1:]
        if spec.centering == "corrected":
            a, b, c = centering.increment(inference.units(rows, k, firms, spec, fit.mean), spec, solver.k)
            bias = tuple(x - y for x, y in zip(bias, (a, b, c, a + b + 2 * c), strict=True))
        return FitResult(spec, rows, facts, k, firms, tuple(exact.plugin(k).first()), bias, got["h"], by, solver=solver)

    def _random(self, rows: DataFrame, facts: dict, names: list[str] | None, gram: np.ndarray) -> FitResult:
        firms, k, draws, by, solver = random_probes.fit(rows, self.spec, names, gram)
        draws = np.vstack([draws, draws[0] + draws[1] + 2 * draws[2]])
        got = by.agg(F.max("max_leverage").alias("h"), F.min("least_left").alias("left")).first()
        if got["left"] <= 1e-10:
            raise Withheld("NONESTIMABLE_UNIT", f"least share left {got['left']}")
        return FitResult(self.spec, rows, facts, k, firms, tuple(exact.plugin(k).first()), tuple(map(float, draws.mean(axis=1))), got["h"], by, draws[:3], solver=solver, exact=False)
