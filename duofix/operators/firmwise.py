"""Firm-by-column matrices: summed by Spark, solved against on the driver.

A task sends its sums by firm in rows of 32 columns. The driver holds firms x columns, never worker
vectors; the product is checked against `spec.firm_cells`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..spec import PanelSpec, Withheld
from . import exact

WIDE = 32
NUMBERS = 2**18  # of an array of a block: 2 MB, so that a task holds some 30 MB however many rows and columns there are
COLUMNS = [f"c{i}" for i in range(WIDE)]
SCHEMA = "j int, part int, " + ", ".join(f"{c} double" for c in COLUMNS)


def added(j: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each j once, rows of x added up by j)."""
    order = np.argsort(j, kind="stable")
    js = j[order]
    first = np.flatnonzero(np.concatenate([[True], js[1:] != js[:-1]]))
    return js[first], np.add.reduceat(x[order], first, axis=0)


def summed(parts):
    """Batches of SCHEMA from pairs (j, x): rows of x added up by j, over all pairs of a task unless the sums get too many."""

    def send(j, x):
        key = pa.array(j.astype(np.int32))
        for part in range(0, x.shape[1], WIDE):
            cols = [pa.array(x[:, part + i] if part + i < x.shape[1] else np.zeros(len(j))) for i in range(WIDE)]
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(j), part // WIDE, np.int32)), *cols], ["j", "part", *COLUMNS])

    held = []
    merge = lambda: added(*map(np.concatenate, zip(*held, strict=True)))
    for j, x in parts:
        held.append(added(np.asarray(j), x))
        if len(held) > 100 or sum(y.size for _, y in held) > 2 * NUMBERS:
            held = [merge()]
            if held[0][1].size > NUMBERS:
                yield from send(*held.pop())
    if held:
        yield from send(*merge())


def collect(df: DataFrame, pairs, rows: int, width: int) -> np.ndarray:
    """The rows x width matrix of sums by j of what `pairs` makes of the batches of df: pairs (j, x)."""
    t = df.mapInArrow(lambda batches: summed(pairs(batches)), SCHEMA).groupBy("j", "part").agg(*[F.sum(c).alias(c) for c in COLUMNS]).toArrow()
    out = np.zeros((rows, -(-width // WIDE) * WIDE))
    j, part = t["j"].to_numpy(), t["part"].to_numpy().astype(np.int64)
    values = np.column_stack([t[c].to_numpy() for c in COLUMNS])
    out[j[:, None], part[:, None] * WIDE + np.arange(WIDE)] = values
    return out[:, :width]


class Workers:
    """Whole workers of a sorted table: sums over a worker, and predictions of firm vectors."""

    def __init__(self, t: pa.Table):
        self.col = {c: t.column(c).to_numpy() for c in t.column_names}
        self.j, self.n = self.col["j"].astype(np.int64), self.col["n"]
        w = self.col["w"]
        self.first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        self.who = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(w))))
        self.nw = self.total(self.n)
        self.p = self.n / self.nw

    def total(self, x: np.ndarray) -> np.ndarray:
        """Per row, the sum over its worker."""
        return np.add.reduceat(x, self.first, axis=0)[self.who]

    def away(self, x: np.ndarray) -> np.ndarray:
        """Per row, x at its firm less the worker's mean over firms."""
        v = x[self.j]
        return v - self.total(self.p[:, None] * v)


def rows_for(columns: int) -> int:
    """Rows of a block whose widest array has so many columns."""
    return max(1, min(20_000, NUMBERS // max(1, columns)))


def whole_workers(batches, columns: int):
    """Whole workers, some at a time; columns: of the widest array that is made of them."""
    for t in exact.tables(batches, rows_for(columns)):
        yield Workers(t)


class Solver:
    """psi = S^- rhs for many columns; S is the firm Laplacian of cells (w, j, n, ...) dealt and sorted by worker.

    Up to `exact_limit` firms by a dense inverse; beyond, by conjugate gradients in lock step with the
    diagonal as preconditioner, one pass over the cells an iteration. A solution counts only when its
    explicit residual is within max(1e-11, 10 * tolerance).
    """

    def __init__(self, cells: DataFrame, k: int, spec: PanelSpec, inverse: np.ndarray | None = None):
        self.cells, self.k, self.spec = cells, k, spec
        self.iterations = 0
        self.inverse = inverse
        if inverse is None and k <= spec.exact_limit:
            self.inverse = exact.solve(cells, k).inverse
        if self.inverse is None:

            def diagonal(batches):
                for b in whole_workers(batches, 1):
                    yield b.j, (b.n * (1 - b.p))[:, None]

            self.diagonal = collect(cells, diagonal, k, 1)
            if k > 1 and self.diagonal.min() <= 0:
                raise Withheld("NO_LEAVEOUT_COMPONENT", "a firm without movers")

    def times(self, x: np.ndarray) -> np.ndarray:
        shared, width = self.cells.sparkSession.sparkContext.broadcast(x), x.shape[1]

        def run(batches):
            for b in whole_workers(batches, width):
                yield b.j, b.n[:, None] * b.away(shared.value)

        out = collect(self.cells, run, self.k, width)
        shared.destroy()
        return out

    def __call__(self, rhs: np.ndarray) -> np.ndarray:
        if rhs.size > self.spec.firm_cells:
            raise Withheld("FIRM_VECTORS", f"{rhs.shape[0]} firms by {rhs.shape[1]} columns")
        if self.inverse is not None:
            return self.inverse @ rhs
        x, r = np.zeros_like(rhs), rhs - rhs.mean(0)
        size = np.sqrt((r * r).sum(0))
        size[size == 0] = 1
        z = r / self.diagonal
        p, rz = z.copy(), (r * z).sum(0)
        for step in range(1, self.spec.maxiter + 1):
            live = np.sqrt((r * r).sum(0)) > self.spec.tolerance * size
            if not live.any():
                break
            at = np.flatnonzero(live)
            sp = self.times(p[:, at])
            self.iterations += len(at)
            a = rz[at] / (p[:, at] * sp).sum(0)
            x[:, at] += a * p[:, at]
            r[:, at] -= a * sp
            if step % 100 == 0:
                r[:, at] = (rhs - rhs.mean(0))[:, at] - self.times(x[:, at])
            z[:, at] = r[:, at] / self.diagonal
            new = (r[:, at] * z[:, at]).sum(0)
            p[:, at] = z[:, at] + new / rz[at] * p[:, at]
            rz[at] = new
        left = np.sqrt((((rhs - rhs.mean(0)) - self.times(x)) ** 2).sum(0)) / size
        if left.max() > max(1e-11, 10 * self.spec.tolerance):
            raise Withheld("NOT_CONVERGED", f"residual {left.max():.3g} after {self.spec.maxiter} iterations")
        return x - x[-1]
