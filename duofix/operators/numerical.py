"""Numerical error of estimates from random draws."""

from __future__ import annotations

import numpy as np


def of_mean(draws: np.ndarray) -> np.ndarray:
    """Covariance of the means of the draws (targets x draws)."""
    return np.atleast_2d(np.cov(draws)) / draws.shape[1]


def finalize(v: np.ndarray, tolerance: float = 1e-12) -> tuple[str, np.ndarray, tuple]:
    """(status, usable 3 x 3 covariance, standard errors of the three targets and of their total).

    Eigenvalues below 0 by round-off are set to 0 (ok_local_psd_adjusted); beyond that there is no
    standard error (unstable_nonpsd, all NaN), as for entries that aren't finite (nonfinite_derivative).
    """
    none = np.full((3, 3), np.nan), (float("nan"),) * 4
    if not np.isfinite(v).all():
        return "nonfinite_derivative", *none
    size = np.abs(v).max()
    if size == 0:
        return "ok_local", np.zeros((3, 3)), (0.0,) * 4
    values, vectors = np.linalg.eigh((v + v.T) / (2 * size))
    if values[0] < -tolerance * np.abs(values).max():
        return "unstable_nonpsd", *none
    status = "ok_local" if values[0] >= 0 else "ok_local_psd_adjusted"
    usable = (v + v.T) / 2 if values[0] >= 0 else (vectors * np.maximum(values, 0)) @ vectors.T * size
    t = np.vstack([np.eye(3), [1, 1, 2]])
    return status, usable, tuple(map(float, np.sqrt(np.maximum(np.diag(t @ usable @ t.T), 0))))
