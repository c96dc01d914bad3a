"""Texts for reports."""

from __future__ import annotations

import math


def share_text(share: float | None) -> str:
    """A share as a percentage; >100% above one, <0.1% below 0.0005, a point where there is none."""
    if share is None or math.isnan(share):
        return "."
    return ">100%" if share > 1 else "<0.1%" if share < 0.0005 else f"{100 * share:.1f}%"


def mcse_line(mcse: tuple, probes: int, errors: tuple | None = None) -> str:
    """One line on the numerical error; it warns where that is over a tenth of a standard error."""
    names = ("worker", "firm", "cov", "total")
    line = f"Numerical MCSE ({probes} projections): " + "  ".join(f"{n} {x:.2g}" for n, x in zip(names, mcse, strict=True))
    large = [n for n, x, e in zip(names, mcse, errors or (), strict=False) if e and x > 0.1 * e]
    return line + (f" (over 10% of the standard error: {', '.join(large)}; raise probes)" if large else "")
