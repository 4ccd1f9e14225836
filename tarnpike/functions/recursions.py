"""Recursions over arrays, without Spark: what grouped functions run inside a task."""

from __future__ import annotations

import numpy as np


def ewm(x: np.ndarray, alpha: float, start: int = 1) -> np.ndarray:
    """y[t] = alpha x[t] + (1 - alpha) y[t - 1], begun by the mean of the first ``start`` known values; unknown values carry y on."""
    out, y, seen, total = np.full(len(x), np.nan), np.nan, 0, 0.0
    for t, value in enumerate(x):
        if value == value:
            seen += 1
            if seen <= start:
                total += value
                if seen == start:
                    y = total / start
            else:
                y = alpha * value + (1 - alpha) * y
        out[t] = y
    return out
