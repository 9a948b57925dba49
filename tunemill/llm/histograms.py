"""Thresholds from merged counts of a measure between 0 and 1."""

from __future__ import annotations

import numpy as np


def valley(n: np.ndarray) -> float:
    """The cut of counts by equal bins of [0, 1] with the greatest variance between both sides; the middle of equals."""
    if np.count_nonzero(n) < 2:
        return 1.0
    share = np.cumsum(n) / n.sum()
    sums = np.cumsum(n * np.arange(len(n))) / n.sum()
    with np.errstate(all="ignore"):
        apart = np.nan_to_num((sums[-1] * share - sums) ** 2 / (share * (1 - share)))
    return float((np.flatnonzero(apart >= apart.max() - 1e-12).mean() + 1) / (len(n) - 1))
