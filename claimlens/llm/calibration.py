"""Isotonic calibration from binned counts: its input has a fixed number of bins, whatever the number of rows."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ordered by x; the blocks' mean x and smoothed, rising rates."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        if totals[i] <= 0:
            continue
        # Half a row of either kind keeps rates off 0 and 1.
        blocks.append([float(positives[i]), float(totals[i]), float(x[i] * totals[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], np.maximum.accumulate((b[:, 0] + 0.5) / (b[:, 1] + 1.0))
