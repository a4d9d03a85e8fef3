"""Hilbert keys of points on an integer grid."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point along the Hilbert curve through the grid of ``bits`` bits an axis.

    ``points`` has a row a point and a column an axis; axes times bits are at most 63. This
    is the transpose form of the curve (Skilling 2004), done for all points at once.
    """
    axes = points.shape[1]
    if axes * bits > 63:
        raise ValueError("axes times bits must be at most 63")
    x = [points[:, i].astype(np.int64) for i in range(axes)]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            turned = (x[i] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] ^ flip) >> level & 1
    return key
