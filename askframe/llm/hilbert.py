"""Hilbert curve indexes of integer grid points, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each point, from 0 to ``2 ** (len(axes) * bits) - 1``.

    ``axes`` holds one array per dimension with whole numbers below ``2 ** bits``; together the
    dimensions may have 62 bits. Points next to each other on the curve are next to each other in
    space: they differ by one in one dimension.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError("a curve index has at most 62 bits")
    x = [np.asarray(a).astype(np.uint64) for a in axes]
    zero = np.uint64(0)
    # From the coarsest bit down, undo the rotations and reflections of the sub-cubes.
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            flipped = (x[i] & bit) != zero
            swap = np.where(flipped, zero, (x[0] ^ x[i]) & below)
            x[0] = np.where(flipped, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    # Gray code over the dimensions.
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        on = (x[n - 1] & np.uint64(1 << level)) != zero
        turn = np.where(on, turn ^ np.uint64((1 << level) - 1), turn)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << np.uint64(1)) | (((x[i] ^ turn) >> np.uint64(level)) & np.uint64(1))
    return index.astype(np.int64)
