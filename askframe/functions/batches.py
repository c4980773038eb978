"""Arrow batches in pieces of bounded size.

Spark counts the rows of a batch, so one of long texts may hold a hundred megabytes, and what Python
makes of it many times that. Iterator UDFs may hand on their rows in other batches than they came
in, so what lies in memory at once need not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18


def piece_edges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """First and end row of pieces of consecutive rows that hold at most ``limit`` together, or of
    single rows; an empty batch is one empty piece."""
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start, before = stop, ends[stop - 1]
    if not len(ends):
        yield 0, 0


def pieces(texts: pa.Array, *others: pa.Array, limit: int = PIECE_BYTES) -> Iterator:
    """``texts`` piece by piece; with ``others``, their rows beside them as a tuple."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in piece_edges(sizes, limit):
        found = [column.slice(start, stop - start) for column in (texts, *others)]
        yield tuple(found) if others else found[0]


def even_pieces(values: pa.Array, limit: int = 16 * PIECE_BYTES) -> Iterator[pa.Array]:
    """A column of nested values in pieces of equally many rows, of about ``limit`` bytes each."""
    step = max(1, len(values) * limit // max(1, values.nbytes))
    for start in range(0, max(1, len(values)), step):
        yield values.slice(start, step)
