"""Arrow batches in pieces, so that what Python holds at once doesn't follow the size of the batches or of the table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(frames: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` of them and `most` bytes of `column`; a longer value stands alone."""
    for b in frames:
        for lo, hi in ranges(b.column(b.schema.get_field_index(column)), most, rows):
            yield b.slice(lo, hi - lo)


def ranges(values: pa.Array, most: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts or binaries, bounded as in `pieces`."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield lo, hi
        lo = hi
