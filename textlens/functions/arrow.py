"""Helpers of operators that work on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are looked at together.
PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` characters; a longer text is a batch of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def free_name(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken``, in any letter case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base
