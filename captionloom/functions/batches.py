"""Arrow batches in Python tasks: a batch may hold 64 MB of rows, so it is made into Python values a bounded part at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cues, and bytes of text, that a part holds.
CUES, TEXT = 20_000, 2 << 20


def parts(batch: pa.RecordBatch, by: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose lists (or texts, in bytes) in column `by` sum up to `most`, or one row that is longer."""
    held = batch.column(by)
    length = pc.binary_length(held) if pa.types.is_string(held.type) or pa.types.is_large_string(held.type) else pc.list_value_length(held)
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def cues_of(held: pa.ListArray) -> Iterator[list[tuple[float, float, str]]]:
    """Each row's cues (start, end, text), out of the columns that all rows' cues lie in."""
    flat = held.flatten()
    rows = list(zip(flat.field("start").cast(pa.float64()).to_pylist(), flat.field("end").cast(pa.float64()).to_pylist(), flat.field("text").to_pylist(), strict=True))
    at = 0
    for n in pc.list_value_length(held).fill_null(0).to_pylist():
        yield rows[at : at + n]
        at += n
