"""Arrow and NumPy helpers for tasks that encode each distinct word once and then write out every occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def in_runs(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches with about size bytes of text in a run: small batches are joined, large ones cut. No run is empty."""
    held: list[pa.RecordBatch] = []
    waiting = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.cumsum(np.diff(np.frombuffer(batch[text].buffers()[1], np.int32)[batch[text].offset : batch[text].offset + batch.num_rows + 1].astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(lengths, before + size - waiting, "right")))
            held.append(batch.slice(at, upto - at))
            waiting += int(lengths[upto - 1] - before)
            at = upto
            if waiting >= size or at < batch.num_rows:
                yield joined()
                held, waiting = [], 0
    if held:
        yield joined()


def written_out(values: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the 32-bit ids of values[k] for each k of index in a row, and how many each has."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    begins = np.cumsum(sizes) - sizes
    n = sizes[index]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - begins[index], n)], n
