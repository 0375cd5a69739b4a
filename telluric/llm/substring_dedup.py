"""Removal of word sequences that the corpus repeats, by a count-min prefilter and exact grouping.

Texts are gathered into chunks of a few megabytes, written once. Three passes go over the chunks:

1. Each chunk counts its windows (hashes of ``window`` consecutive words) in a count-min sketch of ``depth`` rows. A row
   has about one cell for each byte of the corpus and is cut into shards by cell; what a chunk sends to a shard's owner is
   the list of the cells that it has hit, once or more often, so that traffic follows the windows and not the size of the
   sketch. The owner adds up all chunks' counts and answers with one bit for each cell of a list: hit at least twice or not.
2. A window whose cells all are hit at least twice is estimated to be repeated. An estimate is never too low, so that
   none is lost. Only these windows are sent on, by 128-bit fingerprints, each once for a chunk, and grouped exactly: their owner answers
   with one bit for each, found twice or not.
3. The words that repeated windows cover are removed.

A chunk knows the order in which it has sent cells and fingerprints, as it makes them again from its texts, so the
answers hold nothing but bits. A very frequent window is one entry of each chunk's list and one row in no task.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved
from telluric.llm.spread import in_runs
from telluric.llm.words import SPACE, content, find, hashed, joined, mixed

#: Odd factors of the polynomials that hash a window.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
CHUNK = 4 << 20
#: Cells of a shard, and bytes of text for each shard of fingerprints, at most.
MOST_CELLS, MOST_BYTES = 1 << 27, 1 << 26


def _gather(size: int):
    """Rows of (id, text) as chunks of about size bytes of text, each one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "text", size):
            held = io.BytesIO()
            with pa.ipc.new_stream(held, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary()), pa.array([len(content(batch["text"])[0])])], ["rows", "bytes"])

    return run


class Chunk:
    """A chunk's words and windows."""

    def __init__(self, rows: bytes, window: int):
        self.batch = pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]
        self.data, offsets = content(self.batch["text"])
        self.start, self.end, self.first = find(self.data, offsets, ~SPACE)
        n = len(self.start)
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        self.at = np.flatnonzero(room >= window)
        self.keys = [self._keys(k, window, n) for k in range(2)] if len(self.at) else [np.zeros(0, np.uint64)] * 2

    def _keys(self, k: int, window: int, n: int) -> np.ndarray:
        """The hash of each window: a polynomial of its words' hashes, from prefix sums."""
        power = np.cumprod(np.full(n, BASES[k], np.uint64))
        inverse = np.cumprod(np.full(n, pow(BASES[k], -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed(self.data, self.start, self.end, k + 1) * power)])
        return mixed((sums[self.at + window] - sums[self.at]) * inverse[self.at])

    def cells(self, row: int, shards: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cells, their counts, where each shard's begin, cell of each window) of one row of the sketch, in ascending order."""
        x = mixed(self.keys[0] ^ np.uint64(row + 1))
        half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        cell = ((x >> half) * np.uint64(shards) >> half) << half | (x & low) * np.uint64(width) >> half
        found, of, count = np.unique(cell, return_inverse=True, return_counts=True)
        return found & low, count, np.searchsorted(found >> half, np.arange(shards + 1)), of

    def estimated(self, answers: list[dict] | None, depth: int, shards: int, width: int) -> np.ndarray:
        """Whether each window is estimated to be repeated."""
        out = np.ones(len(self.at), bool)
        by = {(x["row"], x["shard"]): x["bits"] for x in answers or []}
        for row in range(depth if len(out) else 0):
            _, _, cuts, of = self.cells(row, shards, width)
            out &= _answered(cuts, {s: bits for (r, s), bits in by.items() if r == row})[of]
        return out

    def prints(self, some: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first and second half of the different fingerprints, their counts, where each shard's begin, fingerprint of each window) of some windows."""
        a, b = self.keys[0][some], self.keys[1][some]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        of = np.empty(len(a), np.int64)
        of[order] = np.cumsum(new) - 1
        where = np.flatnonzero(new)
        a, b = a[where], b[where]
        half = np.uint64(32)
        return a, b, np.diff(np.append(where, len(order))), np.searchsorted((a >> half) * np.uint64(shards) >> half, np.arange(shards + 1)), of


def _answered(cuts: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """The answer to each entry of lists that begin at cuts."""
    out = np.zeros(cuts[-1], bool)
    for shard, found in bits.items():
        begin, end = cuts[shard], cuts[shard + 1]
        out[begin:end] = np.unpackbits(np.frombuffer(found, np.uint8), count=end - begin)
    return out


def _squeezed(values: np.ndarray) -> bytes:
    """Ascending 32-bit integers as compressed differences, lowest bytes first."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return len(values).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unsqueezed(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:4], "little")
    planes = np.frombuffer(pa.decompress(held[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[dict, Chunk]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, Chunk(row.pop("rows"), window)


def _sketch(window: int, depth: int, shards: int, width: int):
    """Rows of (row, shard, chunk, cells): the cells that a chunk has hit, times two, with one more where it has hit them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks(batches, window):
            for r in range(depth if len(chunk.at) else 0):
                cell, count, cuts, _ = chunk.cells(r, shards, width)
                value = cell << np.uint64(1) | (count > 1)
                out = [(r, s, row["chunk"], _squeezed(value[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts)).tolist()]
                yield _batch(out, ["row", "shard", "chunk", "cells"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])

    return run


def _merge(width: int):
    """A shard of the sketch, merged from all chunks' parts, and its answers: for each chunk one bit for each cell that it has hit."""

    def run(table: pa.Table) -> pa.Table:
        hit = np.zeros(width, np.uint8)
        for part in table["cells"]:
            value = _unsqueezed(part.as_py())
            cell = value >> np.uint32(1)
            hit[cell] = np.minimum(hit[cell] + 1 + (value & np.uint32(1)).astype(np.uint8), 2)
        bits = [np.packbits(hit[_unsqueezed(part.as_py()) >> np.uint32(1)] > 1).tobytes() for part in table["cells"]]
        return table.select(["chunk", "row", "shard"]).append_column("bits", pa.array(bits, pa.binary()))

    return run


def _candidates(window: int, depth: int, shards: int, width: int, owners: int):
    """Rows of (shard, chunk, prints): the fingerprints of windows that are estimated to be repeated, and whether the chunk has them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks(batches, window):
            a, b, count, cuts, _ = chunk.prints(np.flatnonzero(chunk.estimated(row["sketch"], depth, shards, width)), owners)
            out = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                out.append((s, row["chunk"], a[own].tobytes() + b[own].tobytes() + (count[own] > 1).tobytes()))
            if out:
                yield _batch(out, ["shard", "chunk", "prints"], [pa.int32(), pa.int64(), pa.binary()])

    return run


def _group(table: pa.Table) -> pa.Table:
    """For each chunk one bit for each fingerprint that it has sent: found twice or not."""
    parts = [x.as_py() for x in table["prints"]]
    sizes = [len(x) // 17 for x in parts]
    a = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(parts, sizes, strict=True)])
    b = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(parts, sizes, strict=True)])
    again = np.concatenate([np.frombuffer(x, np.uint8, n, 16 * n) for x, n in zip(parts, sizes, strict=True)])
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    found = (np.bincount(group) + np.bincount(group, again) > 1)[group]
    bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
    return table.select(["chunk", "shard"]).append_column("bits", pa.array(bits, pa.binary()))


def _finish(window: int, depth: int, shards: int, width: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks(batches, window):
            some = np.flatnonzero(chunk.estimated(row["sketch"], depth, shards, width))
            *_, cuts, of = chunk.prints(some, owners)
            at = chunk.at[some[_answered(cuts, {x["shard"]: x["bits"] for x in row["exact"] or []})[of]]]
            n = len(chunk.start)
            covered = np.zeros(n + 1, np.int64)
            covered[at] += 1
            covered[at + window] -= 1
            take = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
            words = np.diff(chunk.first)
            kept = np.diff(np.searchsorted(take, chunk.first))
            yield pa.RecordBatch.from_arrays(
                [chunk.batch["id"], pa.array(words), pa.array(words - kept), joined(chunk.data, chunk.start, chunk.end, chunk.first, take)],
                ["id", "n_words", "n_removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, depth: int = 2) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes when it lies in a window of consecutive words whose sequence starts anywhere else in docs, in the same text or
    another. Null texts count as empty; texts with fewer words than a window keep them all. Rows are told apart one by one, so ids
    may be of any type, null or repeated, and repeated rows take each other's windows away. Other columns, whatever their names, are
    left aside. Empty tables give empty results.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = saved(rows.mapInArrow(_gather(CHUNK), "rows binary, bytes long").withColumn("chunk", F.monotonically_increasing_id()), f"{path}/chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 1
    # as many shards as each has cells, up to a bound on cells
    width = min(MOST_CELLS, max(1 << 16, math.isqrt(size << 16)))
    shards, owners = -(-size // width), max(1, math.isqrt(size) // 600, -(-size // MOST_BYTES))
    chunks = chunks.select("chunk", "rows")
    parts = chunks.mapInArrow(_sketch(window, depth, shards, width), "row int, shard int, chunk long, cells binary")
    bits = parts.groupBy("row", "shard").applyInArrow(_merge(width), "chunk long, row int, shard int, bits binary")
    sketch = saved(bits.groupBy("chunk").agg(F.collect_list(F.struct("row", "shard", "bits")).alias("sketch")), f"{path}/sketch")
    estimated = chunks.join(sketch, "chunk", "left").mapInArrow(_candidates(window, depth, shards, width, owners), "shard int, chunk long, prints binary")
    bits = estimated.groupBy("shard").applyInArrow(_group, "chunk long, shard int, bits binary")
    exact = bits.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("exact"))
    answers = saved(sketch.join(exact, "chunk", "left"), f"{path}/answers")
    out = chunks.join(answers, "chunk", "left").mapInArrow(_finish(window, depth, shards, width, owners), f"id {kind}, n_words long, n_removed long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
