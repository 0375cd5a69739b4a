"""White-space separated words of many texts at once, as NumPy arrays over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Words of more 8-byte lanes than this are hashed one by one.
LANES = 32
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def content(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls; offsets begin with 0."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not array.buffers()[2]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): bytes where each longest stretch of bytes of the class inside starts and ends, and the number of each text's first one, all of them at last."""
    own = inside[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.zeros(len(own), bool), np.zeros(len(own), bool)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(own & ~before)
    return start, np.flatnonzero(own & ~after) + 1, np.searchsorted(start, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each unsigned 64-bit integer, one to one, as another whose bits all depend on all of its bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = end - start
    out = mixed(size.astype(np.uint64) + np.uint64(seed << 32))
    rest = np.arange(len(start))
    for k in range(LANES):
        lane = lanes[start[rest] + 8 * k] & _LOW[np.minimum(size[rest] - 8 * k, 8)]
        out[rest] = mixed(out[rest] ^ lane)
        rest = rest[size[rest] > 8 * (k + 1)]
        if not len(rest):
            return out
    for k in rest.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    return out


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, take: np.ndarray) -> pa.Array:
    """Each text's words of the ascending numbers take, joined by one space."""
    own = np.zeros(len(data) + 1, np.int8)
    own[start] += 1
    own[end] -= 1
    body = data[np.cumsum(own[:-1]).astype(bool)] if len(data) else data
    ends = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(take, first).astype(np.int64)), words.take(pa.array(take)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
