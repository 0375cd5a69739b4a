"""Runs of periodic words in texts, by the branching-tandem test on an enhanced suffix array.

A task takes some megabytes of texts at once. A run of length L >= exponent * period makes the words at its start come again one
period later for L - period words, so texts that hold no sequence of that many words twice are done with after one sort
of hashed windows. Of the others all suffixes, text by text, are sorted together by prefix doubling, which only sorts again
those that aren't alone yet; the ranks of each round stay and give common lengths of any two places, forwards and backwards.

The suffix array, its inverse (ISA) and the lengths of common prefixes (LCP) stand for the suffix tree: each place with LCP value l lies in
one interval of depth l, found by descent over range minima, and cuts it into children. For every suffix i of all
children but the largest, i + l or i - l is looked up by ISA: inside the interval and outside the child, it is a square of
period l that can't be turned to the right. Turned to the left as far as words agree it is a run; squares of a multiple of the
period end up as the same stretch, whose smallest period counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.spread import in_runs
from telluric.llm.words import SPACE, content, find, hashed, joined, mixed

AT_ONCE = 2 << 20
BASE = 0x9E3779B97F4A7C15
RUNS = "array<struct<start: long, length: long, period: long>>"


def numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same words only."""
    a, b = hashed(data, start, end, 1), hashed(data, start, end, 2)
    _, at, out = np.unique(a, return_index=True, return_inverse=True)
    if np.array_equal(b[at][out], b):
        return out
    order = np.lexsort((b, a))
    out[order] = np.cumsum(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))) - 1
    return out


def candidates(word: np.ndarray, text: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts that have some sequence of width words twice, and perhaps a few more."""
    n = len(word)
    at = np.flatnonzero(first[1:][text] - np.arange(n) >= width)
    if not len(at):
        return at
    power = np.cumprod(np.full(n, BASE, np.uint64))
    inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(word.astype(np.uint64) + np.uint64(1)) * power)])
    key = mixed((sums[at + width] - sums[at]) * inverse[at]) ^ mixed(text[at].astype(np.uint64))
    order = np.argsort(key)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(text[at[order[again]]])


class Suffixes:
    """The suffixes of several texts, sorted text by text. begin and end: those of the text of each place."""

    def __init__(self, word: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = len(word)
        self.begin, self.end = begin, end
        self.order = np.lexsort((word, text))
        new = np.append(True, (word[self.order][1:] != word[self.order][:-1]) | (text[self.order][1:] != text[self.order][:-1]))
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        #: Ranks by the first 1, 2, 4 ... words: of equal rank are places of one text that have these words in common.
        self.levels = [rank.astype(np.int32)]
        width = 1
        while True:
            at = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(at):
                break
            place = self.order[at]
            onward = np.where(place + width < end[place], rank[np.minimum(place + width, n - 1)] + 1, 0)
            key = rank[place] * (n + 1) + onward
            sort = np.argsort(key, kind="stable")
            place, key = place[sort], key[sort]
            self.order[at] = place
            new[at] = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[place] = np.maximum.accumulate(np.where(new[at], at, 0))
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.inverse = rank

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words two places of one text have in common from there on."""
        out = np.zeros(len(i), np.int64)
        end, last = self.end[i], len(self.order) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = i + out, j + out
            same = self.levels[k][np.minimum(x, last)] == self.levels[k][np.minimum(y, last)]
            out += (same & (np.maximum(x, y) + (1 << k) <= end)).astype(np.int64) << k
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words two places of one text have in common right before them."""
        out = np.zeros(len(i), np.int64)
        begin = self.begin[i]
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = i - out - (1 << k), j - out - (1 << k)
            same = self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)]
            out += (same & (np.minimum(x, y) >= begin)).astype(np.int64) << k
        return out

    def common(self) -> np.ndarray:
        """LCP: what each suffix has in common with the one before it in order; 0 for a text's first."""
        out = np.zeros(len(self.order), np.int64)
        i, j = self.order[:-1], self.order[1:]
        own = np.flatnonzero(self.begin[i] == self.begin[j])
        out[own + 1] = self.forwards(i[own], j[own])
        return out


def _reach(value: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """For each place, how many values from there on in a row are as high as its own or higher."""
    n, mins = len(value), [value]
    while 2 << len(mins) - 1 <= longest:
        half = 1 << len(mins) - 1
        mins.append(np.append(np.minimum(mins[-1][:-half], mins[-1][half:]), mins[-1][-half:]))
    out = np.zeros(len(at), np.int64)
    for k in range(len(mins) - 1, -1, -1):
        x = at + out
        out += ((x + (1 << k) <= n) & (mins[k][np.minimum(x, n - 1)] >= value[at])).astype(np.int64) << k
    return out


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, every number from begin[k] to end[k])."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size - begin, size)


def squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares that can't be turned to the right; some may come twice."""
    lcp, n = s.common().astype(np.int32), len(s.order)
    cut = np.flatnonzero(lcp > 0)
    if not len(cut):
        return cut, cut
    longest = int((s.end - s.begin).max())
    high = cut + _reach(lcp, cut, longest)
    low = cut - _reach(lcp[::-1], n - 1 - cut, longest)
    # children of each interval [low, high): from cut to cut
    order = np.lexsort((cut, high, low))
    cut, low, high = cut[order], low[order], high[order]
    head = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    interval = np.cumsum(head) - 1
    upto = np.where(np.append(head[1:], True), high, np.append(cut[1:], 0))
    depth, left, right = lcp[cut[head]].astype(np.int64), low[head], high[head]
    own = np.concatenate([interval, np.arange(len(depth))])
    begin, end = np.concatenate([cut, left]), np.concatenate([upto, cut[head]])
    order = np.lexsort((begin - end, own))
    small = order[np.append(False, own[order][1:] == own[order][:-1])]
    of, at = _spread(begin[small], end[small])
    child = small[of]
    period, i = depth[own[child]], s.order[at]
    places, periods = [], []
    for square, other in ((i, i + period), (i - period, i - period)):
        inside = np.flatnonzero((other >= s.begin[i]) & (other < s.end[i]))
        rank, c = s.inverse[other[inside]], child[inside]
        found = inside[(rank >= left[own[c]]) & (rank < right[own[c]]) & ~((rank >= begin[c]) & (rank < end[c]))]
        places.append(square[found])
        periods.append(period[found])
    return np.concatenate(places), np.concatenate(periods)


def runs(word: np.ndarray, first: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least length words and exponent periods, by start, then period; word start numbers go over all texts."""
    n = len(word)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    some = candidates(word, text, first, -(-length * (exponent - 1) // exponent))
    _, place = _spread(first[some], first[some + 1])
    if not len(place):
        return place, place, place
    size = first[some + 1] - first[some]
    end = np.repeat(np.cumsum(size), size)
    s = Suffixes(word[place], text[place], end - np.repeat(size, size), end)
    i, period = squares(s)
    back = s.backwards(i, i + period)
    start, long = i - back, back + 2 * period
    keep = long >= np.maximum(length, exponent * period)
    found = np.unique(np.stack([start[keep], long[keep], period[keep]], axis=1), axis=0)
    found = found[np.append(True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1]))[: len(found)]]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return place[found[:, 0]], found[:, 1], found[:, 2]


def _run(length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "text", AT_ONCE):
            data, offsets = content(batch["text"])
            start, end, first = find(data, offsets, ~SPACE)
            at, long, period = runs(numbers(data, start, end), first, length, exponent)
            n = len(start)
            again = np.zeros(n + 1, np.int64)
            np.add.at(again, at + period, 1)
            np.add.at(again, at + long, -1)
            take = np.flatnonzero(np.cumsum(again[:-1]) == 0)
            text = np.searchsorted(first, at, "right") - 1
            rows = pa.StructArray.from_arrays([pa.array(at - first[text]), pa.array(long), pa.array(period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.diff(first)), lists, joined(data, start, end, first, take)], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 24, exponent: int = 3) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (start, length and period in words, by start, then period), collapsed.

    A run is a longest stretch of words in which words one period apart are the same, of at least length words and exponent (2 or
    more) times its smallest period. collapsed has the words, joined by one space, without those that some run holds beyond its first period.
    Null and empty texts have no words and no runs. Rows are judged one by one: ids may be of any type, null or repeated. Other
    columns, whatever their names, are left aside. Empty tables give empty results. A text is taken whole: one with runs of millions of words takes a task some
    hundred bytes a word.
    """
    if length < 1 or exponent < 2:
        raise ValueError("runs have one word and two periods at least")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    out = rows.mapInArrow(_run(length, exponent), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
