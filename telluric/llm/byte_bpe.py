"""Byte-level BPE: encoding by merge replay over a corpus, and decoding.

A task cuts the texts of its part of the corpus into the matches of the vocabulary's pattern and gathers
those that it has not met yet. Once enough are waiting they are encoded together: their bytes lie in one
array of symbols with links to the next and the previous one, an inverted index leads from each token pair,
named by the rank of the token it makes, to the positions where it starts, and the merges are replayed in
rank order on all positions of a pair at once; only the pairs of touched neighbours are entered anew.
Memory is bounded by the number of distinct stretches of text that a task remembers (``remembered``) and by
the bytes of text that it takes at once (``waiting``).
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.spread import in_runs, written_out

NONE = np.int32(-1)


class Ranks:
    """A vocabulary's tokens by rank, and the rank that each pair of tokens merges into."""

    def __init__(self, lines: list[bytes]):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of symbols makes, or NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece: the lowest pair first, the leftmost of equals."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min((self.rank.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]


@cache
def ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks(f.read().splitlines())


def replay(pieces: list[bytes], v: Ranks) -> list[bytes]:
    """The ids of each piece (none empty) as little-endian unsigned 32-bit integers, all merged together in rank order."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    total = int(sizes.sum())
    symbol = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after = np.arange(1, total + 1, dtype=np.int32)
    after[begins + sizes - 1] = NONE
    before = np.arange(-1, total - 1, dtype=np.int32)
    before[begins] = NONE
    alive = np.ones(total, bool)
    odd: set[int] = set()
    start = np.flatnonzero(after >= 0).astype(np.int32)
    rank = v.of_pairs(symbol[start], symbol[after[start]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, made: np.ndarray) -> None:
        """Enter positions into the index by the rank that their pairs make."""
        known = made >= 0
        at, made = at[known], made[known]
        if not len(at):
            return
        order = np.argsort(made, kind="stable")
        at, made = at[order], made[order]
        cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
        for r, part in zip(made[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    enter(start, rank)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = np.unique(np.concatenate(parts) if len(parts) > 1 else parts[0])
        at = at[alive[at] & (after[at] >= 0)]
        if not len(at):
            continue
        at = at[v.of_pairs(symbol[at], symbol[after[at]]) == r]
        if not len(at):
            continue
        # the first of two pairs that share a symbol wins
        if len(at) > 1:
            clash = np.flatnonzero(after[at[:-1]] == at[1:])
            if len(clash):
                keep = np.ones(len(at), bool)
                for k in clash.tolist():
                    if keep[k]:
                        keep[k + 1] = False
                at = at[keep]
        gone = after[at]
        symbol[at] = r
        alive[gone] = False
        nxt = after[gone]
        after[at] = nxt
        has = nxt >= 0
        before[nxt[has]] = at[has]
        prev = before[at]
        left = prev[prev >= 0]
        right = at[has]
        both = np.concatenate([left, right])
        made = v.of_pairs(symbol[both], symbol[after[both]])
        # a new pair below the present rank would have to go first in its own piece: such pieces are encoded alone
        early = (made >= 0) & (made <= r)
        if early.any():
            odd.update(word[both[early]].tolist())
            made = np.where(early, NONE, made)
        enter(both, made)
    left = np.flatnonzero(alive)
    counts = np.bincount(word[left], minlength=len(pieces))
    ids, ends = symbol[left].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    out = [ids[b:e] for b, e in zip([0, *ends], ends, strict=False)]
    for k in odd:
        out[k] = np.array(v.one(pieces[k]), "<u4").tobytes()
    for k, piece in enumerate(pieces):
        if (whole := v.rank.get(piece)) is not None:
            out[k] = whole.to_bytes(4, "little")
    return out


class Encoder:
    """Encodes texts by rank; remembers the ids of stretches of text as little-endian unsigned 32-bit integers."""

    #: where a text can't be cut at every blank: white space before a blank, or a blank at the start
    SPACED = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] |\\A "

    def __init__(self, vocabulary: Ranks, pattern: str, remembered: int):
        self.v, self.pattern, self.remembered = vocabulary, regex.compile(pattern), remembered
        self.known: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Encode stretches that aren't known, all together."""
        cut = {s: self.pattern.findall(s) for s in new}
        distinct = list({m for c in cut.values() for m in c})
        if distinct:
            ids = dict(zip(distinct, replay([m.encode("utf-8", "surrogatepass") for m in distinct], self.v), strict=True))
            self.known.update((s, b"".join(map(ids.__getitem__, c))) for s, c in cut.items())

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text; none is null.

        A match ends before a blank that follows other than white space, as the pattern's alternatives take a blank only as
        their first character or within a run of white space. Texts with other blanks are cut into their matches.
        """
        if len(self.known) > self.remembered:
            self.known = dict(itertools.islice(self.known.items(), self.remembered // 2))  # frequent stretches came first
        odd = pc.match_substring_regex(texts, self.SPACED).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        even = np.flatnonzero(~odd)
        cut = pc.split_pattern(texts.take(pa.array(even)), " ")
        coded = cut.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py() if len(even) else np.zeros(1, np.int64)
        # all but the first of a text follow a blank
        heads, at = np.unique(index[bounds[:-1]], return_inverse=True)
        index[bounds[:-1]] = len(words) + at
        stretches = [" " + w for w in words] + [words[k] for k in heads.tolist()]
        self.learn(set(stretches).difference(self.known, ("",)))
        ids, sizes = written_out([self.known[s] if s else b"" for s in stretches], index)
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        for k, b, e in zip(even.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = ids[b:e].tobytes()
        for k in np.flatnonzero(odd).tolist():
            cut_up = self.pattern.findall(texts[k].as_py())
            self.learn(set(cut_up).difference(self.known))
            out[k] = b"".join(map(self.known.__getitem__, cut_up))
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def bpe_encode(
    docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", remembered: int = 250_000, waiting: int = 6 << 20
) -> DataFrame:
    """(id_col, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    vocabulary is the path of a rank file (base64 token, rank) that every worker can open; pattern splits a text before the
    merges and must match all of any text. Null and empty texts have no ids; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern, remembered)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(ranks(vocabulary), pattern, remembered))
        for batch in in_runs(batches, "text", waiting):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(encoder.encode(batch["text"]), pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with one more column, bytes binary: the bytes that the ids stand for. Null ids give null; an unknown id is an error."""
    schema = encoded.withColumn("bytes", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = ranks(vocabulary).token
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in (y.as_py() for y in part[ids_col])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "bytes"])

    return encoded.mapInArrow(run, schema)
