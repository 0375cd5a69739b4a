"""Ranked lexical search: the best documents for each item of a query set, term at a time with a limit on accumulators.

One pass over the documents makes a table of inverted blocks: each block has the postings, by query term, of some megabytes
of documents. Document frequencies are sums over that table. A second pass ranks every block: an item's terms are taken
from the rarest on; a document met for the first time gets an accumulator until what the terms still to come can give at
most is less than the k-th partial score, and from then on only documents that have one are updated, exactly. Each block gives
its k best to the ranking over all blocks, which Spark cuts to k in each task before it shuffles.

Items are the stated query set, brought to every task. They are taken in rounds of about ``most`` terms (some 20 MB), so that what is
sent is bounded; each round goes over the documents again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telluric.llm.shared import folder, numbered, saved
from telluric.llm.spread import in_runs
from telluric.llm.words import content, find, hashed

#: Bytes of terms: digits, letters, and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BLOCK = 8 << 20
POSTINGS = "ids array<long>, lengths array<long>, terms array<int>, df array<long>, docs binary, tf binary"


def terms(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, start, end, first) of the terms of binary texts, as in words.find."""
    data, offsets = content(array)
    data = LOWER[data]
    return data, *find(data, offsets, TERM)


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, start, end, first = terms(batch["text"])
        found = [data[b:e].tobytes() for b, e in zip(start.tolist(), end.tolist(), strict=True)]
        row = batch["item"].to_numpy().repeat(np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(found, pa.binary())], ["item", "term"])


class Vocabulary:
    """Query terms by number; numbers of other texts' terms by hash."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        start = np.append(0, end)[: len(words)]
        key = hashed(data, start, end, 1)
        self.number = np.argsort(key)
        self.key, self.check = key[self.number], hashed(data, start, end, 2)[self.number]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of those that are query terms, their numbers)."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = hashed(data, start, end, 1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        some = np.flatnonzero(self.key[at] == key)
        some = some[hashed(data, start[some], end[some], 2) == self.check[at[some]]]
        return some, self.number[at[some]]


def _postings(shared):
    """Inverted blocks: for each query term of a block the numbers of its documents, and how often they have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in in_runs(batches, "text", BLOCK):
            data, start, end, first = terms(batch["text"])
            some, term = vocabulary.find(data, start, end)
            doc = np.searchsorted(first, some, "right") - 1
            pair, tf = np.unique(term * batch.num_rows + doc, return_counts=True)
            term, df = np.unique(pair // batch.num_rows, return_counts=True)
            lists = [[x] for x in (batch["id"], pa.array(np.diff(first)), pa.array(term.astype(np.int32)), pa.array(df))]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for (x,) in lists]
            blobs = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (pair % batch.num_rows, tf)]
            yield pa.RecordBatch.from_arrays([*arrays, *blobs], ["ids", "lengths", "terms", "df", "docs", "tf"])

    return run


class Block:
    """One row of postings, with what each posting gives."""

    def __init__(self, row: dict, weight: np.ndarray, documents: int, length: int):
        n = np.array(row["lengths"], np.int64)
        if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
            n = n.astype(object)
        m = (10 + 90 * n * documents // max(length, 1)).astype(np.int64)
        terms = np.array(row["terms"], np.int64)
        self.docs, tf = np.frombuffer(row["docs"], "<u4").astype(np.int64), np.frombuffer(row["tf"], "<u4").astype(np.int64)
        df = np.array(row["df"], np.int64)
        self.gain = np.repeat(weight[terms], df) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        self.cuts = np.append(0, np.cumsum(df))
        self.most = np.maximum.reduceat(self.gain, self.cuts[:-1]) if len(terms) else df
        self.slot = np.full(len(weight), -1)
        self.slot[terms] = np.arange(len(terms))
        self.ids = np.array([np.iinfo(np.int64).max if x is None else x for x in row["ids"]], np.int64)
        self.null = np.array([x is None for x in row["ids"]], bool)

    def best(self, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the k best documents for an item's terms, which come rarest first; equal scores by id."""
        own = self.slot[own]
        own = own[own >= 0]
        # what the terms from each one on can give at most
        left = np.cumsum(self.most[own][::-1])[::-1].tolist()
        score, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        creating = True
        for term, rest in zip(own.tolist(), left, strict=True):
            docs, gain = self.docs[self.cuts[term] : self.cuts[term + 1]], self.gain[self.cuts[term] : self.cuts[term + 1]]
            if creating:
                partial = score[met]
                # a document first met now could still draw level with the k-th, so the bound has to be below it
                creating = len(partial) < k or int(np.partition(partial, len(partial) - k)[len(partial) - k]) <= rest
            if creating:
                met[docs] = True
                score[docs] += gain
            else:
                old = met[docs]
                score[docs[old]] += gain[old]
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.null[found], self.ids[found], -score[found]))[:k]]
        return found, score[found]


def _ranked(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, length = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], weight, documents, length)
                found = [(item, *block.best(own, k)) for item, own in items]
                numbers = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])),
                        pa.array(block.ids[numbers], mask=block.null[numbers]),
                        pa.array(np.concatenate([x[2] for x in found]) if found else numbers),
                    ],
                    ["item", "id", "score"],
                )

    return run


def lexical_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = 10, most: int = 500_000) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of the highest scores above 0 for each row of items, equal scores by ascending id.

    Terms are the longest stretches of ASCII digits and letters, in lower case, and of characters beyond ASCII. A term's weight w is
    floor(1000 ln((2N + 2) / (2df + 1))), N being the documents with terms; it adds w * (10^9 tf div (1000 tf + 8m)) to the score of a
    document, m being 10 + 90n N div L for its n terms of all L. Each of an item's terms counts once. Null and empty texts have no terms: such
    documents are never found, such items find none. Repeated rows of docs are documents of their own and repeated rows of
    items are answered each; ids of documents are whole numbers, null ones come after all others. Other columns are left aside, and so are
    columns of the same names in the two tables. Where either table is empty there are no rows.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    binary = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), binary)
    asked, row = numbered(items.select(F.col(item_col).alias(item_col), F.col(text_col).alias(text_col)))
    wanted = saved(asked.select(F.col(row).alias("item"), binary).mapInArrow(_of_items, "item long, term binary").distinct(), f"{path}/items")
    rounds, parts = max(1, -(-wanted.count() // most)), []
    for turn in range(rounds):
        own = wanted.where(F.pmod("item", F.lit(rounds)) == turn).collect()
        words = sorted({bytes(x.term) for x in own})
        number = {w: i for i, w in enumerate(words)}
        blocks = saved(rows.mapInArrow(_postings(spark.sparkContext.broadcast(Vocabulary(words))), POSTINGS), f"{path}/blocks{turn}")
        counts = blocks.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"))
        documents, length = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
        df = np.zeros(len(words), np.int64)
        for x in blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect():
            df[x.terms] = x.df
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        asks: dict[int, list[int]] = {}
        for x in own:
            asks.setdefault(x.item, []).append(number[bytes(x.term)])
        rarest = [(item, np.array(sorted(t, key=lambda t: (df[t], t)), np.int64)) for item, t in sorted(asks.items())]
        shared = spark.sparkContext.broadcast((rarest, weight, documents, length))
        parts.append(blocks.mapInArrow(_ranked(shared, k), "item long, id long, score long"))
    found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col(row).alias("item"), item_col), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
