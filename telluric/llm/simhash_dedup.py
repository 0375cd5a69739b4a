"""SimHash near-dedup by a binary-trie self-join.

Fingerprints. Each text's word shingles are hashed by XXH64 (seed 42); a fingerprint bit is set where more
than half of the hashes have it.

Join. The distinct fingerprints form a binary trie. Two that differ in at most ``budget`` bits agree
wholly in one of budget + 1 stretches of bits, so the trie is dealt out once for every stretch, rotated to
put that stretch first: a subtree below one value of the stretch is a node pair (itself, itself) with no
differing bits yet. A task traverses its node pairs together, level by level, adds up differing bits and
drops pairs beyond the budget. A subtree with more than ``most`` fingerprints is first replaced by the
pairs of its descendants ``step`` bits further down that are within the budget, each dealt out on its own.
A fingerprint has a fixed number of neighbours within the budget, so pairs grow with the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.llm.components import components, forest
from telluric.llm.shared import folder, numbered, saved

BITS = 64


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of the shingles of a UTF-8 text's words; 0 without words. A text with fewer words is one shingle."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < words:
        return digest(b" ".join(found), 42)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: n - words + 1].tolist()
    hashes = np.fromiter((digest(line[b:e], 42) for b, e in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n - words + 1)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x.as_py(), words) for x in batch["text"]), np.uint64, batch.num_rows)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), pa.array(out.view(np.int64))], [*rest, "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, row: Column | None = None) -> DataFrame:
    """(id, row, fp): the fingerprint of each row, as a signed long. Null texts have no words."""
    also = F.lit(0) if row is None else row
    rows = docs.select(F.col(id_col).cast("long").alias("id"), also.cast("long").alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "id long, row long, fp long")


def stretches(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 stretches of the 64 bits; shift turns the fingerprint left to put the stretch first."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _turned(shift: int):
    fp = F.col("fp")
    return fp if not shift else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift))


def node_pairs(distinct: DataFrame, budget: int, most: int, step: int) -> DataFrame:
    """(task, depth, diff, side, bits, fp): the fingerprints of each node pair to traverse. side: 0 both nodes, 1 the left, 2 the right one.

    bits is the rotated fingerprint, whose first depth bits are settled with diff differences.
    """
    spark, path = distinct.sparkSession, folder(distinct.sparkSession)
    frontier = None
    for shift, width in stretches(budget):
        part = distinct.select(
            F.concat_ws(":", F.lit(shift), F.shiftrightunsigned(_turned(shift), BITS - width)).alias("task"),
            F.lit(width).alias("depth"), F.lit(0).alias("diff"), F.lit(0).alias("side"), _turned(shift).alias("bits"), "fp",
        )
        frontier = part if frontier is None else frontier.union(part)
    done, turn = None, 0
    while True:
        frontier = saved(frontier, f"{path}/{turn}")
        turn += 1
        size = frontier.groupBy("task").agg(F.count("*").alias("n"))
        heavy = saved(size.where((F.col("n") > most)).select("task"), f"{path}/heavy{turn}")
        if heavy.isEmpty():
            return frontier if done is None else done.union(frontier)
        light = frontier.join(heavy, "task", "left_anti")
        done = light if done is None else done.union(light)
        split = frontier.join(heavy, "task").where(F.col("depth") < BITS)
        width = F.least(F.lit(step), F.lit(BITS) - F.col("depth"))
        split = split.withColumns({"width": width.cast("int")}).withColumn(
            "value", F.expr("cast(shiftrightunsigned(shiftleft(bits, depth), 64 - width) AS int)")
        )
        masks = [m for m in range(1 << step) if m.bit_count() <= budget]
        split = split.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).where(
            f"bit_count(mask) + diff <= {budget} AND mask < shiftleft(1, width)"
        )
        # within one node (side 0) the pair (v, v ^ mask) is the pair of its smaller value; across, the left node's value names it
        other = F.expr("value ^ mask")
        name = F.when(F.col("side") == 0, F.least("value", other)).when(F.col("side") == 1, F.col("value")).otherwise(other)
        side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mask") == 0, 0).when(F.col("value") < other, 1).otherwise(2)
        frontier = split.select(
            F.concat_ws(":", "task", name, "mask").alias("task"),
            (F.col("depth") + F.col("width")).alias("depth"),
            (F.col("diff") + F.expr("bit_count(mask)")).cast("int").alias("diff"),
            side.cast("int").alias("side"), "bits", "fp",
        )


def traverse(bits: np.ndarray, groups: list[tuple[int, int, int, int, int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of bits that differ in at most budget bits, for node pairs (a0, a1, b0, b1, depth, diff) of index ranges sorted by bits.

    All node pairs go down one level at a time; a pair whose two ranges are one is a node with itself.
    """
    left, right = [], []
    if not groups:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a0, a1, b0, b1, depth, diff = (np.array(x, np.int64) for x in zip(*groups, strict=True))
    for level in range(BITS):
        wait = depth > level
        now = ~wait
        if not now.any():
            continue
        one = np.uint64(1) << np.uint64(BITS - 1 - level)
        bit = (bits & one) != 0
        ones = np.concatenate([[0], np.cumsum(bit)])
        x0, x1, y0, y1, d = a0[now], a1[now], b0[now], b1[now], diff[now]
        # sorted by bits below a common prefix: the zeros come first
        xm, ym = x1 - (ones[x1] - ones[x0]), y1 - (ones[y1] - ones[y0])
        same = (x0 == y0) & (x1 == y1)
        parts = [
            (x0, xm, y0, ym, d, np.ones(len(d), bool)),
            (xm, x1, ym, y1, d, np.ones(len(d), bool)),
            (x0, xm, ym, y1, d + 1, np.ones(len(d), bool)),
            (xm, x1, y0, ym, d + 1, ~same),
        ]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        n0, n1 = cols[1] - cols[0], cols[3] - cols[2]
        keep = cols[5] & (n0 > 0) & (n1 > 0) & (cols[4] <= budget) & ~((cols[0] == cols[2]) & (n0 == 1))
        a0, a1, b0, b1, diff = (np.concatenate([old[wait], new[keep]]) for old, new in zip((a0, a1, b0, b1, diff), cols[:5], strict=True))
        depth = np.concatenate([depth[wait], np.full(int(keep.sum()), level + 1)])
        # node pairs of single fingerprints need no further descent
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & (depth == level + 1)
        if single.any():
            i, j = a0[single], b0[single]
            low = np.uint64((1 << (BITS - 1 - level)) - 1)
            near = diff[single] + np.bitwise_count((bits[i] ^ bits[j]) & low) <= budget
            left.append(i[near])
            right.append(j[near])
            a0, a1, b0, b1, depth, diff = (x[~single] for x in (a0, a1, b0, b1, depth, diff))
        if not len(a0):
            break
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _join(budget: int, whole: bool):
    names = ["task", "side", "bits", "depth", "diff", "fp"]

    def pairs(table: pa.Table) -> pa.RecordBatch | None:
        """The links of some whole tasks: all of them, or one to the smallest fingerprint that each reaches."""
        task, side, bits, depth, diff, fp = (table[k].combine_chunks() for k in names)
        bits, fp, side, depth, diff = bits.to_numpy().view(np.uint64), fp.to_numpy(), side.to_numpy(), depth.to_numpy(), diff.to_numpy()
        _, number = np.unique(task.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.lexsort((bits, side, number))
        bits, fp, side, number = bits[order], fp[order], side[order], number[order]
        cuts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (side[1:] != side[:-1])]))
        spans: dict[int, dict[int, tuple[int, int]]] = {}
        for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bits)], strict=True):
            spans.setdefault(int(number[b]), {})[int(side[b])] = (b, e)
        depth, diff, groups = depth[order], diff[order], []
        for own in spans.values():
            if 0 in own:
                (b, e), pair = own[0], own[0]
            elif len(own) == 2:
                (b, e), pair = own[1], own[2]
            else:
                continue
            if 0 in own and e - b == 1:
                continue
            groups.append((b, e, *pair, int(depth[b]), int(diff[b])))
        i, j = traverse(bits, groups, budget)
        if not len(i):
            return None
        a, b = (fp[i], fp[j]) if whole else forest(fp[i], fp[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by task, so a task is whole once the next one begins
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                table = pa.Table.from_batches(held)
                task = table["task"].combine_chunks().to_numpy(zero_copy_only=False)
                last = int(np.flatnonzero(task == task[-1])[0])
                if last and (out := pairs(table.slice(0, last))):
                    yield out
                rest = table.slice(last).combine_chunks().to_batches()
                held, rows = rest, sum(x.num_rows for x in rest)
        if held and (out := pairs(pa.Table.from_batches(held))):
            yield out

    return run


def links(distinct: DataFrame, *, budget: int = 2, most: int = 4096, step: int = 6, whole: bool = False) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) that differ in at most budget bits.

    whole=False gives, of each batch of node pairs, one link from each fingerprint to the smallest it reaches there, which
    keeps all components; whole=True gives all pairs, some of them more than once.
    """
    tasks = node_pairs(distinct, budget, most, step)
    return tasks.repartition("task").sortWithinPartitions("task").select("task", "side", "bits", "depth", "diff", "fp").mapInArrow(_join(budget, whole), "a long, b long")


def _labelled(docs: DataFrame, budget: int, **options) -> DataFrame:
    """The rows of fingerprints with component (one of its fingerprints) and component_id (its smallest id)."""
    path = folder(docs.sparkSession)
    rows = saved(fingerprints(docs, **options), f"{path}/fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("low")), f"{path}/nodes")
    found = components(links(nodes.select("fp"), budget=budget)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    label = saved(named.join(smallest, "component").select("fp", "component", "component_id"), f"{path}/labels")
    return rows.join(label, "fp", "left")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Rows link when their fingerprints differ in at most budget bits. Null and empty texts have fingerprint zero and link
    like any other; null ids get the component of their fingerprint and are never its name unless all ids in it are null.
    Repeated rows give repeated results; empty tables give empty ones.
    """
    rows = _labelled(docs, budget, id_col=id_col, text_col=text_col, words=words)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """One row of docs, with its columns, for each component of near copies: one with its smallest id, any of them if all ids are null.

    Rows are judged one by one, so ids may be null or repeated, and of repeated rows one stays. Null texts count as empty, and all
    texts without words are near copies of one another. Empty tables give empty results.
    """
    rows, row = numbered(docs)
    found = saved(_labelled(rows, budget, id_col=id_col, text_col=text_col, words=words, row=F.col(row)).select("id", "row", "component"), f"{folder(docs.sparkSession)}/rows")
    kept = found.groupBy("component").agg(F.coalesce(F.min_by("row", "id"), F.min("row")).alias("row")).select(F.col("row").alias(row))
    gone = found.select(F.col("row").alias(row)).join(kept, row, "left_anti")
    return rows.join(gone, row, "left_anti").drop(row)
