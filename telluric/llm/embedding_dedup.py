"""Embedding near-dedup over an inverted multi-index.

The halves of the unit vectors get a codebook each (k-means on a bounded sample), whose size grows with the number of
vectors; a pair of codes is a cell of the product grid, and every vector is filed under its cell. Each vector is a query
too: the multi-sequence traversal visits cells in the order of the summed distance to both codes, as many as it takes to
reach the wanted recall for some queries whose true neighbours among all vectors are known by brute force; cosines of
what is found are then verified in double precision.

Equal vectors are one entry with a count. Neighbouring cells of a row of the grid (those of one code of the first half)
make a unit of about ``block`` entries, a larger cell several; a vector is sent to a unit once, however many of its cells
it visits, and its own cell's unit is among them. A unit's queries are split too, so that no task holds more than a block
of entries and some of queries; a task gives each query's number of links and links enough to keep what they connect,
never all pairs.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telluric.llm.components import components, forest
from telluric.llm.shared import folder, saved


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres of x, by Lloyd's rounds from a random choice of rows."""
    x = np.unique(x, axis=0) if x.shape[1] else x[:1]
    if len(x) <= k:
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0)


def cells_in_order(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The multi-sequence traversal: the first pairs of codes by the sum of the distances a[i] + b[j]."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, p, q = heapq.heappop(heap)
        out.append((int(i[p]), int(j[q])))
        for r, s in ((p + 1, q), (p, q + 1)):
            if r < len(i) and s < len(j) and (r, s) not in seen:
                seen.add((r, s))
                heapq.heappush(heap, (a[i[r]] + b[j[s]], r, s))
    return out


class Index:
    """The two codebooks and the number of cells that a query visits.

    near is (queries, vectors, pairs of a query's number and its neighbours' numbers), see neighbours. visits is what finds the
    wanted share of these neighbours. With fewer than FEW of them it is what finds PROBED of probes as well: the queries turned
    in random directions, as far as cosine allows, which are harder to find than most neighbours.
    """

    FEW, PROBED = 100, 0.95

    def __init__(self, sample: np.ndarray, codes: int, cosine: float, recall: float, near: tuple):
        self.half = sample.shape[1] // 2
        self.codebooks, self.visits = None, 1
        if not len(sample):
            return
        self.codebooks = [k_means(part, codes) for part in self.parts(sample)]
        asked, other, pairs = near
        q = np.array([k for k, found in pairs for _ in found], np.int64)
        need = [int(np.quantile(self.places(asked[q], units(other[[m for _, found in pairs for m in found]])), recall, method="higher")) + 2] if len(q) else [1]
        if len(q) < self.FEW and len(asked):
            turn = np.random.default_rng(11).normal(size=asked.shape)
            turn -= (turn * asked).sum(axis=1)[:, None] * asked
            turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-9)[:, None]
            probes = cosine * asked + np.sqrt(max(0.0, 1 - cosine**2)) * turn
            need.append(int(np.quantile(self.places(asked, probes), self.PROBED, method="higher")) + 2)
        self.visits = min(max(need), len(self.codebooks[0]) * len(self.codebooks[1]))

    def places(self, asked: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many cells each query visits before the one of the vector beside it."""
        (a, b), cells = (distances(p, c) for p, c in zip(self.parts(asked), self.codebooks, strict=True)), self.cells(other)
        # cells whose sum of distances is smaller: for each code of the first half, how many of the second
        return np.array([np.searchsorted(np.sort(b[k]), a[k, i] + b[k, j] - a[k]).sum() for k, (i, j) in enumerate(cells)])

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> list[tuple[int, int]]:
        """Each vector's cell."""
        return list(zip(*(distances(p, c).argmin(axis=1).tolist() for p, c in zip(self.parts(x), self.codebooks, strict=True)), strict=True))

    def visited(self, x: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """The cells that each vector visits as a query; the first is its own, as the nearest codes make both."""
        a, b = (distances(p, c) for p, c in zip(self.parts(x), self.codebooks, strict=True))
        for p, q in zip(a, b, strict=True):
            yield cells_in_order(p, q, self.visits)


def units(x: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision; none is zero or has components that aren't finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def sound_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, k1, k2): the vectors as they are with two hashes; all null for those that link with nothing."""
    one = vectors.schema[vector_col].dataType.elementType.typeName()
    kind = one if one in ("float", "double") else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    big = F.lit(float("inf"))
    # a comparison with NaN or null is not true
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < big, F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0.0).cast(kind))).alias("v"))
    return rows.withColumns({f"k{n}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(n), "v")) for n in (1, 2)})


def neighbours(nodes: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float, most: int = 20) -> dict[int, tuple]:
    """By length of vectors (queries, vectors, pairs), see Index: the true neighbours of some queries among all nodes, by brute force.

    asked has each length's queries as (nodes, vectors of length 1). The neighbours are given as they are; of a query's neighbours there are the most with the lowest hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}
        for batch in batches:
            node, h, size = (batch[n].to_numpy() for n in ("node", "h", "size"))
            order = np.argsort(h, kind="stable")
            for d in np.unique(size).tolist():
                rows = order[size[order] == d]
                x = np.stack(batch["v"].take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)
                close = (asked[d][1] @ units(x).T >= cosine) & (asked[d][0][:, None] != node[rows])
                for q in np.flatnonzero(close.any(axis=1)).tolist():
                    some = np.flatnonzero(close[q])[:most]
                    best[d, q] = sorted([*best.get((d, q), []), *((int(h[rows[k]]), x[k].tolist()) for k in some)])[:most]
        flat = [(d, q, h, v) for (d, q), some in best.items() for h, v in some]
        for at in range(0, len(flat), 1000):
            d, q, h, v = zip(*flat[at : at + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(q, pa.int32()), pa.array(h, pa.int64()), pa.array(v, pa.list_(pa.float64()))], ["d", "q", "h", "v"])

    rows = nodes.select("node", F.xxhash64("v").alias("h"), F.size("v").alias("size"), "v").mapInArrow(run, "d int, q int, h long, v array<double>")
    # at most some of each task's, so a query's rows are few
    first = F.row_number().over(Window.partitionBy("d", "q").orderBy("h", "v"))
    out: dict[int, tuple] = {d: (x, [], {}) for d, (_, x) in asked.items()}
    for r in rows.withColumn("k", first).where(F.col("k") <= most).orderBy("d", "q", "k").collect():
        _, other, pairs = out[r["d"]]
        pairs.setdefault(r["q"], []).append(len(other))
        other.append(r["v"])
    return {d: (x, np.array(other, np.float64).reshape(-1, d), list(pairs.items())) for d, (x, other, pairs) in out.items()}


def _loads(indexes: dict[int, Index]):
    """(cell, role, n): how many vectors of a batch are entries of a cell (role 0), and visit it (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for d, part, _ in _by_size(batch):
                for cells in indexes[d].visited(part):
                    found[d << 40 | cells[0][0] << 20 | cells[0][1], 0] += 1
                    found.update((d << 40 | i << 20 | j, 1) for i, j in cells)
            if found:
                cell, role = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(role, pa.int32()), pa.array(found.values(), pa.int64())], ["cell", "role", "n"])

    return run


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, unit vectors, their rows) of a batch's vectors, 1,000 at a time."""
    size = batch["size"].to_numpy()
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            yield d, units(np.stack(batch["v"].take(pa.array(some)).to_numpy(zero_copy_only=False))), some


class Layout:
    """Which units a cell's entries are in: the first one and how many, and into how many parts a unit's queries are split.

    cells are ascending numbers of cells that have entries, with how many and how often they are visited. All is kept in arrays: 20 bytes a
    cell of a grid, and no grid has more than most_codes squared.
    """

    def __init__(self, cells: np.ndarray, entries: np.ndarray, visited: np.ndarray, block: int):
        self.cells, self.first, self.many = cells, np.zeros(len(cells), np.int64), np.maximum(1, -(-entries // block)).astype(np.int32)
        unit, filled = -1, 0
        rows = np.flatnonzero(np.diff(cells >> 20, prepend=-1))
        for begin, end in zip(rows.tolist(), [*rows[1:].tolist(), len(cells)], strict=True):
            unit, filled = unit + 1, 0
            for k, (n, many) in enumerate(zip(entries[begin:end].tolist(), self.many[begin:end].tolist(), strict=True), begin):
                if filled and filled + n > block:
                    unit, filled = unit + 1, 0
                self.first[k] = unit
                unit, filled = unit + many - 1, filled + n
        queries = np.zeros(unit + 1, np.int64)
        which, begins = np.repeat(np.arange(len(cells)), self.many), np.cumsum(self.many) - self.many
        np.add.at(queries, self.first[which] + np.arange(len(which)) - begins[which], (-(-visited // self.many))[which])
        self.parts = np.maximum(1, -(-queries // (4 * block))).astype(np.int32)

    def of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first unit, how many) of cells; those without entries have 0."""
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return self.first[at], np.where(self.cells[at] == cells, self.many[at], 0)


def _dealt(indexes: dict[int, Index], layout: Layout):
    """Each vector once for each unit and part of it where it is an entry (role 0), a query (1) or both (2); visits are its cells, its own first."""
    names = ["unit", "part", "role", "visits", "node", "copies", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            for d, x, rows in _by_size(batch):
                out: list[tuple] = []
                for k, cells in zip(rows.tolist(), indexes[d].visited(x), strict=True):
                    visits = [d << 40 | i << 20 | j for i, j in cells]
                    firsts, manies = (a.tolist() for a in layout.of(np.array(visits, np.int64)))
                    places = {u + e for u, many in zip(firsts, manies, strict=True) for e in range(many)}
                    n, many = int(node[k]), manies[0]
                    own = firsts[0] + n % many
                    for u in places:
                        parts = int(layout.parts[u])
                        mine = n // many % parts
                        for part in range(parts) if u == own else (mine,):
                            out.append((u, part, 1 if u != own else 2 if part == mine else 0, visits, k))
                unit, part, role, visits, back = zip(*out, strict=True)
                taken = batch.take(pa.array(back, pa.int64()))
                made = [pa.array(unit, pa.int64()), pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(visits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*made, taken["node"], taken["copies"], taken["v"]], names)

    return run


def _verified(cosine: float):
    """Of a unit's entries and a part of its queries: n links of each vector, and links that connect the same vectors.

    A pair that each side finds counts for either where it is the query; where the entry doesn't visit the query's cell, it
    counts for both here.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})]
        x, node, copies = units(np.stack(rows["v"].to_numpy())), rows["node"].to_numpy(), rows["copies"].to_numpy()
        visits, role = np.stack(rows["visits"].to_numpy()), rows["role"].to_numpy()
        entries, asked = np.flatnonzero(role != 1), np.flatnonzero(role > 0)
        entries = entries[np.argsort(visits[entries, 0], kind="stable")]
        cells, begins = np.unique(visits[entries, 0], return_index=True)
        # of each cell its queries
        flat = visits[asked].reshape(-1)
        who, at = np.repeat(asked, visits.shape[1]), np.searchsorted(cells, flat)
        here = cells[np.minimum(at, len(cells) - 1)] == flat if len(cells) else np.zeros(len(flat), bool)
        who, at = who[here], at[here]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        bounds = np.searchsorted(at, np.arange(len(cells) + 1))
        for k, cell in enumerate(cells.tolist()):
            e, q = entries[begins[k] : begins[k + 1] if k + 1 < len(begins) else len(entries)], who[bounds[k] : bounds[k + 1]]
            if not len(q):
                continue
            near = (x[q] @ x[e].T >= cosine) & (node[q][:, None] != node[e])
            if not near.any():
                continue
            to_query, to_entry = near @ copies[e], np.zeros(len(e), np.int64)
            for own in np.unique(visits[q, 0][near.any(axis=1)]).tolist():
                if own != cell:
                    mine, alone = visits[q, 0] == own, ~(visits[e] == own).any(axis=1)
                    to_entry[alone] += copies[q[mine]] @ near[np.ix_(mine, alone)]
            a, b = forest(*(node[side[m]] for side, m in zip((q, e), np.nonzero(near), strict=True)))
            both, n = np.concatenate([node[q], node[e]]), np.concatenate([to_query, to_entry])
            out.append(pd.DataFrame({"a": both[n > 0], "b": both[n > 0], "n": n[n > 0].astype(np.int64)}))
            out.append(pd.DataFrame({"a": a, "b": b, "n": np.zeros(len(a), np.int64)}))
        return pd.concat(out, ignore_index=True)

    return run


def embedding_dedup(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, occupancy: int = 64, most_codes: int = 1024, sample: int = 6_000, recall: float = 0.999,
    block: int = 1024, queries: int = 1_000,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Two rows link when the cosine of their vectors is at least cosine and the index finds them: copies always, others
    with the recall that the true neighbours, among all vectors, of some queries show. Each length of vectors has an index
    of its own, with cells of about occupancy vectors (at most most_codes codes for a half) and codebooks from a sample of about
    sample vectors or 24 for each code, spread by hash; its first ones are the queries.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows that repeat an id are rows of their own; a null id has a null component
    unless a link gives it one. Empty tables give empty results; other columns are ignored.
    """
    spark, path = vectors.sparkSession, folder(vectors.sparkSession)
    rows = sound_vectors(vectors, id_col, vector_col)
    groups = rows.where("v IS NOT NULL").groupBy("v", "k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = saved(groups.withColumn("node", F.monotonically_increasing_id()), f"{path}/nodes")
    sizes = {r["size"]: r["n"] for r in nodes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}  # one for each length of vectors
    codes = {d: min(most_codes, max(1, round((n / occupancy) ** 0.5))) for d, n in sizes.items()}
    wanted = {d: max(sample, 24 * c) for d, c in codes.items()}
    if not sizes:
        found = spark.createDataFrame([], "a long, b long, n long")
    else:
        # a length with few vectors is taken whole
        share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, 1.0 if n <= wanted[d] else 0.8 * wanted[d] / n)))
        h = F.pmod(F.xxhash64("v"), F.lit(1 << 20))
        picked = nodes.select("node", "v", F.size("v").alias("size"), h.alias("h")).where(F.col("h") < share[F.col("size")] * (1 << 20)).orderBy("size", "h", "v").collect()
        samples: dict[int, tuple[list[int], list[list[float]]]] = {}
        for r in picked:
            ids, some = samples.setdefault(r["size"], ([], []))
            ids.append(r["node"])
            some.append(r["v"])
        made = {d: (np.array(ids), units(np.array(some, np.float64))) for d, (ids, some) in samples.items()}
        made = {d: made.get(d, (np.zeros(0, np.int64), np.zeros((0, d)))) for d in sizes}
        near = neighbours(nodes, {d: (ids[:queries], some[:queries]) for d, (ids, some) in made.items()}, cosine)
        indexes = {d: Index(some, codes[d], cosine, recall, near[d]) for d, (_, some) in made.items()}
        plain = nodes.select("node", "copies", "v", F.size("v").alias("size"))
        # one row of three numbers for each cell of a grid with entries at most, as arrays
        loads = plain.mapInArrow(_loads(indexes), "cell long, role int, n long").groupBy("cell").agg(*(F.sum(F.when(F.col("role") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("entries", "visited"))))
        loads = loads.where("entries > 0").orderBy("cell").toArrow()
        layout = Layout(*(loads[c].to_numpy() for c in ("cell", "entries", "visited")), block)
        kind = nodes.schema["v"].dataType.simpleString()
        dealt = plain.mapInArrow(_dealt(indexes, layout), f"unit long, part int, role int, visits array<long>, node long, copies long, v {kind}")
        found = saved(dealt.groupBy("unit", "part").applyInPandas(_verified(cosine), "a long, b long, n long"), f"{path}/found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(found.where("n = 0").select("a", "b"))
    named = nodes.select("node", "low", "copies", "k1", "k2").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = saved(
        named.join(smallest, "component").join(counts, "node", "left").select("k1", "k2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), f"{path}/out"
    )
    return rows.drop("v").join(out, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
