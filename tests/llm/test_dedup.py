"""Exact dedup, SimHash near-dedup, embedding near-dedup and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import assert_same

from telluric.llm import queries
from telluric.llm.components import components, forest
from telluric.llm.embedding_dedup import Index, Layout, cells_in_order, embedding_dedup, neighbours
from telluric.llm.exact_dedup import directory, exact_dedup, without_copies
from telluric.llm.simhash_dedup import fingerprint, links, one_of_each, simhash_dedup, traverse

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)], DOCS)


def reach(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_chat_format", "op8_embedding_dedup", "op9_warc"])
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_exact_rules(spark):
    texts = ["a b", "ab", "a  b", None, "", " \n", "x" * 200_000, "x" * 100_000 + "\x0b" + "x" * 100_000, " ab", "AB"]
    found = {r.doc_id: r for r in exact_dedup(docs(spark, texts)).collect()}
    assert [found[k].keep_id for k in range(1, 11)] == [3, 3, 3, 6, 6, 6, 8, 8, 9, 10]
    assert [found[k].group_size for k in (1, 4, 7, 9)] == [3, 3, 2, 1]
    assert [k for k in found if found[k].kept] == [k for k in found if found[k].keep_id == k]
    assert found[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_exact_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "ab ", 1), (7, "ab", 2), (5, "ab", 3), (5, "ab", 3), (None, "z", 4)], "doc_id long, text string, key int")
    found = exact_dedup(rows)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in found.collect())
    assert got == [(0, 0, 1, True), (0, 0, 4, True), (5, 0, 4, False), (5, 0, 4, False), (7, 0, 4, False)]
    assert exact_dedup(rows.limit(0)).count() == 0 and without_copies(rows.limit(0)).count() == 0


def test_exact_verdict_is_of_id_and_text(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (0, "B"), (None, "B"), (None, "C"), (None, "D"), (2, None)], "doc_id long, text string")
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in without_copies(rows).collect())
    assert left == [(-1, "C"), (-1, "D"), (0, "B"), (1, "A"), (2, "")]


def test_repeated_rows_leave_one(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = spark.createDataFrame([(1, a, 1)] * 3 + [(2, a, 2), (2, b, 3), (None, b, 4), (None, b, 4)], "doc_id long, text string, __row int")
    for left in (without_copies(rows), one_of_each(rows)):
        assert left.columns == rows.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (2, b)]


def test_exact_splits_buckets(spark):
    texts = [f"text {k % 400}" for k in range(1000)]
    plain = sorted(map(tuple, exact_dedup(docs(spark, texts)).collect()))
    assert plain == sorted(map(tuple, exact_dedup(docs(spark, texts), capacity=10, max_bits=6).collect()))
    assert without_copies(docs(spark, texts)).count() == 400


def test_directory_holds_capacity(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id % 1000) AS key")
    load = directory(keys, 50, 10).join(keys.distinct().selectExpr("shiftrightunsigned(key, 54) AS cell", "key"), "cell").groupBy("bucket").count()
    assert load.agg({"count": "max"}).first()[0] <= 50 and load.agg({"count": "sum"}).first()[0] == 1000
    one = directory(keys.where("false"), 50, 10)
    assert one.count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", [None, "", " \t\r\n", "One", "One two", "One TWO\x0bthree", "É é A a a a a", " x y　z w", "a b c " * 5000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == slow_fingerprint(text)


def near_words(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        f = rng.getrandbits(64)
        out.append(f)
        for _ in range(rng.randrange(6)):
            f ^= sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 2, 3))))
            out.append(f)
    return sorted({f - (1 << 64) if f >> 63 else f for f in out[:n]})


@pytest.mark.parametrize("most, step", [(4096, 6), (8, 6), (4, 3)])
def test_trie_join_finds_all_pairs(spark, most, step):
    # a dense ball as well: all neighbours of one fingerprint
    values = sorted({*near_words(500, 3), *(1 << b for b in range(63)), *((1 << b | 3) for b in range(2, 40))})
    found = {tuple(sorted((r.a, r.b))) for r in links(spark.createDataFrame([(v,) for v in values], "fp long"), most=most, step=step, whole=True).collect()}
    assert found == {(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_traverse_of_nothing():
    assert len(traverse(np.zeros(0, np.uint64), [], 2)[0]) == 0


def test_simhash_components(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts = base + [t + " x" for t in base] + [t.upper() for t in base] + [None, "", "One", "a b"]
    found = {r.doc_id: r for r in simhash_dedup(docs(spark, texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    label = reach(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert [found[k + 1].component_id - 1 for k in range(len(texts))] == label
    assert [found[k + 1].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert one_of_each(docs(spark, texts)).count() == len(set(label))


def test_simhash_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c", 1), (4, "a b c", 1), (4, "a b c", 1), (9, None, 1)], "doc_id long, text string, fp int")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash_dedup(rows).collect()) == [(0, 4), (4, 4), (4, 4), (9, 9)]
    assert simhash_dedup(rows.limit(0)).count() == 0 and one_of_each(rows.limit(0)).count() == 0


def test_near_verdict_is_of_id_and_text(spark):
    a, b, c, d = ("one two three four", "five six seven eight", "nine ten eleven twelve", "red green blue white")
    rows = spark.createDataFrame([(1, a), (1, b), (0, b.upper()), (None, b), (None, c), (None, d), (2, None)], "doc_id long, text string")
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in one_of_each(rows).collect())
    assert left == [(-1, c), (-1, d), (0, b.upper()), (1, a), (2, "")]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, 5000 + k) for k in range(400)]
    found = dict(map(tuple, components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()))
    label = reach(6000, pairs)
    assert found == {k: label[k] for p in pairs for k in p if label[k] != k}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    a, b = forest(np.array([5, 4, 9, 3]), np.array([4, 3, 8, 3]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {4: 3, 5: 3, 9: 8}


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None, 1) for k, v in rows], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + 0.1 * rng.normal(size=(60, 16)), x[:1] + 0.15 * rng.normal(size=(80, 16)), x[:20], 5 * x[:5]]).astype(np.float32)
    found = {r.vec_id: r for r in embedding_dedup(vectors(spark, list(enumerate(x.tolist()))), block=block).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    total = sum(r.n_links for r in found.values())
    assert total <= near.sum() and total >= 0.99 * near.sum()
    label = reach(len(x), zip(*np.nonzero(near), strict=True))
    assert np.mean([found[k].component_id == label[k] for k in range(len(x))]) > 0.99
    assert all(found[k].kept == (found[k].component_id == k) for k in range(len(x)))


def test_layout_of_cells():
    rng = np.random.default_rng(6)
    cells = np.unique(rng.integers(0, 6, 300) << 20 | rng.integers(0, 90, 300))
    entries, visited = rng.integers(1, 12, len(cells)), rng.integers(1, 400, len(cells))
    entries[[5, 40]] = 95
    layout = Layout(cells, entries, visited, 20)
    filled, asked, row = {}, {}, {}
    for k, cell in enumerate(cells.tolist()):
        (first,), (many,) = layout.of(np.array([cell]))
        assert many == -(-entries[k] // 20)
        for u in range(first, first + many):
            filled[u] = filled.get(u, 0) + entries[k] / many
            asked[u] = asked.get(u, 0) + -(-visited[k] // many)
            assert row.setdefault(u, cell >> 20) == cell >> 20
    assert max(filled.values()) <= 20 and sorted(filled) == list(range(len(layout.parts)))
    assert [layout.parts[u] for u in sorted(asked)] == [max(1, -(-asked[u] // 80)) for u in sorted(asked)]
    assert layout.of(np.array([91, 7 << 20]))[1].tolist() == [0, 0]


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, [1, 0]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, []), (8, [0, 1]), (9, [1e-30, 0])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(vectors(spark, rows)).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False)} | {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8)}
    assert embedding_dedup(vectors(spark, rows).limit(0)).count() == 0


def test_embeddings_of_many_lengths(spark):
    x = np.random.default_rng(6).normal(size=(100, 8))
    rows = [(k, v) for k, v in enumerate(np.concatenate([x, x + 0.02]).tolist())] + [(900, [1.0] * 12), (901, [1.0] * 3), (902, [1.0, 1.0, 1.1]), (903, [2.0]), (904, [-1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(vectors(spark, rows)).collect()}
    assert all(found[k][0] >= 1 and found[k][1] == found[k + 100][1] for k in range(100))
    assert found[900] == (0, 900) and found[901] == found[902] == (1, 901) and found[903] == (0, 903) and found[904] == (0, 904)


def test_neighbours_are_sought_among_all_vectors(spark):
    x = np.random.default_rng(8).normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame(list(enumerate(x.tolist())), "node long, v array<double>").repartition(3)
    _, other, pairs = neighbours(table, {6: (np.arange(20), x[:20])}, 0.8, most=400)[6]
    got = {(q, tuple(other[k])) for q, some in pairs for k in some}
    assert got == {(q, tuple(x[k])) for q in range(20) for k in range(400) if k != q and x[q] @ x[k] >= 0.8}
    assert sum(len(some) for _, some in neighbours(table, {6: (np.arange(20), x[:20])}, -1.0, most=3)[6][2]) == 60


def test_multi_sequence_order():
    a, b = np.array([0.1, 0.9, 0.4]), np.array([0.3, 0.2])
    got = cells_in_order(a, b, 6)
    assert sorted(got) == [(i, j) for i in range(3) for j in range(2)]
    assert [a[i] + b[j] for i, j in got] == sorted(a[i] + b[j] for i in range(3) for j in range(2))
    assert Index(np.zeros((0, 2)), 4, 0.9, 0.9, (np.zeros((0, 2)), np.zeros((0, 2)), [])).codebooks is None


def test_hot_groups_stay_whole(spark):
    texts = ["same text again and again"] * 500 + [f"other text number {k} of many" for k in range(200)]
    assert exact_dedup(docs(spark, texts)).where("keep_id = 1").count() == 500
    assert simhash_dedup(docs(spark, texts)).where("component_id = 1").count() >= 500
    hot = vectors(spark, [(k, [1.0, 0.001 * k]) for k in range(300)])
    assert {(r.n_links, r.component_id) for r in embedding_dedup(hot, block=32).collect()} == {(299, 0)}
