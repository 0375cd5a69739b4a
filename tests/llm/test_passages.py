"""Repeated passages, periodic runs and ranked search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from compare import assert_same
from telluric.llm.lexical_search import lexical_search
from telluric.llm.periodic_runs import periodic_runs, runs
from telluric.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("query", ["op11_substring_dedup", "op12_periodic_runs", "op13_lexical_search"])
def test_query_equals_its_sql(spark, query):
    assert_same(e.queries()[query](spark, "/root/testdata/sf0.001"), e.oracle_sql()[query], "/root/testdata/sf0.001")


# op11


def without_repeats(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages(rng, n):
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 40) for _ in range(12)] for _ in range(4)]
    texts = [None, "", " \t\n", "one", *["the very same text of some words"] * 3]
    for _ in range(n):
        parts = [[str(rng.randrange(10**9)) for _ in range(rng.randint(0, 9))] for _ in range(3)]
        texts.append(rng.choice([" ", "\n\t ", "\x0b"]).join(x for p in parts for x in p + (rng.choice(shared) if rng.random() < 0.3 else [])))
    return texts


@pytest.mark.parametrize("width", [1, 5])
def test_repeated_passages_go(spark, width):
    texts = passages(random.Random(width), 200)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, kept string, chunk string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs.repartition(3), window=width).collect()}
    assert [found[i] for i in range(len(texts))] == without_repeats(texts, width)


def test_repeated_passages_in_many_chunks(spark, monkeypatch):
    import telluric.llm.substring_dedup as module

    monkeypatch.setattr(module, "CHUNK", 500)
    monkeypatch.setattr(module, "MOST_CELLS", 997)
    monkeypatch.setattr(module, "MOST_BYTES", 2000)
    texts = passages(random.Random(9), 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs, window=5).collect()}
    assert [found[i] for i in range(len(texts))] == without_repeats(texts, 5)


def test_repeated_passages_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (7, text + " end"), (7, text + " tail"), (8, "w1 " * 20)], "doc_id int, text string")
    rows = substring_dedup(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in rows) == [(0, 40, 40, ""), (7, 41, 40, "end"), (7, 41, 40, "tail"), (8, 20, 0, ("w1 " * 20).strip())]
    assert substring_dedup(docs.limit(0)).collect() == []
    long = " ".join(["q" * 5000, *(str(i) for i in range(50))])
    twice = spark.createDataFrame([("a", long), ("b", long)], "doc_id string, text string")
    assert [(r.doc_id, r.n_removed) for r in substring_dedup(twice).orderBy("doc_id").collect()] == [("a", 51), ("b", 51)]


# op12


def runs_by_period(words, length, exponent):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(length, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def periodic(rng, alphabet):
    n = rng.choice([0, 1, 5, 25, 60, 150])
    words = [rng.choice(alphabet) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = [periodic(rng, range(rng.choice([1, 2, 3, 20]))) for _ in range(rng.randint(0, 5))]
        first = np.cumsum([0, *map(len, texts)])
        for length, exponent in ((24, 3), (1, 2), (6, 3)):
            found = runs(np.array([x for t in texts for x in t], np.int64), first, length, exponent)
            own = [(i + first[k], n, q) for k, t in enumerate(texts) for i, n, q in runs_by_period(t, length, exponent)]
            assert list(zip(*(x.tolist() for x in found), strict=True)) == sorted(own, key=lambda x: (x[0], x[2]))


def test_periodic_runs_of_texts(spark):
    rng = random.Random(4)
    texts = [None, "", "a " * 23, "a " * 24, "x " + "a b " * 12 + "y", *(" \n".join(periodic(rng, ["a", "bb", "é"])) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int").repartition(2)
    for r in periodic_runs(docs).collect():
        words = WORD.findall(texts[r.doc_id] or "")
        own = sorted(runs_by_period(words, 24, 3), key=lambda x: (x[0], x[2]))
        gone = {j for i, n, q in own for j in range(i + q, i + n)}
        assert [tuple(x) for x in r.runs] == own
        assert (r.n_words, r.collapsed) == (len(words), " ".join(w for j, w in enumerate(words) if j not in gone))


def test_periodic_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (1, "a " * 30), (1, "b " * 30), (2, "word")], "doc_id int, text string")
    assert sorted((r.doc_id or 0, r.collapsed, len(r.runs)) for r in periodic_runs(docs).collect()) == [(0, "a", 1), (1, "a", 1), (1, "b", 1), (2, "word", 0)]
    assert periodic_runs(docs.limit(0)).collect() == []
    long = "x" + " a b c" * 20_000
    assert [tuple(x) for x in periodic_runs(spark.createDataFrame([(1, long)], "doc_id int, text string")).first().runs] == [(1, 60_000, 3)]
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=1)


# op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(texts, items, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [Counter(TERM.findall((t or "").translate(lower))) for t in texts]
    lengths = [sum(c.values()) for c in found]
    n, total, df = sum(x > 0 for x in lengths), sum(lengths), Counter(t for c in found for t in c)
    out = []
    for text in items:
        score = []
        for d, c in enumerate(found):
            s = 0
            for t in set(TERM.findall((text or "").translate(lower))) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * lengths[d] * n // total)))
            score.append((-s, d))
        out.append([(d, -s) for s, d in sorted(score) if s][:k])
    return out


def searched(seed):
    rng = random.Random(seed)
    terms = ["É", "straße", "A1", "b-c", *(f"t{i}" for i in range(60))]
    weights = [1 / (1 + i) for i in range(len(terms))]
    texts = [None, "", "--", *(" ".join(rng.choices(terms, weights, k=rng.randint(1, 60))) for _ in range(150))]
    texts += texts[10:20]
    return texts, [None, "", "nowhere else", *(" ".join(rng.choices(terms, k=rng.randint(1, 20))) for _ in range(25)), "T1 t1 t1"]


@pytest.mark.parametrize("k", [1, 4, 10])
def test_ranking_equals_brute_force(spark, monkeypatch, k):
    import telluric.llm.lexical_search as module

    monkeypatch.setattr(module, "BLOCK", 2000)
    texts, asked = searched(k)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in enumerate(asked)], "item_id int, text string, doc_id int")
    for most in (500_000, 40):
        rows = lexical_search(docs, items, k=k, most=most).orderBy("item_id", "rank").collect()
        want = ranked(texts, asked, k)
        assert [(r.item_id, r["rank"], r.doc_id, r.score) for r in rows] == [(i, n + 1, *x) for i, found in enumerate(want) for n, x in enumerate(found)]


def test_ranking_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "one two"), (9, "three " * 30_000)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one"), (1, "three"), (None, "One!")], "item_id int, text string")
    rows = [(r.item_id, r["rank"], r.doc_id) for r in lexical_search(docs, items).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 1, 9), (None, 1, 5), (None, 2, 5), (None, 3, None)], key=str)
    assert lexical_search(docs.limit(0), items).collect() == []
    assert lexical_search(docs, items.where(F.lit(False))).collect() == []
