"""Queries over tables with planted links, snapshots, revisits and near copies, against their SQL or brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from compare import TABLES, assert_same

from telluric.llm import queries
from telluric.llm.embedding_dedup import embedding_dedup

SF = "/root/testdata/sf0.001"


def beside(tmp_path, name, table):
    """A folder with the tables of SF, but one of them replaced."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    pq.write_table(table, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_embeddings_with_links_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(61)
    base = rng.normal(size=(60, 16))
    rows = [v for v in base]
    for k in range(30):  # chains and stars of near copies, scaled copies and exact ones
        a = base[k % 12]
        rows += [a + rng.normal(size=16) * 0.08, a * 2.5, a.copy()]
    rows = [v.astype(np.float32).tolist() for v in rows]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 8, [2.0] * 8]
    table = pa.table({"vec_id": pa.array(rng.permutation(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    sf = beside(tmp_path, "embeddings", table)
    found = queries.QUERIES["op8_embedding_dedup"](spark, sf)
    assert found.where("n_links > 0").count() > 90 and found.where("NOT kept").count() > 60
    assert_same(found, queries.ORACLE_SQL["op8_embedding_dedup"], sf)


def test_embeddings_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(62)
    a, b = rng.normal(size=(2, 8)).tolist()
    rows = spark.createDataFrame([(None, a), (3, a), (3, a), (5, b), (5, a), (None, b), (9, [float(-x) for x in a])], "vec_id long, embedding array<double>")
    found = embedding_dedup(rows).collect()
    assert len(found) == 7
    by_id = {r.vec_id: r for r in found if r.vec_id == 9}
    assert by_id[9].n_links == 0 and by_id[9].component_id == 9 and by_id[9].kept


def test_conversations_with_snapshots_equal_sql(spark, tmp_path):
    rng = random.Random(63)
    rows = []
    for c in range(40):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "ü" * rng.randint(1, 4)])) for _ in range(rng.randint(1, 9))]
        for n, size in enumerate({len(turns), *rng.sample(range(1, len(turns) + 1), min(2, len(turns)))}):
            rows += [(10 * c + n, t, *turns[t]) for t in range(size)]
        if c % 5 == 0:
            rows += [(10 * c + 9, t, *turns[t]) for t in range(len(turns))]  # an equal one
    rows += rows[:7]
    conv, turn, role, text = zip(*rows, strict=True)
    table = pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": role, "text": text})
    sf = beside(tmp_path, "conversations", table)
    found = queries.QUERIES["op7_chat_format"](spark, sf)
    assert found.count() < len(set(conv)) - 30
    assert_same(found, queries.ORACLE_SQL["op7_chat_format"], sf)


def test_pages_with_revisits_equal_sql(spark, tmp_path):
    rng = random.Random(64)
    bodies = ["<p>" + "é" * n + "</p>" for n in (10, 46, 47, 60, 3000)] + ["", None]
    html = [rng.choice(bodies) for _ in range(80)]
    table = pa.table({"page_id": pa.array(rng.sample(range(1000), 80), pa.int64()), "url": [f"http://h{k % 3}.example/{k}" for k in range(80)], "html": pa.array(html, pa.string())})
    sf = beside(tmp_path, "pages", table)
    found = queries.QUERIES["op9_warc"](spark, sf)
    assert found.where("record_type = 'revisit'").count() > 20
    assert_same(found, queries.ORACLE_SQL["op9_warc"], sf)


def _fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(65)
    words = [f"W{k}é" for k in range(300)]
    texts = [None, "", "One", "one two", "ONE two"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(40, 400))]
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    ids = rng.sample(range(5000), len(texts))
    none = pa.array([""] * len(texts))
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": none, "source": none, "n_chars": pa.array([0] * len(texts), pa.int64())})
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash_dedup"](spark, beside(tmp_path, "documents", table)).collect()}
    prints = [_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        new = [min(root[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == root:
            break
        root = new
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(ids[i])
    assert found == {ids[i]: (f"{prints[i]:016x}", min(groups[r])) for i, r in enumerate(root)}
    assert len(groups) < len(texts)
