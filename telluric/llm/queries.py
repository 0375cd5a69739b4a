"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluric.llm.byte_bpe import bpe_decode, bpe_encode
from telluric.llm.chat_format import chat_format
from telluric.llm.embedding_dedup import embedding_dedup
from telluric.llm.exact_dedup import exact_dedup
from telluric.llm.html_text import html_text
from telluric.llm.lexical_search import lexical_search
from telluric.llm.packing import pack, token_pieces
from telluric.llm.periodic_runs import periodic_runs
from telluric.llm.quality import quality
from telluric.llm.shared import folder, saved, ship
from telluric.llm.simhash_dedup import simhash_dedup
from telluric.llm.substring_dedup import substring_dedup
from telluric.llm.toxicity import held_out, toxicity, training_rows
from telluric.llm.warc import read_warc, write_warc


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow's batches: texts and pages are long, and 10,000 rows of them, the default, take much memory on both sides."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The rows of op2_best_fit_packing for any documents: null and empty texts are one piece of one id, repeated rows are packed each; none give none."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    units = saved(digests.withColumn("unit", F.monotonically_increasing_id()), f"{folder(docs.sparkSession)}/pieces")
    placed = pack(units.select("unit", "length")).drop("length")
    return units.join(placed, "unit").drop("unit")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe_encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe_decode(ids, vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", F.col("junk").alias("score"), "kept")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/archives"
    write_warc(table(spark, sf_dir, "pages"), path)
    # what has just been written has no gaps
    lost = F.raise_error(F.concat(F.lit("lost bytes of "), "archive", F.lit(": "), "gap")).cast("boolean")
    return read_warc(spark, path).where(F.when(F.col("gap").isNull(), True).otherwise(lost)).selectExpr(
        "cast(regexp_extract(record_id, 'page:(-?[0-9]+)', 1) AS long) AS page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "cast(regexp_extract(refers_to, 'page:(-?[0-9]+)', 1) AS long) AS refers_to",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity(docs, training_rows(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def repeating(docs: DataFrame) -> DataFrame:
    """docs with the words of a tenth of the texts, by the checksum h of their id, replaced by repetitions of a part of their own."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    parts = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("__words", F.when(F.col("__h") % 10 == 0, words))
    where = {"n": "cast(size(__words) AS long)", "g": "(__h div 10)"}
    where |= {"a": "({g} % {n})".format(**where)}
    where |= {"p": "(1 + ({n} - {a}) div (3 + {g} % 8))".format(**where)}
    again = "array_join(transform(sequence(0, {n} - 1), i -> get(__words, cast(if(i < {a}, i, {a} + (i - {a}) % {p}) AS int))), ' ')".format(**where)
    return parts.withColumn("text", F.expr(f"CASE WHEN size(__words) > 0 THEN {again} ELSE text END")).drop("__h", "__words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the exponents a / b and c / d in whole numbers: a * d against c * b
    ahead = "array_sort(runs, (x, y) -> cast(sign(y.length * x.period - x.length * y.period) AS int))"
    text = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise("")
    return found.withColumn("top", F.expr(f"get({ahead}, 0)")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_best_fit_packing, op3_byte_bpe, op4_exact_dedup, op5_quality, op6_html_text, op7_chat_format, op8_embedding_dedup, op9_warc, op10_toxicity, op11_substring_dedup, op12_periodic_runs, op13_lexical_search)}

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), k AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op7_chat_format": """
        WITH t AS (
            SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                   list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
            FROM t GROUP BY conv_id
        ), p AS (
            SELECT c.conv_id, g.k, c.turns[1:g.k] AS head FROM c, generate_series(1, 100000) AS g(k) WHERE g.k < c.n_turns
        ), kept AS (
            SELECT min(conv_id) AS conv_id, n_turns FROM c
            WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = c.n_turns AND p.head = c.turns)
            GROUP BY turns, n_turns
        )
        SELECT t.conv_id, n_turns,
               string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
        FROM t JOIN kept USING (conv_id) GROUP BY ALL
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE x AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(v, lambda c: c / list_aggregate(list_transform(v, lambda b: abs(b)), 'max')) AS s
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM x AS a JOIN x AS b ON a.vec_id <> b.vec_id AND len(a.s) = len(b.s) WHERE list_cosine_similarity(a.s, b.s) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON l.a = r.b
        ), c AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f
    """,
    "op11_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS passage FROM d, unnest(range(1, len(words) - 33)) AS t(i)
        ), r AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY passage) AS n FROM w) WHERE n > 1
        ), c AS (
            SELECT DISTINCT doc_id, j FROM r, unnest(range(i, i + 35)) AS t(j)
        ), k AS (
            SELECT d.doc_id, count(x.word) AS n_words, count(c.j) AS n_removed,
                   coalesce(string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL), '') AS kept
            FROM d LEFT JOIN (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d) AS x USING (doc_id)
            LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j
            GROUP BY d.doc_id
        )
        SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
    """,
    "op12_periodic_runs": r"""
        WITH RECURSIVE bytes AS (
            SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents
        ), crc(doc_id, s, k, c) AS (
            SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM bytes
            UNION ALL
            SELECT doc_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(s[k // 9 + 1])) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
            FROM crc WHERE k < 9 * len(s)
        ), hash AS (
            SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = 9 * len(s)
        ), d AS (
            SELECT doc_id, h % 10 = 0 AS again, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents JOIN hash USING (doc_id)
        ), e AS (
            SELECT *, CASE WHEN len(words) > 0 THEN g % len(words) END AS a FROM d
        ), f AS (
            SELECT *, 1 + (len(words) - a) // (3 + g % 8) AS p FROM e
        ), w AS MATERIALIZED (
            SELECT doc_id, i, words[CASE WHEN again AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM f, unnest(range(len(words))) AS t(i)
        ), pairs AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
        ), stretches AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY doc_id, q, island
        ), runs AS MATERIALIZED (
            SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
        ), gone AS (
            SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS t(i)
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        ), r AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                   first({'start': start, 'length': length, 'period': period} ORDER BY length / period DESC, start, period) AS top
            FROM runs GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), c AS (
            SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), p AS (
            SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term
        ), t AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score
            FROM i JOIN p USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
