"""Exact dedup by an extendible-hash index kept in shared files, in DataFrame functions only.

A text's key is the 64-bit hash of its normal form (the text without the characters [\\x20\\x09-\\x0D]).

Entries. The texts are read once; what stays is a row of numbers and the normal form's SHA-256.

Directory. It maps a key's leading bits to a bucket: a bucket with more than ``capacity`` distinct keys is
split by one more bit, which doubles the directory where needed. A key's local depth has a closed form: the
number of its prefixes that hold more than ``capacity`` keys. The directory grows with the load up to
2**MOST_BITS cells, beyond that the buckets do, so its size is bounded and it may be broadcast.

Owners. Keys that occur once need no comparison. The texts of the others are fetched, and the index is laid out
by bucket, in the order of the key ranges that buckets stand for: its owner task chains the different texts of a
key one behind the other. Bytes are compared in Spark's grouping by bucket, key and text, whose partial
aggregation leaves one row a task of a group of copies, even if that has a third of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, numbered, saved

SPACES = " \t\n\x0b\x0c\r"
MOST_BITS = 16


def normal_form(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _cell(key: Column, bits: int) -> Column:
    """The leading bits of a key, unsigned."""
    return F.shiftrightunsigned(key, 64 - bits)


def directory(keys: DataFrame, capacity: int, max_bits: int) -> DataFrame:
    """(cell, bucket, first) for every cell of max_bits leading bits that has keys; first is the first cell of the bucket's range.

    keys: a column key, repeats allowed.
    """
    cells = keys.select("key").distinct().groupBy(_cell(F.col("key"), max_bits).alias("cell")).agg(F.count("*").alias("n"))
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_bits - 1))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(cell, {max_bits} - depth)")
    )
    # at most max_bits for each cell, so no more rows than a small multiple of the directory's bound
    full = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("load")).where(F.col("load") > capacity).select("depth", "prefix", F.lit(1).alias("full"))
    local = prefixes.join(F.broadcast(full), ["depth", "prefix"], "left").groupBy("cell").agg(F.coalesce(F.sum("full"), F.lit(0)).cast("int").alias("local"))
    prefix = f"shiftrightunsigned(cell, {max_bits} - local)"
    return local.select("cell", F.expr(f"shiftleft(1L, local) + {prefix}").alias("bucket"), F.expr(f"shiftleft({prefix}, {max_bits} - local)").alias("first"))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, row: Column, capacity: int, max_bits: int | None) -> DataFrame:
    """(id, row, keep_id, keep_row, group_size, sha) of every row of docs."""
    path = folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), normal_form(F.col(text_col)).alias("norm"))
    entries = saved(rows.select("id", "row", "points", F.xxhash64("norm").alias("key"), _sha(F.col("norm")).alias("sha")), f"{path}/entries")
    keys = saved(entries.groupBy("key").agg(F.count("*").alias("n")), f"{path}/keys")
    n = keys.count()
    bits = max_bits or min(MOST_BITS, max(1, math.ceil(math.log2(max(1, n / capacity))) + 4))
    slots = saved(directory(keys, max(capacity, n >> (MOST_BITS - 4)), bits), f"{path}/directory")
    slot = _cell(F.col("key"), bits)
    repeated = keys.where("n > 1").withColumn("cell", slot).join(F.broadcast(slots), "cell").select("key", "bucket", "first")
    repeated = saved(repeated.repartitionByRange("first", "key"), f"{path}/repeated")
    order = F.col("points").cast("decimal(10,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") - F.coalesce(F.col("id"), F.lit(2**63 - 1)).cast("decimal(20,0)")
    # Spark broadcasts the repeated keys if their table is small, and shuffles otherwise
    fetched = rows.withColumn("key", F.xxhash64("norm")).withColumn("order", order).join(repeated, "key")
    compared = fetched.groupBy("first", "bucket", "key", "norm").agg(F.max_by("id", "order").alias("keep_id"), F.max_by("row", "order").alias("keep_row"), F.count("*").alias("group_size"))
    chained = compared.select("first", "bucket", "key", _sha(F.col("norm")).alias("sha"), "keep_id", "keep_row", "group_size")
    index = saved(chained.repartitionByRange("first").sortWithinPartitions("first", "key", "sha"), f"{path}/index")
    found = entries.join(index.withColumn("many", F.lit(True)), ["key", "sha"], "left")
    return found.select(
        "id",
        "row",
        F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.when(F.col("many"), F.col("keep_row")).otherwise(F.col("row")).alias("keep_row"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "sha",
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, max_bits: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of texts with equal normal forms the row with the most code points in the original text stays, then the smallest id; a
    null id counts as the largest. Null texts count as empty. Rows that repeat an id and a text are one document listed
    again and share their verdict; without_copies leaves one of them. Empty tables give empty results; other columns are
    ignored. max_bits fixes the directory's size, which otherwise grows with the number of keys.
    """
    return _verdicts(docs, id_col, text_col, F.lit(0), capacity, max_bits).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, max_bits: int | None = None) -> DataFrame:
    """One row of docs, with its columns, for each group of texts with equal normal forms, chosen as in exact_dedup.

    Rows are judged one by one, so ids may be null or repeated: another text of the same id has its own verdict, and of rows
    that repeat an id and a text one stays. Null texts count as empty; empty tables give empty results.
    """
    rows, row = numbered(docs)
    gone = _verdicts(rows, id_col, text_col, F.col(row), capacity, max_bits).where("row <> keep_row").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
