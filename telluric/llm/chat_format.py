"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation is often a snapshot of a longer one: its turns are the first turns of the other.
Every turn gets a digest of its role, text and place; the running combination of the digests' hashes over a
conversation is a hash of each of its turn prefixes. A conversation whose last prefix hash is a prefix
hash of a longer conversation is a snapshot of that one, its witness; of equal conversations the one with the
smallest conv_id is the others' witness. Turns are compared with the witness's turns one by one, by their digests
(SHA-256), so that no text is moved for it, and an anti-join leaves the conversations without a witness, the maximal ones, which are rendered turn by turn.

The running hashes are made in two steps, within blocks of ``block`` turns and then over the blocks, so
that one conversation with very many turns is dealt out to many tasks; its text is put together from its
blocks' texts in the end, as it is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved

#: What orders turns, and blocks; a block's turns follow one another in the first order.
ORDER, BLOCKS = ("turn", "role", "text"), ("part", "of_role", "head")


def turns_in_blocks(conversations: DataFrame, block: int) -> DataFrame:
    """(conv_id, turn, role, text, part, of_role, head, digest, k, x1, x2): the distinct turns, with a digest of role, text and place.

    k counts a block's turns up to this one, x1 and x2 are what the two 64-bit hashes of their digests make together. Repeated rows count once. Turns of
    one conversation are ordered by turn, role and text, nulls first. Rows without a turn number are blocks by role and the first
    two characters of the text, so that many of them are no single block either.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).distinct()
    none = F.col("turn").isNull()
    # no two places, roles and texts are put together alike: lengths come before what they measure
    said = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col("turn").cast("string"), F.col("role"), F.col("text"))]
    rows = rows.withColumns(
        {
            "part": F.floor(F.col("turn") / block).cast("long"),
            "of_role": F.when(none, F.col("role")),
            "head": F.when(none, F.substring("text", 1, 2)),
            "digest": F.unhex(F.sha2(F.concat(*said).cast("binary"), 256)),
        }
    )
    within = Window.partitionBy("conv_id", *BLOCKS).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    hashes = {f"x{n}": F.bit_xor(F.xxhash64(F.lit(n), "digest")).over(within) for n in (1, 2)}
    return rows.withColumns({"k": F.count("*").over(within), **hashes})


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, digest) of each turn, without its text: the hashes of the conversation's first n turns, and the n-th one's digest."""
    before = Window.partitionBy("conv_id").orderBy(*BLOCKS).rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", *BLOCKS).agg(F.max("k").alias("n"), F.max_by("x1", "k").alias("x1"), F.max_by("x2", "k").alias("x2"))
    start = parts.select(
        F.col("conv_id").alias("c"),
        *(F.col(b).alias(f"b_{b}") for b in BLOCKS),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("b2"),
    )
    run = turns.select("conv_id", *BLOCKS, "k", "x1", "x2", "digest")
    same = [F.col("conv_id") == F.col("c"), *(F.col(b).eqNullSafe(F.col(f"b_{b}")) for b in BLOCKS)]
    return run.join(start, same).select(
        "conv_id", (F.col("k") + F.col("n0")).alias("n"), F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("p2"), "digest"
    )


def witnesses(prefix: DataFrame) -> DataFrame:
    """(conv_id, n_turns, witness): of each conversation a longer one that begins with the same hashes, or else the first equal one if that is another; null if there is none."""
    last = prefix.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    marked = prefix.join(last, "conv_id").select("conv_id", "n", "p1", "p2", "n_turns")
    key = ["p1", "p2", "n"]
    known = marked.groupBy(*key).agg(F.min(F.when(F.col("n") < F.col("n_turns"), F.col("conv_id"))).alias("longer"), F.min(F.when(F.col("n") == F.col("n_turns"), F.col("conv_id"))).alias("equal"))
    found = marked.where("n = n_turns").join(known, key)
    return found.select("conv_id", "n_turns", F.coalesce("longer", F.when(F.col("equal") < F.col("conv_id"), F.col("equal"))).alias("witness"))


def confirmed(prefix: DataFrame, seen: DataFrame) -> DataFrame:
    """(conv_id) of the conversations all of whose turns are their witness's turns, by the turns' digests."""
    of = prefix.join(seen.where("witness IS NOT NULL"), "conv_id").select("conv_id", "n_turns", "witness", "n", "digest")
    there = prefix.select(F.col("conv_id").alias("w"), F.col("n").alias("m"), F.col("digest").alias("w_digest"))
    same = of.join(there, (F.col("witness") == F.col("w")) & (F.col("n") == F.col("m")) & (F.col("digest") == F.col("w_digest")))
    return same.groupBy("conv_id", "n_turns").agg(F.count("*").alias("k")).where("k = n_turns").select("conv_id")


def chat_format(conversations: DataFrame, *, block: int = 64, open_mark: str = "<|im_start|>", close_mark: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, text): the maximal conversations, rendered, one row each.

    Each turn is open_mark, role, line feed, text, close_mark and line feed, by turn, role and text (nulls first: rows that share a
    turn number all count). Null roles and texts render empty, rows without a conv_id are left out, repeated rows count once, marks
    inside a text stay as they are. Empty tables give empty results; other columns are ignored. A conversation's text is one value, so
    it has Spark's limit of 2 GB.
    """
    path = folder(conversations.sparkSession)
    turns = saved(turns_in_blocks(conversations, block), f"{path}/turns")
    prefix = saved(prefixes(turns), f"{path}/prefixes")
    seen = saved(witnesses(prefix), f"{path}/witnesses")
    kept = saved(seen.join(confirmed(prefix, seen), "conv_id", "left_anti").select("conv_id", "n_turns"), f"{path}/maximal")
    line = F.concat(F.lit(open_mark), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(close_mark + "\n"))
    lines = turns.select("conv_id", *BLOCKS, "k", line.alias("line"))
    # what fits into a few blocks is put together at once, the rest block by block
    short = F.col("n_turns") <= 4 * block
    whole = lines.join(kept.where(short), "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct(*BLOCKS, "k", "line"))).alias("x"))
    blocks = lines.join(kept.where(~short), "conv_id").groupBy("conv_id", "n_turns", *BLOCKS).agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("x"))
    texts = blocks.select("conv_id", "n_turns", F.struct(*BLOCKS, F.array_join(F.col("x.line"), "").alias("line")).alias("b"))
    texts = texts.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("b")).alias("x"))
    rendered = ["conv_id", "n_turns", F.array_join(F.col("x.line"), "").alias("text")]
    return whole.select(*rendered).union(texts.select(*rendered))
