"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document goes into the open sequence for which the sum over all residual gaps of the squared number of
open sequences with that gap becomes smallest (Csirik et al., "On the Sum-of-Squares Algorithm for Bin
Packing", 2006); ties go to the smallest gap. Pieces are taken in descending length, and a sequence is
opened only where none has room: with 4096 gaps and a bounded number of pieces the free choice of a new
sequence leaves many of them half empty.

Pieces are dealt to shards by hash, each packed by one task; a shard holds about ``shard`` pieces, whatever
the number of documents. The sequences that a shard leaves unfilled are packed once more together with
those of other shards.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved
from telluric.llm.spread import in_runs, written_out

_ENCODERS: dict = {}


class Words:
    """Encodes texts by a public tokenizer that lower-cases, drops white space and marks the last token of a word.

    What stands between two blanks is encoded on its own and remembered, punctuation behind a word apart from it, as the
    tokenizer separates them. Words of letters are encoded many at a time in one text and told apart by the marks; anything
    else goes to the tokenizer as it is, and so does the whole of a text with one of the tokenizer's special tokens.
    """

    #: ASCII punctuation at the end of a word. A dotted capital I has a mark behind it in lower case, which stays with the punctuation
    BEHIND = r"([^\PL\x{130}])([!-/:-@\[-`{-~]+)( |$)"

    def __init__(self, path: str, remembered: int):
        # tasks run side by side already; the library's own threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.remembered = remembered

    def ask(self, words: list[str]) -> None:
        """Encode words one by one."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def ask_together(self, words: list[str], at_once: int = 500) -> None:
        """Encode words of letters, at_once in a text."""
        for k in range(0, len(words), 100 * at_once):
            parts = [words[b : b + at_once] for b in range(k, min(len(words), k + 100 * at_once), at_once)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(ends) == len(part):
                    ids = ids.tobytes()
                    self.known.update((w, ids[b:e]) for w, b, e in zip(part, [0, *ends], ends, strict=False))
                else:
                    self.ask(part)

    def learn(self, words: list[str]) -> None:
        """Encode the words that aren't known."""
        new = [w for w in words if w not in self.known]
        letters = pc.match_substring_regex(pa.array(new, pa.string()), r"^\pL+$").to_numpy(zero_copy_only=False)
        self.ask_together([w for w, plain in zip(new, letters, strict=True) if plain])
        self.ask([w for w, plain in zip(new, letters, strict=True) if not plain])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts in a row, and where each text's begin and the last one's end. No text is null."""
        if len(self.known) > self.remembered:
            self.known = dict(itertools.islice(self.known.items(), self.remembered // 2))  # frequent words came first
        special = pc.match_substring_regex(texts, self.special, ignore_case=True) if self.special else None
        whole: dict[int, np.ndarray] = {}
        if special is not None and pc.any(special).as_py():
            whole = {k: np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()}
            texts = pc.if_else(special, pa.scalar("", texts.type), texts)
        # the tokenizer does both itself; done here, fewer words differ. A dotted capital I has two lower-case characters
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "\u0130")).as_py():
            texts = pc.utf8_lower(texts)
        cut = pc.split_pattern(pc.replace_substring_regex(texts, self.BEHIND, r"\1 \2\3"), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        ids, sizes = written_out([self.known[w] for w in words], coded.indices.to_numpy())
        first = cut.offsets.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])[first - first[0]]
        if whole:
            parts = [whole.get(k, ids[b:e]) for k, (b, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


def token_pieces(
    docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", remembered: int = 200_000, waiting: int = 6 << 20
) -> DataFrame:
    """(id_col, piece, start, length, ids binary): each document's ids, then end_id, cut after every capacity ids.

    ids are little-endian unsigned 32-bit integers. Null and empty texts are end_id alone; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, remembered)
        words = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Words(vocabulary, remembered))
        for batch in in_runs(batches, "text", waiting):
            ids, bounds = words.encode(batch["text"])
            columns: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for k, b, e in zip(batch["id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[b:e], np.uint32(end_id))
                for n, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    for column, x in zip(columns, (k, n, at, len(part), part.tobytes()), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length (1 to capacity), numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            # (n-1)^2 - n^2 for the gap left, (m+1)^2 - m^2 for the gap made; a full sequence is no longer open
            change = 1 - 2 * count[gaps] + np.where(gaps == size, 0, 2 * count[gaps - size] + 1)
            gap = int(gaps[np.argmin(change)])
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, made
            made += 1
        sequence[k], offset[k] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_at[gap - size].append(at)
    return sequence, offset


def _placed(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "unit"], ascending=[False, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        used = np.bincount(sequence, rows["length"].to_numpy())
        return pd.DataFrame({"unit": rows["unit"], "length": rows["length"], "shard": rows["shard"], "sequence": sequence, "offset": offset, "full": used[sequence].astype(np.int64)})

    return run


def pack(pieces: DataFrame, *, capacity: int = 4096, shard: int = 20_000) -> DataFrame:
    """pieces (columns unit, a distinct long, and length, 1 to capacity) with sequence_id and offset, gapless from 0.

    Empty tables give empty results.
    """
    path = folder(pieces.sparkSession)
    schema = "unit long, length long, shard long, sequence long, offset long, full long"
    n = pieces.count()
    shards = max(1, round(n / shard))
    dealt = pieces.select("unit", "length", F.pmod(F.xxhash64("unit"), F.lit(shards)).alias("shard"))
    first = saved(dealt.groupBy("shard").applyInPandas(_placed(capacity), schema), f"{path}/first")
    # no two sequences of a shard are half empty, as one would have had room for the other: this is one sequence from each
    loose = F.col("full") * 2 <= capacity
    again = first.where(loose).select("unit", "length", F.floor(F.col("shard") / 64).alias("shard")).groupBy("shard").applyInPandas(_placed(capacity), schema)
    number = F.col("shard") * F.lit(1 << 32) + F.col("sequence")
    out = ("unit", "length", "sequence_id", "offset")
    return first.where(~loose).withColumn("sequence_id", number).select(*out).union(again.withColumn("sequence_id", -1 - number).select(*out))
