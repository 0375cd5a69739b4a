"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Kernel. A word is described by all its subsequences of three characters, each weighted by decay**(the stretch it
covers), so that insults with gaps, inserted or lost characters keep most of their weight (Lodhi et al., "Text
Classification using String Kernels", 2002); K(s, t) is the product of two such descriptions of unit length by
the number of characters.

Training. The examples are labelled sentences; a sentence is as toxic as its worst word, and a document as its worst sentence,
so the SVM is a multiple-instance one (Andrews et al., "Support Vector Machines for Multiple-Instance Learning", 2002): a toxic
document enters by the witness of its worst sentence, the word that the present decision function scores highest, and witnesses
are chosen anew after each fit. The first function comes from words that toxic documents have significantly more often, near copies counted
once, against a spread of others. Witnesses are positive examples where the function is positive
and the word isn't as common in clean documents; in a clean sentence every word is a negative one, and those that the function
scores highest are added in each round. Positive examples weigh by the number of their documents. Virtual examples (DeCoste and
Schölkopf, "Training Invariant Support Vector Machines", 2002) say that a letter put in changes nothing: positive words are positive
with any letter at any place inside as well. A linear SVM is fitted on the Nyström features K(s, Z) K(Z, Z)^(-1/2) with landmarks from both sides. As the decision
function is a sum of kernels with the landmarks, it folds into one weight for each character triple.

Scoring. Every distinct word of a whole text is scored; a logistic function of the text's highest scores gives the
result. Letters that stand alone in a row ("i d i o t") are joined to a word first, other characters are taken out.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved

ALPHABET = 40  # ^ and $ for the ends of a word, 26 letters, one for all digits, 11 for all other letters by hash
DECAY = 0.7
REACH = 7  # the longest stretch that a subsequence covers
WINDOW = 20  # longer words are read through windows of so many characters, a third of them shared
LEVELS = 5
APART = re.compile(r"(?<!\S)\w(?:[\W_]{1,3}\w){3,}(?!\w)")
NOT_LETTERS = re.compile(r"[\W_]+")


def normal(token: str) -> str:
    """A token's word: letters and digits only; digits inside a word stand for the letters they resemble."""
    word = token if token.isalnum() else NOT_LETTERS.sub("", token)
    if not word.isalpha() and any(map(str.isalpha, word)):
        word = word.translate(str.maketrans("013457", "oleast"))
    return word


def tokens(text: str) -> set[str]:
    """The distinct tokens of a lower-cased text, and the words that letters standing alone in a row make."""
    text = text.lower()
    found = set(text.split())
    if sum(len(t) == 1 for t in found) >= 3:
        found.update(NOT_LETTERS.sub("", m) for m in APART.findall(text))
    return found


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (n, 3) of the subsequences of a word of some length, and their weights at unit length."""
    at = np.array([c for c in itertools.combinations(range(length), 3) if c[2] - c[0] < REACH], np.int64).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / (np.sqrt((weight**2).sum()) or 1.0)


_PLACES = {n: _triples(n) for n in range(3, WINDOW + 1)}


def codes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of words, code of each subsequence, weights) for the words of each length; shorter ones than 3 have none."""
    by: dict[int, list[tuple[int, str]]] = {}
    for k, w in enumerate(words):
        w = "^" + w + "$" if len(w) < WINDOW - 1 else w
        for b in range(0, max(1, len(w) - WINDOW // 3), WINDOW - WINDOW // 3):
            part = w[b : b + WINDOW]
            by.setdefault(len(part), []).append((k, part))
    for n, some in by.items():
        if n < 3:
            continue
        points = np.frombuffer("".join(p for _, p in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.int64)
        small = 29 + (points * 31 + points // 64) % 11
        for low, high, first in ((94, 94, 0), (36, 36, 1), (97, 122, 2)):
            small = np.where((points >= low) & (points <= high), points - low + first, small)
        small = np.where((points >= 48) & (points <= 57), 28, small)
        at, weight = _PLACES[n]
        yield np.array([k for k, _ in some]), (small[:, at[:, 0]] * ALPHABET + small[:, at[:, 1]]) * ALPHABET + small[:, at[:, 2]], weight


def decide(words: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    """The decision function for each word, the highest of its windows."""
    out = np.full(len(words), bias - 1.0)
    for index, code, weight in codes(words):
        for b in range(0, len(index), 20_000):
            np.maximum.at(out, index[b : b + 20_000], beta[code[b : b + 20_000]] @ weight + bias)
    return out


def describe(words: list[str]) -> np.ndarray:
    """The words' descriptions over all triples, one column each: for landmarks, a few hundred."""
    out = np.zeros((ALPHABET**3, len(words)), np.float32)
    for index, code, weight in codes(words):
        np.add.at(out, (code, index[:, None]), weight)
    return out


def kernel(words: list[str], marks: np.ndarray) -> np.ndarray:
    """K(words, landmarks) from the landmarks' descriptions."""
    out = np.zeros((len(words), marks.shape[1]))
    for index, code, weight in codes(words):
        for b in range(0, len(index), 50):
            np.add.at(out, index[b : b + 50], np.einsum("ntm,t->nm", marks[code[b : b + 50]], weight.astype(np.float32)))
    return out


def gapped(words: dict[str, float], share: float = 0.5, letters: int = 8) -> dict[str, float]:
    """Words with a letter put in, some letters for each place inside a word; those of one word weigh a share of it together."""
    out: dict[str, float] = {}
    for word, weight in words.items():
        places = [(i, k) for i in range(1, len(word)) for k in range(letters)]
        for i, k in places:
            letter = chr(97 + xxhash.xxh32_intdigest(f"{k} {i} {word}".encode("utf-8", "surrogatepass")) % 26)
            made = word[:i] + letter + word[i:]
            out[made] = out.get(made, 0.0) + share * weight / len(places)
    return out


def fit_words(positive: dict[str, float], negative: dict[str, float], landmarks: int = 320, rounds: int = 1500, virtual: int = 6_000) -> tuple[np.ndarray, float]:
    """(weight of each triple, bias) of the SVM on Nyström features, from words with their weights as examples.

    The first of either side are the landmarks. At most so many virtual examples, spread by hash, are added to the positive ones.
    Without examples of both sides the function is never positive.
    """
    if not positive or not negative:
        return np.zeros(ALPHABET**3), -1.0
    made = gapped(positive)
    spread = sorted(made.keys() - positive.keys() - negative.keys(), key=lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))
    positive = positive | {w: made[w] for w in spread[:virtual]}
    half = landmarks // 2
    marks = describe([*list(positive)[:half], *list(negative)[: landmarks - min(half, len(positive))]])
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel([*positive, *negative], marks) @ root
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = np.array([*positive.values(), *negative.values()], np.float64)
    for side in (y > 0, y < 0):
        share[side] *= 0.5 / share[side].sum()
    v, b = np.zeros(x.shape[1]), 0.0
    for k in range(rounds):
        inside = share * (y * (x @ v + b) < 1) * y
        step = 6.0 / (1 + k / 100)
        v += step * (x.T @ inside - 2e-5 * v)
        b += step * 0.3 * inside.sum()
    # in single precision: marks is the largest array, and would be copied to doubles
    return (marks @ (root @ v).astype(np.float32)).astype(np.float64), float(b)


class Scorer:
    """Scores texts by their words; remembers the decisions for up to so many tokens."""

    def __init__(self, beta: np.ndarray, bias: float, remembered: int = 600_000):
        self.beta, self.bias, self.remembered = beta, bias, remembered
        self.known: dict[str, float] = {}

    def levels(self, texts: list[str]) -> np.ndarray:
        """Of each text: the LEVELS highest decisions of distinct words, each cut to [-1, 1.5], highest first; missing ones are -1."""
        if len(self.known) > self.remembered:
            self.known.clear()
        found = [tokens(t) for t in texts]
        new: set[str] = set()
        for f in found:
            new.update(f.difference(self.known))
        order = list(new)
        for k in range(0, len(order), 50_000):
            some = order[k : k + 50_000]
            self.known.update(zip(some, decide([normal(t) for t in some], self.beta, self.bias).tolist(), strict=True))
        out = np.full((len(texts), LEVELS), -1.0)
        for k, f in enumerate(found):
            x = np.fromiter(map(self.known.__getitem__, f), np.float64, len(f))
            if len(x) > LEVELS:
                x = np.partition(x, len(x) - LEVELS)[-LEVELS:]
            out[k, : len(x)] = np.sort(np.clip(x, -1, 1.5))[::-1]
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 4000) -> np.ndarray:
    """Logistic regression (bias first); weight is how many rows each row stands for, 1 if not given."""
    x = np.column_stack([np.ones(len(x)), x])
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w[0] = -2.0
    share = (np.ones(len(x)) if weight is None else weight) / max(1e-9, len(x) if weight is None else weight.sum())
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        speed = 0.9 * speed - 0.3 * (x.T @ (share * (p - y)) + 1e-4 * np.r_[0, w[1:]])
        w = w + speed
    return w


def _leveled(beta: np.ndarray, bias: float, logistic: np.ndarray | None):
    """Batches of (id, text, ...) to (id, ..., levels or score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(beta, bias)
        for batch in batches:
            parts = []
            for k in range(0, batch.num_rows, 1000):
                parts.append(scorer.levels([x.as_py() or "" for x in batch["text"].slice(k, 1000)]))
            levels = np.concatenate(parts) if parts else np.zeros((0, LEVELS))
            rest = [n for n in batch.schema.names if n != "text"]
            if logistic is None:
                last = pa.array(list(levels), pa.list_(pa.float64()))
            else:
                last = pa.array(1 / (1 + np.exp(-np.clip(logistic[0] + levels @ logistic[1:], -500, 500))))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), last], [*rest, "out"])

    return run


SENTENCE = re.compile(r"[.!?\n]+")


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label) once for each labelled document that has it in a sentence."""
    for batch in batches:
        words, labels = [], []
        for t, y in zip(batch["text"], batch["label"].to_pylist(), strict=True):
            found = {normal(x) for s in SENTENCE.split(t.as_py() or "") for x in tokens(s)}
            found = [w for w in found if len(w) > 2]
            words += found
            labels += [y] * len(found)
            if len(words) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], ["word", "label"])
                words, labels = [], []
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], ["word", "label"])


def _witnesses(beta: np.ndarray, bias: float):
    """(word, label, d) of each labelled document's worst sentence: its word with the highest decision d, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            bags = [{w for s in SENTENCE.split(t.as_py() or "") for x in tokens(s) if len(w := normal(x)) > 2} for t in batch["text"]]
            new = list(set().union(*bags).difference(known))
            for k in range(0, len(new), 50_000):
                known.update(zip(new[k : k + 50_000], decide(new[k : k + 50_000], beta, bias).tolist(), strict=True))
            best = [(min(b, key=lambda w: (-known[w], w)), y) for b, y in zip(bags, batch["label"].to_pylist(), strict=True) if b]
            columns = [pa.array([w for w, _ in best], pa.string()), pa.array([y for _, y in best], pa.int32()), pa.array([known[w] for w, _ in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "label", "d"])
            if len(known) > 1_000_000:
                known.clear()

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the lowest and the highest hash of three words in a row."""
    for batch in batches:
        low, high = [], []
        for t in batch["text"]:
            words = t.as_py().lower().encode("utf-8", "surrogatepass").split()
            h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3])) >> 1 for k in range(max(1, len(words) - 2))]
            low.append(min(h))
            high.append(max(h))
        columns = [batch["label"], batch["text"], batch["stands_for"], pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["label", "text", "stands_for", "low", "high"])


def _decided(beta: np.ndarray, bias: float):
    """Batches of words with their decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = decide(batch["word"].to_pylist(), beta, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "d"])

    return run


def train(labelled: DataFrame, *, rounds: int = 2, frequent: int = 400, spread: int = 1_500, hard: int = 1_500, witnesses: int = 3_000) -> tuple[np.ndarray, float, np.ndarray]:
    """(triple weights, bias, logistic) from all rows (text, label 0/1); their number is to be bounded by the caller, see training_rows.

    rounds is how often witnesses are chosen. The bounds of the kernel machine are on distinct words: so many frequent ones and so many
    spread by hash as the first negative examples, so many hard ones more in each round, and so many witnesses of most sentences.

    A column stands_for says how many labelled documents a row stands for, 1 without it: the logistic function weighs both
    labels as often as they occur among all labelled documents, so that a score means the same however many were sampled.
    """
    spark, path = labelled.sparkSession, folder(labelled.sparkSession)
    # copies and near copies of a text tell nothing new, but would make chance words look significant: of the texts of one
    # label that share the lowest or the highest hash of three words in a row, one is used
    stands = F.col("stands_for").cast("double") if "stands_for" in labelled.columns else F.lit(1.0)
    rows = labelled.where("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"), stands.alias("stands_for"))
    rows = rows.mapInArrow(_sketched, "label int, text string, stands_for double, low long, high long")
    used = rows.groupBy("label", "low").agg(F.min(F.struct("high", "text")).alias("x"), F.sum("stands_for").alias("stands_for"))
    used = used.groupBy("label", "x.high").agg(F.min("x.text").alias("text"), F.sum("stands_for").alias("stands_for"))
    used = saved(used.select("label", "text", "stands_for"), f"{path}/sample")
    sizes = used.groupBy("label").agg(F.count("*").alias("n"), F.sum("stands_for").alias("of")).collect()
    n, weight = {r["label"]: r["n"] for r in sizes}, {r["label"]: round(r["of"]) / r["n"] for r in sizes}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return np.zeros(ALPHABET**3), -1.0, np.array([-4.0 if clean or not toxic else 4.0] + [0.0] * LEVELS)
    counts = saved(
        used.select("text", "label").mapInArrow(_words_of, "word string, label int").groupBy("word").agg(F.sum("label").cast("long").alias("t"), F.sum(1 - F.col("label")).cast("long").alias("c")),
        f"{path}/words",
    )
    # the signed root of the likelihood ratio against the same rate on both sides
    rate = (F.col("t") + F.col("c")) / float(toxic + clean)
    gain = F.col("t") * F.log((F.col("t") + 1e-9) / (toxic * rate)) + F.col("c") * F.log((F.col("c") + 1e-9) / (clean * rate))
    told = counts.withColumn("gain", F.when(F.col("t") * float(clean) > 8.0 * toxic * F.col("c"), gain).otherwise(0.0))
    positive = {r["word"]: float(r["t"]) for r in told.where("gain >= 8 AND t >= 4").orderBy(F.desc("gain"), "word").collect()}
    other = told.where("c > 0 AND gain < 2").select("word", "c")

    def weights(rows: DataFrame, n: int) -> dict[str, float]:
        return {r["word"]: float(np.sqrt(r["c"])) for r in rows.limit(n).collect()}

    negative = weights(other.orderBy(F.desc("c"), "word"), frequent) | weights(other.orderBy(F.xxhash64("word"), "word"), spread)
    beta, bias = fit_words(positive, negative)
    for _ in range(rounds if positive else 0):
        found = used.where("label = 1").select("text", "label").mapInArrow(_witnesses(beta, bias), "word string, label int, d double").where("d > 0")
        rare = counts.where(F.col("t") * float(clean) > 8.0 * toxic * F.col("c")).where("t >= 2").select("word", "t")
        seen = found.groupBy("word").agg(F.count("*").alias("n")).join(rare, "word").orderBy(F.desc("n"), "word").limit(witnesses).collect()
        decided = other.mapInArrow(_decided(beta, bias), "word string, c long, d double").where("d > -1")
        negative = weights(decided.orderBy(F.desc((F.col("d") + 1) * F.sqrt("c")), "word"), hard) | negative
        beta, bias = fit_words(positive | {r["word"]: float(r["t"]) for r in seen}, negative)
    seen = used.select("label", "text").mapInArrow(_leveled(beta, bias, None), "label int, out array<double>").collect()  # two rows of numbers for each row of the sample
    y = np.array([r["label"] for r in seen], np.float64)
    return beta, bias, fit_logistic(np.array([r["out"] for r in seen]), y, np.array([weight[r["label"]] for r in seen]))


def toxicity(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 at threshold or more).

    labelled has rows (text, label) and may have stands_for, see train. Only the text enters a score. Null texts count as empty and are scored like them;
    without labels of both kinds every score is the same. Repeated rows get equal scores; empty tables give empty results.
    """
    beta, bias, logistic = train(labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_leveled(beta, bias, logistic), "id long, out double")
    return scored.select(F.col("id").alias(id_col), F.col("out").alias("score"), (F.col("out") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of training: crc32 of its id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, *, sample: int = 6_000) -> DataFrame:
    """(text, label, stands_for) of about sample labelled documents of either label, spread by hash of their ids; none is held out.

    stands_for is how many documents of its label a sampled one stands for; of rows that repeat an id one text counts. The labels are sampled before the documents are read, so only what is used is joined; 3 * sample rows at most are
    broadcast.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    size = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("label") == 1, min(1.0, sample / max(1, size.get(1, 0)))).otherwise(min(1.0, sample / max(1, size.get(0, 0))))
    picked = saved(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).withColumn("stands_for", 1 / part).limit(3 * sample), f"{folder(docs.sparkSession)}/picked")
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("stands_for").alias("stands_for")).drop("doc_id")


def civil(docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that aren't predicted toxic, each judged where it is."""
    beta, bias, logistic = train(labelled)

    @F.pandas_udf("boolean")
    def kept(runs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(beta, bias)
        for texts in runs:
            levels = scorer.levels([t or "" for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(logistic[0] + levels @ logistic[1:], -500, 500))) < threshold)

    return docs.where(kept(F.col(text_col)))
