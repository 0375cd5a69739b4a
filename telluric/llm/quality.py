"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote on a document: 1 junk, 0 sound, or abstain. The votes of all documents
are counted by pattern (Spark; at most 3**labellers patterns, so the counts fit anywhere), and
expectation-maximisation on these counts estimates how often each labeller votes either way. As junk is of many
kinds, and labellers that see one kind are blind to others, there is a latent class for each kind, which starts from
the votes of one labeller, and one of sound documents. The posterior of all kinds together labels a bounded sample of
documents, spread evenly by the hash of their ids, and a linear scorer on hashed features of the text (its measures,
its words, and triples of character classes) is fitted to the posteriors. Every document is scored by that scorer on
its whole text.

The labellers' thresholds are plain rules of thumb for prose, with room between both votes: e.g. a word of five that
repeats the one before it (0.2) never occurs in prose, one of twenty (0.05) may. No label of the given tables enters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved

BUCKETS = 1 << 11
ABSTAIN = -1


def measures(words: list[str]) -> tuple[dict[str, float], Counter]:
    """What the labellers look at, from all words of a text, and how often each word occurs. Shares of texts without words are 0."""
    n, times = len(words), Counter(words)
    if not n:
        return {"words": 0.0}, times
    pairs = sum(map(str.__eq__, words, words[1:]))
    marked = bare = upper = digits = letters = once = 0
    for w, c in times.items():
        letters += len(w) * c
        once += c == 1
        if w[0].isdigit():
            digits += c
        if not w[-1].isalnum():
            marked += c if len(w) > 2 and not w[-2].isalnum() else 0
            bare += c if not any(map(str.isalnum, w)) else 0
        if len(w) > 1 and w.isupper():
            upper += c
    return {
        "words": float(n),
        "letters": letters / n,
        "distinct": len(times) / n,
        "most": max(times.values()) / n,
        "pairs": pairs / n,
        "marked": marked / n,
        "bare": bare / n,
        "upper": upper / n,
        "digits": digits / n,
        "once": once / n,
    }, times


@dataclass(frozen=True)
class Labeller:
    """Votes junk at high or more of a measure, sound at low or less, and abstains between or under so many words."""

    measure: str
    low: float
    high: float
    words: int = 5

    def vote(self, m: dict[str, float]) -> int:
        if m["words"] < self.words:
            return ABSTAIN
        x = m[self.measure]
        return 1 if x >= self.high else 0 if x <= self.low else ABSTAIN


@dataclass(frozen=True)
class Below(Labeller):
    """The same the other way round: junk at low or less, sound at high or more."""

    def vote(self, m: dict[str, float]) -> int:
        v = super().vote(m)
        return v if v == ABSTAIN else 1 - v


LABELLERS = (
    Labeller("pairs", 0.05, 0.2),
    Labeller("most", 0.15, 0.4, 12),
    Labeller("marked", 0.02, 0.2),
    Labeller("bare", 0.02, 0.2),
    Labeller("upper", 0.05, 0.3),
    Below("distinct", 0.2, 0.35, 60),
    Below("once", 0.02, 0.2, 30),
)


@cache
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


#: Character classes by byte: lower case, capital, digit, blank, other white space, other ASCII, beyond ASCII.
CLASSES = np.array([3 if b == 32 else 4 if 9 <= b <= 13 else 2 if chr(b).isdigit() else 1 if chr(b).isupper() else 0 if chr(b).isalpha() else 5 for b in range(128)] + [6] * 128)
TRIPLES = np.array([zlib.crc32(f"classes:{k}".encode()) % BUCKETS for k in range(7**3)])


def features(text: str, m: dict[str, float], times: Counter) -> np.ndarray:
    """Hashed features: each measure in steps, shares of words, and shares of triples of character classes."""
    out = np.zeros(BUCKETS)

    def add(name: str, value: float) -> None:
        out[_bucket(name)] += value

    add("bias", 1.0)
    add("words:" + str(min(8, int(np.log2(m["words"] + 1)))), 0.2)
    if m["words"]:
        for name in ("distinct", "most", "pairs", "marked", "bare", "upper", "digits", "once"):
            add(name, m[name])
            add(f"{name}:{int(min(m[name], 0.999) * 10)}", 0.5)
            if m["words"] < 60:
                add(f"short:{name}", m[name])
        add(f"letters:{min(15, int(m['letters']))}", 0.3)
        n = 2 * m["words"]
        at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in times), np.int64, len(times)) % BUCKETS
        np.add.at(out, at, np.fromiter(times.values(), np.float64, len(times)) / n)
        c = CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        if len(c) > 2:
            np.add.at(out, TRIPLES, np.bincount((c[:-2] * 7 + c[1:-1]) * 7 + c[2:], minlength=7**3) / (len(c) - 2))
    return out


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, rate[labeller, class]: how often a labeller that votes says junk on it); class 0 is sound, the others are kinds of junk.

    Expectation-maximisation over vote patterns, an abstention telling nothing, from "a kind for each labeller, junk where it
    says so". Nothing bounds the rates. Votes alone can't tell a kind that one labeller sees from errors of that labeller on sound
    documents, as either explains them equally well; so the sound class has a prior, as heavy as a tenth of all documents, of
    one wrong vote in a thousand. Without votes the result is the starting point.
    """
    k = len(LABELLERS)
    share, rate = np.r_[0.9, np.full(k, 0.1 / k)], np.full((k, k + 1), 0.5)
    if not counts:
        return share, rate
    patterns = np.array(list(counts), np.int64)
    n = np.array(list(counts.values()), np.float64)
    says = patterns == 1
    post = np.c_[np.where(says.any(axis=1), 0.05, 0.95), says / np.maximum(says.sum(axis=1), 1)[:, None]]
    post /= post.sum(axis=1, keepdims=True)
    weight = np.r_[1 + 0.1 * n.sum(), np.ones(k)]
    prior = weight * np.c_[np.full(k, 0.001), np.where(np.eye(k, dtype=bool), 0.98, 0.02)]
    for _ in range(rounds):
        w = post * n[:, None]
        share = (w.sum(axis=0) + 10 * np.r_[0.9, np.full(k, 0.1 / k)]) / (n.sum() + 10)
        junk, sound = says.T @ w, (patterns == 0).T @ w
        rate = (junk + prior) / (junk + sound + weight)
        new = classes(patterns, share, rate)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, rate


def classes(patterns: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The probability of each class for each vote pattern."""
    z = np.log(share) + (patterns == 1) @ np.log(rate) + (patterns == 0) @ np.log(1 - rate)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The probability of junk of any kind for each vote pattern."""
    return 1 - classes(patterns, share, rate)[:, 0]


def accuracies(share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """(how often a voting labeller says junk on junk, on sound documents), by labeller."""
    junk = share[1:] / share[1:].sum()
    return np.c_[rate[:, 1:] @ junk, rate[:, 0]]


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 300, shrink: float = 1e-5) -> np.ndarray:
    """Logistic regression on hashed features with soft targets; gradient descent with momentum, a little shrinkage."""
    x, target = np.ascontiguousarray(x, np.float32), target.astype(np.float32)
    w, speed = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        speed = np.float32(0.9) * speed - np.float32(2) * ((p - target) @ x / np.float32(len(x)) + np.float32(shrink) * w)
        w = w + speed
    return w.astype(np.float64)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = []
        for t in batch["text"]:
            m = measures((t.as_py() or "").split())[0]
            votes.append([x.vote(m) for x in LABELLERS])
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(votes, pa.list_(pa.int32()))], ["id", "votes"])


def _pictured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(votes, at, value) of each text: the features that aren't 0, as little-endian unsigned 16-bit places and 32-bit floats."""
    for batch in batches:
        votes, places, values = [], [], []
        for t in batch["text"].to_pylist():
            m, times = measures(t.split())
            f = features(t, m, times)
            at = np.flatnonzero(f)
            votes.append([x.vote(m) for x in LABELLERS])
            places.append(at.astype("<u2").tobytes())
            values.append(f[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["votes", "at", "value"])


def junk_of(text: str, weights: np.ndarray) -> tuple[float, list[int]]:
    """(probability of junk, votes) of a text."""
    m, times = measures(text.split())
    z = float(weights @ features(text, m, times))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))), [x.vote(m) for x in LABELLERS]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000) -> np.ndarray:
    """The weights of the linear scorer."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = saved(rows.mapInArrow(_voted, "id long, votes array<int>").groupBy("votes").agg(F.count("*").alias("n")), f"{folder(docs.sparkSession)}/votes")
    counts = {tuple(r["votes"]): r["n"] for r in seen.collect()}  # at most 3 ** labellers rows
    share, rate = estimate(counts)
    part = min(1.0, 0.8 * sample / max(1, sum(counts.values())))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20)).limit(sample)
    found = picked.mapInArrow(_pictured, "votes array<int>, at binary, value binary").collect()  # sample rows of BUCKETS numbers at most
    votes = np.array([r["votes"] for r in found], np.int64).reshape(-1, len(LABELLERS))
    x = np.zeros((len(found), BUCKETS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return fit_linear(x, posterior(votes, share, rate))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000, reject: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, junk (probability), votes, kept (junk < reject).

    sample bounds the documents that the linear scorer is fitted on; the labellers' rates come from all documents.
    Null texts count as empty; empty texts and texts of few words get no votes against them. Repeated rows get equal
    results; empty tables give empty ones; other columns are ignored.
    """
    weights = train(docs, id_col=id_col, text_col=text_col, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [junk_of(t.as_py() or "", weights) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([p for p, _ in found], pa.float64()), pa.array([v for _, v in found], pa.list_(pa.int32()))], ["id", "junk", "votes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, junk double, votes array<int>")
    return scored.withColumnRenamed("id", id_col).withColumn("kept", F.col("junk") < reject)


def sound(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000, reject: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, that the classifier doesn't reject, each judged where it is.

    Null texts count as empty and stay; repeated rows have the same verdict; empty tables give empty results.
    """
    weights = train(docs, id_col=id_col, text_col=text_col, sample=sample)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([junk_of(t or "", weights)[0] < reject for t in texts], dtype=bool)

    return docs.where(kept(F.col(text_col)))
