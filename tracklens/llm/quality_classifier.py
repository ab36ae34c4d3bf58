"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes fine (1), junk (-1) or abstains (0) on a document. EM over the counts of all vote patterns
(at most 3^labellers rows, whatever the corpus) estimates the class share and how often each labeller votes
what in each class; every pattern then has a posterior. A logistic scorer over hashed word shapes is trained on
the posteriors of a bounded, hash-chosen sample (`MAX_TRAIN` rows). No hand label is used.

Defined cases: a null or blank text scores 0 and is rejected; rows with equal doc_id are scored one by one, and
the smallest of their texts stands for them in the sample; rows without doc_id are scored and vote, but are not in
the sample; a score of exactly 0.5 is kept; a very long text is scored whole and comes to Python alone; other
columns are ignored by classify() and kept by scored(), which adds `_score`; an empty table gives no rows; without any
vote against a text the model keeps it.
"""

from __future__ import annotations

import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, map_batches, texts

MAX_TRAIN, DIMS, ROUNDS = 8000, 1024, 100
_SYMBOLS, _UPPER, _LETTERS = b"#*$%&<>^~=", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
#: Frequent function words of the corpus' languages.
FUNCTION_WORDS = frozenset("the of and to in is that it for on was as be with by a der die das und ist zu den von mit auf de la que el en los y las le les des et un une est il elle".encode().split())

LABELLERS = ["symbols", "upper_case", "word_runs", "bars", "exclaimed", "function_words", "line_copies", "few_word_kinds"]


def votes(text: bytes) -> list[int]:
    """One vote a labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] * len(LABELLERS)
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    runs = sum(map(operator.eq, words, words[1:]))
    function = sum(map(FUNCTION_WORDS.__contains__, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    rule = lambda x, junk, fine: -1 if x > junk else 1 if x <= fine else 0
    return [
        rule(symbols / n, 0.2, 0.02),
        rule(upper / max(1, letters), 0.3, 0.12),
        rule(runs / n, 0.1, 0.02),
        rule(text.count(b"|") / n, 0.1, 0.01),
        rule(text.count(b"!!") / n, 0.1, 0.0),
        0 if n < 20 else rule(-function / n, -0.04, -0.12),
        0 if len(lines) < 4 else rule(1 - len(set(lines)) / len(lines), 0.4, 0.1),
        0 if n < 50 else rule(-len(set(words)) / n ** 0.8, -0.6, -1.0),
    ]


def pattern(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def em(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of fine by pattern, P(vote | class) as labellers x classes x votes, share of fine), from pattern counts.

    An abstention says nothing about the class (short texts abstain more often), so it stays out of the likelihood.
    """
    k = len(LABELLERS)
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in keys.tolist()], float)
    v = keys[:, None] // 3 ** np.arange(k) % 3  # 0 junk, 1 abstains, 2 fine
    # start: junk where any two labellers, or a third of those that vote, say so
    against, for_ = (v == 0).sum(1), (v == 2).sum(1)
    fine = np.where((against >= 2) | (against * 2 > for_) & (against > 0), 0.1, 0.9)
    share, p = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        share = float((n @ fine + 1) / (n.sum() + 2))
        for c, w in enumerate((n * (1 - fine), n * fine)):
            for x in (0, 2):
                p[:, c, x] = ((v == x) * w[:, None]).sum(0) + 0.5
        p /= p[:, :, [0, 2]].sum(2, keepdims=True)
        p[:, :, 1] = 1
        like = [np.log(p[np.arange(k), c, v]).sum(1) + np.log(s) for c, s in ((0, 1 - share), (1, share))]
        fine = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return dict(zip(keys.tolist(), fine.tolist(), strict=True)), p, share


class Shapes(dict):
    """word -> hashed feature of its shape: runs of letters by case, digits as 0, other characters as they are."""

    _a, _b, _c = re.compile(r"[^\W\d_A-Z]*[^\W\d_A-Z]"), re.compile("[A-Z]+"), re.compile("[0-9]+")

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shape = self._c.sub("0", self._b.sub("A", self._a.sub("a", word.decode("utf-8", "replace"))))[:12]
        if word in FUNCTION_WORDS:
            shape = "function"
        value = self[word] = zlib.crc32(shape.encode()) % (DIMS - 8)
        return value


_shapes = Shapes()


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of word shapes, then runs of one word, word kinds, upper case, symbols, bars, copied lines, size, one."""
    x, words = np.zeros(DIMS, np.float32), text.split()
    n = len(words)
    if n:
        x[: DIMS - 8] = np.bincount(np.fromiter(map(_shapes.__getitem__, words), np.int64, n), minlength=DIMS - 8) / n
        lines = [t for t in text.split(b"\n") if t.strip()]
        letters = len(text) - len(text.translate(None, _LETTERS))
        x[DIMS - 8 :] = (
            sum(map(operator.eq, words, words[1:])) / n, max(0.0, 1 - len(set(words)) / n**0.8), (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
            min(1.0, (len(text) - len(text.translate(None, _SYMBOLS))) / n), min(1.0, text.count(b"|") / n), 1 - len(set(lines)) / len(lines), 1 / n, 0,
        )
        x = np.sqrt(x)
    x[-1] = 1
    return x


@dataclass
class Model:
    weights: np.ndarray
    vote_rates: np.ndarray
    share: float

    def score(self, text: bytes | None) -> float:
        if not text or not text.strip():
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(text) @ self.weights, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Adam on the regularised logistic loss with soft labels."""
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame) -> Model:
    """One pass for the votes of all documents, one for the features of the sample."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def vote(text: list) -> dict[str, list]:
        n: dict[int, int] = {}
        for t in text:
            if t and t.strip():
                p = pattern(votes(t))
                n[p] = n.get(p, 0) + 1
        return {"pattern": list(n), "n": list(n.values())}

    counts = {r.pattern: r.n for r in map_batches(d.select("text"), vote, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, rates, share = em(counts) if counts else ({}, np.zeros((len(LABELLERS), 2, 3)), 1.0)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids.collect()], "doc_id long").distinct()

    def example(text: list) -> dict[str, list]:
        full = [t for t in text if t and t.strip()]
        x = [features(t) for t in full]
        on = [np.flatnonzero(v) for v in x]  # most are zero
        return {"pattern": [pattern(votes(t)) for t in full], "at": [i.astype(np.uint16).tobytes() for i in on], "x": [v[i].tobytes() for v, i in zip(x, on, strict=True)]}

    # MAX_TRAIN ids and a row each (of equal doc_ids the smallest text), combined before the shuffle
    mine = d.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    rows = map_batches(mine, example, "pattern int, at binary, x binary").toArrow()
    w = np.zeros(DIMS, np.float32)
    w[-1] = 1  # without examples everything is kept
    if len(rows):
        x = np.zeros((len(rows), DIMS), np.float32)
        for own, at, value in zip(x, rows["at"], rows["x"], strict=True):
            own[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(value.as_py(), np.float32)
        w = logistic(x, np.array([posterior[p] for p in rows["pattern"].to_pylist()], np.float32))
    return Model(w, rates, share)


def score_column(spark, model: Model):
    """text -> score, as a column function: only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return score


def scored(docs: DataFrame) -> DataFrame:
    """The documents with `_score`."""
    spark = docs.sparkSession
    model = fit(docs)
    return docs.withColumn("_score", score_column(spark, model)(F.col("text").cast("string").cast("binary")))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: finer), kept (score >= 0.5)."""
    own = texts(docs)
    return scored(own).select("doc_id", F.round("_score", 6).alias("score"), (F.col("_score") >= 0.5).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
