"""Quality rules: a ledger of failure bits and measurements, evaluated once, read by many policies.

ledger() measures every document and sets one bit for each rule it fails. Policies are versioned masks
over those bits: verdicts(), ablation() and co_failures() never read a text again.

Defined cases: a null or blank text has no words (all measures 0, so it fails `few_words`); rows with equal
doc_id are judged one by one; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASH, map_batches, texts

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper_words long, n_lines long"

#: Rule by bit: name and failure condition over the measurements. Bits are never reused: a changed rule gets a new one.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_5grams", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("symbols", lambda: 5 * F.col("n_symbols") > F.col("n_words")),
    ("repeated_lines", lambda: (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
    ("upper_case", lambda: (F.col("n_words") >= 10) & (5 * F.col("n_upper_words") > 2 * F.col("n_words"))),
    ("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    "v1": BIT["few_words"] | BIT["repeated_5grams"],
    "v2": BIT["few_words"] | BIT["repeated_5grams"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["upper_case"] | BIT["word_length"],
}
CURRENT = "v2"

_SYMBOLS = b"#*$%&|<>"
_NOT_POINTS = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])  # what a count of code points in words leaves out
_GRAM = 5


def repeated_word_counts(words: list[list[bytes]]) -> np.ndarray:
    """For each document: how many of its words lie in 5-word windows found twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    out = np.zeros(len(words), np.int64)
    if total < _GRAM:
        return out
    ids = np.fromiter((h for w in words for h in map(WORD_HASH.__getitem__, w)), np.uint64, total)
    doc = np.repeat(np.arange(len(words)), counts)
    h = ids[: total - _GRAM + 1].copy()
    for k in range(1, _GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += ids[k : total - _GRAM + 1 + k]
    start = np.flatnonzero(doc[: len(h)] == doc[_GRAM - 1 :])
    key = (h[start] ^ (h[start] >> np.uint64(31))) + doc[start].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(start), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int32)
    hit = start[again]
    np.add.at(edge, hit, 1)
    np.subtract.at(edge, hit + _GRAM, 1)
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(out, doc[covered], 1)
    return out


def _measure(doc_id: list, text: list) -> dict[str, list]:
    raw = [t or b"" for t in text]
    words = [t.split() for t in raw]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
    upper = []
    for t, w in zip(raw, words, strict=True):
        low = t.lower()
        upper.append(0 if low == t else sum(map(bytes.isupper, w)) if len(w) else 0)
    return {
        "doc_id": doc_id,
        "n_words": [len(w) for w in words],
        "word_chars": [len(t.translate(None, _NOT_POINTS)) for t in raw],
        "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) for t in raw],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": repeated_word_counts(words).tolist(),
        "n_upper_words": upper,
        "n_lines": [len(x) for x in lines],
    }


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: bit i is set where rule i fails."""
    d = texts(docs)
    measured = map_batches(d.select("doc_id", F.col("text").cast("binary").alias("text")), _measure, f"doc_id long, {MEASURES}")
    bits = F.lit(0).cast("int")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails(), 1 << i).otherwise(0))
    return measured.withColumn("failed", bits)


def verdicts(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with `kept` under one policy."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def patterns(led: DataFrame) -> DataFrame:
    """Documents by failure bits: at most 2^rules rows, combined before the shuffle."""
    return led.groupBy("failed").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, those that only it rejects, and what is kept without it."""
    mask, counts = POLICIES[version], patterns(led)
    rules = [(n, b) for n, b in BIT.items() if b & mask]
    found = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules))).alias("r"), "failed", "n_docs")
    fails = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("failed").bitwiseAND(F.lit(mask)).bitwiseAND(F.bitwise_not(F.col("r.bit")))
    one = lambda c, name: F.sum(F.when(c, F.col("n_docs")).otherwise(0)).alias(name)
    return found.groupBy(F.col("r.rule").alias("rule")).agg(one(fails, "n_failed"), one(fails & (rest == 0), "n_only"), one(rest == 0, "n_kept_without"))


def op4(spark, sf_dir: str) -> DataFrame:
    led = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["v1"])) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM k, unnest(range(0, 5)) AS o(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN n_words >= 10 AND 5 * n_upper_words > 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END) AS INTEGER) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
