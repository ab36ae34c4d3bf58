"""License scan: a positional index of rare template words.

Two passes. The first counts in how many documents each template word occurs. From those counts every template
is indexed under its `ANCHORS` highest-IDF words, with all their offsets (a base phrase under all its words).
The second pass looks up each document's anchors from the highest IDF down and intersects their postings by
relative position: start = position - offset. A start survives if at least `AGREE` different anchors put the
template there (of a base phrase: all). Where it survives, words that hold `MIN_SHARE` of the template's IDF must
stand in their places, and the mandatory key phrases near the span.

Defined cases: a null text is empty; a document without any phrase has n_base 0, null places, empty labels
and score 0; anchors of equal IDF are taken by spelling; a template that fits at several starts gives a span for
each; rows with equal doc_id are scanned one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, alnum_words, map_batches, texts
from .license_texts import REFERENCES, WHOLE

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> (template words in order, mandatory key phrases, each within `SLACK` words of the template's span).
TEMPLATES = REFERENCES | WHOLE
#: Rare words that index a template and how many of them must agree on a start; least share of a template's IDF
#: that must stand in place; words around the span for key phrases.
ANCHORS, AGREE, MIN_SHARE, SLACK = 6, 2, 0.5, 3

_split = lambda s: tuple(alnum_words(s))
VOCABULARY = sorted({w for t, keys in TEMPLATES.values() for s in (t, *keys) for w in _split(s)} | {w for s in BASE for w in _split(s)})


def document_frequency(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents with each template word. A task sends one row for each word it met."""
    vocabulary = frozenset(VOCABULARY)

    def count(text: list) -> dict[str, list]:
        met: dict[bytes, int] = {}
        for t in text:
            for w in vocabulary.intersection(t.translate(FOLD).split()) if t else ():
                met[w] = met.get(w, 0) + 1
        return {"word": [None, *(w.decode() for w in met)], "n": [len(text), *met.values()]}

    parts = map_batches(texts(docs).select(F.col("text").cast("binary").alias("text")), count, "word string, n long")
    got = {r.word: r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # as many rows as VOCABULARY has
    return got.pop(None, 0), {w.encode(): n for w, n in got.items()}


class Index:
    """Postings of each template's rarest words: template -> anchors from the highest IDF down, each with its offsets."""

    def __init__(self, n_docs: int, df: dict[bytes, int]):
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in VOCABULARY}
        self.templates = [(label, _split(t), tuple(map(_split, keys)), False) for label, (t, keys) in TEMPLATES.items()]
        self.templates += [(label, _split(t), (_split(t),), True) for t, label in BASE.items()]
        self.postings: list[dict[bytes, list[int]]] = []
        for _, words, _, base in self.templates:
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))
            self.postings.append({w: [i for i, x in enumerate(words) if x == w] for w in (rare if base else rare[:ANCHORS])})
        self.needs = [len(p) if t[3] else min(AGREE, len(p)) for p, t in zip(self.postings, self.templates, strict=True)]
        self.total = [sum(self.idf[w] for w in t[1]) for t in self.templates]
        self.anchors = frozenset(w for p in self.postings for w in p)

    def starts(self, k: int, places: dict[bytes, list[int]]) -> list[int]:
        """The starts on which enough anchors of template k agree, by intersecting their postings from the rarest on."""
        agree: dict[int, int] = {}
        lists = [(w, offsets) for w, offsets in self.postings[k].items() if w in places]
        for n, (w, offsets) in enumerate(lists):
            here = {p - o for p in places[w] for o in offsets}
            if n + self.needs[k] <= len(lists):  # a start that begins here can still gather enough
                for s in here:
                    agree[s] = agree.get(s, 0) + 1
            else:
                agree = {s: c + (s in here) for s, c in agree.items() if c + len(lists) - n >= self.needs[k]}
        return sorted(s for s, c in agree.items() if c >= self.needs[k])

    def scan(self, text: bytes | None) -> tuple:
        if not text:
            return 0, 0, None, None, "", "", 0.0, []
        words = text.translate(FOLD).split()
        here = self.anchors.intersection(words)
        likely = [k for k, p in enumerate(self.postings) if len(here.intersection(p)) >= self.needs[k]]
        if not likely:
            return len(words), 0, None, None, "", "", 0.0, []
        wanted, places = {w for k in likely for w in self.postings[k]}, {}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        base_places: list[int] = []
        base, labels, spans, score = set(), set(), [], 0.0
        for k in likely:
            label, template, keys, is_base = self.templates[k]
            for s in self.starts(k, places):
                share = sum(self.idf[w] for j, w in enumerate(template) if 0 <= s + j < len(words) and words[s + j] == w) / self.total[k]
                if is_base:
                    if s < 0 or tuple(words[s : s + len(template)]) != template:
                        continue
                    base_places.append(s)
                    base.add(label)
                elif share < MIN_SHARE or not self._has_keys(words, s, len(template), keys):
                    continue
                labels.add(label)
                spans.append((label, max(0, s), min(len(words), s + len(template))))
                score = max(score, min(1.0, share))
        return len(words), len(base_places), min(base_places, default=None), max(base_places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    @staticmethod
    def _has_keys(words: list[bytes], start: int, length: int, keys: tuple[tuple[bytes, ...], ...]) -> bool:
        around = words[max(0, start - SLACK) : max(0, start + length + SLACK)]
        return all(any(tuple(around[j : j + len(key)]) == key for j in range(len(around) - len(key) + 1)) for key in keys)


FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the FIELDS, spans as array of (label, first word, end word)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Index(*document_frequency(docs)))  # a few dozen words

    def look(doc_id: list, text: list) -> dict[str, list]:
        rows = [shared.value.scan(t) for t in text]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
        out = {"doc_id": doc_id} | {f: list(c) for f, c in zip(FIELDS, cols, strict=True)}
        out["spans"] = [[{"label": a, "start": b, "end": c} for a, b, c in s] for s in out["spans"]]
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    return map_batches(texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")), look, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def base_columns(spark, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: Of base_columns().
BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
h AS (SELECT doc_id, i - 1 AS place, label FROM d, unnest(range(1, len(w) + 1)) AS r(i), p WHERE w[i:i + len(phrase) - 1] = phrase AND w[i] = phrase[1]),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN g USING (doc_id)
"""


__all__ = ["BASE_SQL", "Index", "base_columns", "document_frequency", "op3", "scan"]
