"""Toxicity by nearest labelled examples: exact TF-IDF cosine through block-max postings of all terms of the examples.

fit() takes a bounded, hash-chosen sample of labelled rows (`MAX_EXAMPLES` of each class) and indexes every term
of them: the vocabulary is bounded by the sample. A term weighs its document frequency over all documents times
its relevance, a smooth function of the examples' chi-square that is never zero: no term is left out.

Examples with the same heaviest term stand side by side, in blocks of `BLOCK`. A text is searched on all terms that
any example has. Rare terms' postings are added up example by example; for frequent terms each block's greatest
weights bound what it can still gain. The blocks of greatest bound are scored first, then every other one whose
bound reaches the k-th best similarity; the rest is skipped, and the k nearest are exact.
Votes weighted by distance are calibrated on the examples themselves, each left out of its own vote, by
isotonic regression with the classes' true shares.

Terms are lower-cased runs of letters and their 4- and 5-letter beginnings (marked `~`), which carry inflected
and obfuscated forms. Scores use the text only: never labels, lang, source or doc_id.

Defined cases: null and empty texts, and texts without any term of the examples, have no neighbours and get the share of
toxic examples among such texts; without usable labels every score is 0.5 shrunk to the class share (0 if there
are none); a doc_id labelled twice counts as toxic if any label says so; rows with equal doc_id are scored one
by one; ties in similarity (of six digits) go to the smaller doc_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, split_words, spread, texts

#: Bound of the model: examples of each class. Neighbours that vote; examples in a block; blocks that are scored first.
MAX_EXAMPLES, K, BLOCK, FIRST = 2000, 15, 16, 4
#: Relevance of a term without any lean to a class, and the chi-square at which it is a quarter of the greatest.
FLOOR, HALF_CHI2 = 0.001, 20.0
#: So many of the most frequent terms have rows of weights with block maxima; the others have lists.
DENSE_TERMS = 1024
#: Text bytes of which the words are looked up at a time.
BATCH_BYTES = 8 << 20
#: A neighbour of similarity s votes with weight 1 / (DISTANCE - s).
DISTANCE = 1.05
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    """The evaluation fold."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0


def terms_of(word: str) -> list[str]:
    out, low = [], word.lower()
    for w in (low,) if low.isalpha() else _LETTERS.findall(low):
        out.append(w)
        out += [w[:k] + "~" for k in (4, 5) if len(w) > k]
    return out


class TermIds:
    """Ids of those terms that examples have, of many words at once."""

    #: Words in which Arrow and Python agree on letters and their lower case; of others terms_of() tells.
    PLAIN = r"^[\x01-\x{12F}\x{131}-\x{24F}]*$"

    def __init__(self, vocabulary: dict[str, int]):
        self.terms = pa.array(sorted(vocabulary, key=vocabulary.__getitem__), pa.string())

    def __len__(self) -> int:
        return len(self.terms)

    def of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term id)"""
        plain = pc.match_substring_regex(words, self.PLAIN)
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        odd = [(i, t) for i in other.tolist() for t in terms_of(words[i].as_py())]
        runs = pc.split_pattern_regex(pc.utf8_lower(words.filter(plain)), r"[^\pL\p{Nl}\p{No}]+")
        run, of, size = runs.flatten(), pc.list_parent_indices(runs), pc.utf8_length(runs.flatten())
        found, who = [run, pa.array([t for _, t in odd], pa.string())], [of.to_numpy(), np.array([i for i, _ in odd], np.int64)]
        who[0] = np.flatnonzero(plain.to_numpy(zero_copy_only=False))[who[0]]
        for k in (4, 5):
            more = pc.greater(size, k)
            found.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(run.filter(more), 0, k), "~", ""))
            who.append(who[0][more.to_numpy(zero_copy_only=False)])
        ids = pc.fill_null(pc.index_in(pa.concat_arrays(found), value_set=self.terms), -1).to_numpy()
        return np.concatenate(who)[ids >= 0], ids[ids >= 0]


def count_terms(ids: TermIds, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often) of all terms of the texts that examples have, by text and term; a word is looked up once."""
    of, which, words = split_words(text)
    word, term = ids.of(words)
    n, places = spread(np.bincount(word, minlength=len(words)), which)
    key, count = np.unique(np.repeat(of, n) * max(1, len(ids)) + term[np.argsort(word, kind="stable")][places], return_counts=True)
    return key // max(1, len(ids)), key % max(1, len(ids)), count


@dataclass
class Postings:
    """Weights of the examples by term, all of them, with block maxima of the frequent terms."""

    n: int  # examples
    place: np.ndarray  # example -> where it stands in its block order
    at: np.ndarray  # term -> its row in dense, -1: it has a list
    dense: np.ndarray  # frequent terms x places, in whole blocks
    bounds: np.ndarray  # frequent terms x blocks
    start: np.ndarray  # term -> where its list starts
    who: np.ndarray  # places
    weight: np.ndarray

    @classmethod
    def of(cls, n: int, n_terms: int, term: np.ndarray, who: np.ndarray, weight: np.ndarray) -> Postings:
        heaviest = np.zeros(n, np.int64)
        by_weight = np.argsort(weight, kind="stable")
        heaviest[who[by_weight]] = term[by_weight]
        place = np.empty(n, np.int64)
        place[np.argsort(heaviest, kind="stable")] = np.arange(n)
        who = place[who]
        n_blocks = -(-n // BLOCK)
        df = np.bincount(term, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        at = np.full(n_terms, -1, np.int32)
        at[often] = np.arange(len(often))
        dense = np.zeros((len(often), n_blocks * BLOCK), np.float32)
        is_dense = at[term] >= 0
        dense[at[term[is_dense]], who[is_dense]] = weight[is_dense]
        term, who, weight = term[~is_dense], who[~is_dense], weight[~is_dense]
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        return cls(n, place, at, dense, dense.reshape(len(often), n_blocks, BLOCK).max(2, initial=0), start, who[order].astype(np.int32), weight[order].astype(np.float32))

    def similarity(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: np.ndarray | None = None) -> np.ndarray:
        """Of each row (terms, weights) and each place, exact for the k nearest at least; -1 in skipped blocks and padding."""
        m, (n_dense, n_blocks) = len(rows), self.bounds.shape
        q = np.zeros((m, n_dense), np.float32)
        s = np.zeros((m, n_blocks * BLOCK), np.float64)
        for i, (t, w) in enumerate(rows):
            on = self.at[t] >= 0
            q[i, self.at[t[on]]] = w[on]
            t, w = t[~on], w[~on]
            n = self.start[t + 1] - self.start[t]
            where = np.repeat(self.start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            s[i] = np.bincount(self.who[where], self.weight[where] * np.repeat(w, n), s.shape[1])
        bound = q @ self.bounds + s.reshape(m, n_blocks, BLOCK).max(2) + 1e-5  # more than rounding can take away
        s[:, self.n :] = -1
        out = np.full_like(s, -1)
        todo = np.zeros((m, n_blocks), bool)
        first = min(n_blocks, max(FIRST, -(-(k + 1) // BLOCK)))
        np.put_along_axis(todo, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, 1)
        done = np.zeros_like(todo)
        for step in range(2):
            for b in np.flatnonzero(todo.any(0)):
                on, own = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                out[on, own] = q[on] @ self.dense[:, own] + s[on, own]
            done |= todo
            if step == 0:
                out[:, self.n :] = -1
                if leave_out is not None:
                    out[np.arange(m), self.place[leave_out]] = -1
                least = -np.partition(-out, k - 1, axis=1)[:, k - 1] if k <= out.shape[1] else np.full(m, -1.0)
                todo = (bound >= least[:, None]) & ~done
        self.scored = float(done.mean()) if m else 0.0
        out[:, self.n :] = -1
        if leave_out is not None:
            out[np.arange(m), self.place[leave_out]] = -1
        return out


@dataclass
class Model:
    idf: np.ndarray  # weight of each term
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    vectors: Postings  # of unit length
    knots: tuple[np.ndarray, np.ndarray]  # vote -> score
    empty: float  # score of texts without terms

    def weigh(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t, n in rows:
            w = (1 + np.log(n)) * self.idf[t]
            out.append((t, w / np.linalg.norm(w)))
        return out

    def closest(self, rows: list[tuple[np.ndarray, np.ndarray]], leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarity and number of the K nearest examples of weighed rows, -1 where there are fewer; every positive similarity counts, as 1e-6 at least."""
        n, k = len(self.ids), min(K, max(1, len(self.ids)))
        if not n:
            return np.full((len(rows), 1), -1.0), np.full((len(rows), 1), -1, np.int64)
        s = self.vectors.similarity(rows, k, leave_out)[:, self.vectors.place]
        s = np.where(s > 0, np.maximum(np.rint(s * 1e6), 1), -1).astype(np.int64)
        key = -s * n + np.arange(n)  # all different: ties go to the smaller example
        top = np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1)
        who = top % n
        best = np.take_along_axis(s, who, 1)
        return np.where(best > 0, best / 1e6, -1.0), np.where(best > 0, who, -1)

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        w = np.where(who >= 0, 1 / (DISTANCE - np.minimum(best, 1)), 0)
        total = w.sum(1)
        return np.where(total > 0, (w * self.toxic[np.maximum(who, 0)]).sum(1) / np.where(total > 0, total, 1), np.nan)

    def score(self, votes: np.ndarray) -> np.ndarray:
        s = np.interp(np.nan_to_num(votes), *self.knots)
        return np.clip(np.where(np.isnan(votes), self.empty, s), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit (pool adjacent violators), each pool smoothed by half a row of each class."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][2] == pools[-1][0] / pools[-1][2] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
    at = np.array([p[0] / p[2] for p in pools])
    value = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return at, np.maximum.accumulate(value)


def frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Documents with each term, and all documents: one pass over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start() -> TermIds:
        return TermIds(shared.value)

    def look(ids: TermIds, doc_id: list, text: pa.Array) -> dict[str, object]:
        n = np.bincount(count_terms(ids, text)[1], minlength=len(ids))
        on = np.flatnonzero(n)
        return {"term": pa.array(np.append(on, -1), pa.int32()), "n": pa.array(np.append(n[on], len(doc_id)))}

    got = map_batches(texts(docs), look, "term int, n long", init=start, most=BATCH_BYTES, arrow_text=True).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(vocabulary), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def relevance(a: np.ndarray, b: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Of terms in a toxic and b clean examples: from FLOOR to 1 + FLOOR, smooth in chi-square."""
    c, d = n_pos - a, n_neg - b
    chi2 = (n_pos + n_neg) * (a * d - b * c) ** 2.0 / np.maximum(1.0, (a + b) * (c + d) * float(n_pos) * n_neg)
    return FLOOR + (chi2 / (chi2 + HALF_CHI2)) ** 2


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model, dict[str, int]]:
    """The model and its vocabulary. labels: doc_id, toxic; only rows outside the evaluation fold are used."""
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    lab = lab.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [(r.doc_id, r.toxic) for c in (0, 1) for r in lab.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES).collect()]
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int")
    n_class = [sum(t == c for _, t in chosen) for c in (0, 1)]

    def find(doc_id: list, toxic: list, text: list) -> dict[str, list]:
        out = {"doc_id": doc_id, "toxic": toxic, "found": [], "counts": []}
        for t in text:
            n: dict[str, int] = {}
            for w, k in Counter(t.split()).items() if t else ():
                for x in terms_of(w):
                    n[x] = n.get(x, 0) + k
            out["found"].append(sorted(n))
            out["counts"].append([n[x] for x in out["found"][-1]])
        return out

    mine = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")  # 2 * MAX_EXAMPLES ids
    found = scratch.table(map_batches(mine, find, "doc_id long, toxic int, found array<string>, counts array<int>"), "examples")
    one = found.groupBy("doc_id").agg(F.min(F.struct("found", "counts", "toxic")).alias("e"))  # one row a doc_id
    rows = one.select("doc_id", "e.*").orderBy("doc_id").toArrow().combine_chunks()
    terms = rows["found"].combine_chunks().flatten().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
    vocabulary = {x: i for i, x in enumerate(terms.dictionary.to_pylist())}
    df, n_docs = frequencies(docs, vocabulary)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    return _model(idf, rows, terms.indices.to_numpy(), totals, n_class), vocabulary


def _model(idf: np.ndarray, rows: pa.Table, term: np.ndarray, totals: dict[int, int], n_class: list[int]) -> Model:
    """rows: doc_id, toxic, counts of each example, by doc_id; term: the ids of all their terms, one after the other."""
    toxic = rows["toxic"].to_numpy()
    size = np.array([len(c) for c in rows["counts"]], np.int64)
    weight = [totals.get(c, 0) / max(1, n_class[c]) for c in (0, 1)]
    none = [((size == 0) & (toxic == c)).sum() * weight[c] for c in (0, 1)]
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    empty = float((none[1] + share) / (sum(none) + 1))
    full = np.flatnonzero(size)
    m = Model(idf, rows["doc_id"].to_numpy()[full], toxic[full].astype(np.float32), Postings.of(0, len(idf), *(np.zeros(0, np.int64),) * 3), (np.array([0.0, 1.0]), np.array([0.0, 1.0])), empty)
    if len(full):
        who = np.repeat(np.arange(len(full)), size[full])
        count = rows["counts"].combine_chunks().flatten().to_numpy()
        a, b = (np.bincount(term[m.toxic[who] == c], minlength=len(idf)) for c in (1, 0))
        m.idf = idf * relevance(a, b, int((toxic == 1).sum()), int((toxic == 0).sum()))
        ends = np.cumsum(size[full])[:-1]
        vectors = m.weigh(list(zip(np.split(term, ends), np.split(count, ends), strict=True)))
        m.vectors = Postings.of(len(full), len(idf), term, who, np.concatenate([w for _, w in vectors]))
        vote = np.concatenate([m.votes(*m.closest(vectors[i : i + 256], np.arange(i, min(i + 256, len(full))))) for i in range(0, len(full), 256)])
        ok = ~np.isnan(vote)
        if ok.any():
            m.knots = isotonic(vote[ok], m.toxic[ok], np.where(m.toxic[ok] > 0, weight[1], weight[0]))
    return m


def scores(docs: DataFrame, model: Model, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest examples with similarity and label)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

    def start() -> TermIds:
        return TermIds(shared.value[1])

    def rate(words: TermIds, doc_id: list, text: pa.Array) -> dict[str, list]:
        m = shared.value[0]
        out = {"doc_id": doc_id, "score": [m.empty] * len(doc_id), "evidence": [[] for _ in doc_id]}
        of, term, count = count_terms(words, text)
        some, first = np.unique(of, return_index=True)
        counts = list(zip(some.tolist(), zip(np.split(term, first[1:]), np.split(count, first[1:]), strict=True), strict=True)) if len(some) else []
        for at in range(0, len(counts), 256):
            own = counts[at : at + 256]
            best, who = m.closest(m.weigh([n for _, n in own]))
            for (i, _), s, b, w in zip(own, m.score(m.votes(best, who)).tolist(), best.tolist(), who.tolist(), strict=True):
                out["score"][i] = round(s, 6)
                out["evidence"][i] = [{"doc_id": int(m.ids[e]), "similarity": x, "toxic": int(m.toxic[e])} for x, e in zip(b, w, strict=True) if e >= 0]
        return out

    made = map_batches(texts(docs), rate, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>", init=start, most=BATCH_BYTES, arrow_text=True)
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, *fit(docs, labels, Scratch(docs.sparkSession, "toxicity")))


def op1(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
