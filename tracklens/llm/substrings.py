"""Substring dedup: windows of `n` words that also start in a document with a smaller doc_id go.

Pass 1, the count-min prefilter. Every window has an anchor: of its `GRAM`-word runs the one with the smallest
hash, which depends on the window's words alone. About one word in sixteen starts an anchor, so sketches over
anchors stay small, and an anchor's count is never below that of any of its windows. Each batch of documents
counts its distinct anchors (one, or two and more: all that is asked is "more than one document?") and deals
these partial counts by hash to sketch shards. A shard adds them up in a count-min sketch with cells that
saturate at two and is probed where it lives. The number of shards follows the size of the corpus, so that a
shard's memory and the work a byte of text do not depend on it; an anchor that a third of all documents have
reaches its shard once a batch.
Pass 2 reads the documents that have anchors estimated to occur twice and groups the windows of these anchors
exactly, by two polynomials over two independent 64-bit word hashes: of equal windows in one batch only those of
the smallest doc_id travel on, the others are known to go; the smallest doc_id of each group is combined before
the shuffle and joined back. No repeated window is lost, since no estimate falls short.

Defined cases: null texts have no words and lose none; equal rows and rows with equal doc_id never remove
each other's words (no doc_id is smaller), and rows with equal doc_id but other texts are told apart by them;
a null doc_id is neither smaller nor larger than any, so such rows keep all words and remove none;
documents shorter than a window keep all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, WORD_HASH, Scratch, map_batches, texts
from .native import bloom, bloom_blocks, possible_hits

N, GRAM = 50, 20
#: Rows of a sketch, cells an anchor in each, and anchors that a shard holds on average.
ROWS, CELLS_PER_ANCHOR, SHARD_ANCHORS = 3, 8, 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _power(p: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(p), k, 1 << 64))


def _runs(ids: np.ndarray, n: int, p: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of n ids, by doubling."""
    total = len(ids) - n + 1
    if total <= 0:
        return ids[:0]
    out, done, block, size = None, 0, ids, 1
    for bit in range(n.bit_length()):
        if n >> bit & 1:  # this block comes next in the run
            part = block[done : done + total]
            out = part.copy() if out is None else out * _power(p, size) + part
            done += size
        if n >> (bit + 1):
            block = block[:-size] * _power(p, size) + block[size:]
            size *= 2
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size, block = 1, h
    while 2 * size <= w:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return block if size == w else np.minimum(block[: len(h) - w + 1], block[w - size : w - size + len(h) - w + 1])


def _word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


class _SecondHash(dict):
    """Another 64-bit hash of each word, independent of WORD_HASH."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, seed=0x5EED)
        return value


_SECOND = _SecondHash()


def _anchors(ids: np.ndarray, n: int, gram: int) -> np.ndarray:
    """The anchor of each window."""
    return _sliding_min(_mix(_runs(ids, gram, _P)), n - gram + 1)


def _cells(anchors: np.ndarray, log_cells: int) -> list[np.ndarray]:
    return [(anchors * np.uint64(c)) >> np.uint64(64 - log_cells) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03)[:ROWS]]


class Sketch:
    """Count-min cells that saturate at two, as two bit vectors a row: seen, seen again."""

    def __init__(self, log_cells: int):
        self.log_cells = log_cells
        self.bits = np.zeros((ROWS, 2, 1 << max(0, log_cells - 3)), np.uint8)

    def add(self, anchors: np.ndarray) -> None:
        """Counts each entry once."""
        for row, cells in zip(self.bits, _cells(anchors, self.log_cells), strict=True):
            cells = np.sort(cells)
            twice = np.zeros(len(cells), bool)
            twice[1:] = cells[1:] == cells[:-1]
            at, bit = (cells >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8)
            twice |= row[0][at] & bit != 0
            np.bitwise_or.at(row[1], at[twice], bit[twice])
            np.bitwise_or.at(row[0], at, bit)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """Whether each entry's estimate is two or more."""
        out = np.ones(len(anchors), bool)
        for row, cells in zip(self.bits, _cells(anchors, self.log_cells), strict=True):
            out &= row[1][(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0
        return out


def partial_counts(anchors: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries whose anchor one document of the batch has, entries of the other anchors, these anchors), from pairs of anchor and document."""
    order = np.argsort(anchors, kind="stable")
    a = anchors[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return order[alone], order[~alone], a[first & ~alone]


def merged_repeats(single: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """One shard: which of the single entries the sums of all partial counts estimate at two or more."""
    sketch = Sketch(max(10, (CELLS_PER_ANCHOR * (len(single) + len(twice))).bit_length()))
    for part in (single, twice, twice):
        sketch.add(part)
    return sketch.repeated(single)


_COUNTS = "shard int, single binary, doc binary, crc binary, twice binary, known binary, known_doc binary, known_crc binary"
_COUNT_ARROW = pa.schema([("shard", pa.int32()), *((k, pa.binary()) for k in ("single", "doc", "crc", "twice", "known", "known_doc", "known_crc"))])


def repeated_anchors(docs: DataFrame, n: int, gram: int, shard_anchors: int) -> DataFrame:
    """doc_id, crc (of the text), anchor: the anchors of each document that are estimated to occur in another one."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, n_bytes // 6 * 2 // (n - gram + 2) // shard_anchors)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, crcs = [], [], []
            for text in batch.column(1):
                t = text.as_py()
                ids = _word_ids(t.split())
                found.append(np.unique(_anchors(ids, n, gram)) if len(ids) >= n else ids[:0])
                size.append(len(found[-1]))
                crcs.append(zlib.crc32(t) if size[-1] else 0)
            if not sum(size):
                continue
            anchors = np.concatenate(found)
            doc = np.repeat(batch.column(0).to_numpy(), size)
            crc = np.repeat(np.array(crcs, np.uint32), size)
            alone, known, twice = partial_counts(anchors, doc)
            shard = lambda a: ((a * _Q) >> np.uint64(33)) % np.uint64(n_shards)
            own, other, others = shard(anchors[alone]), shard(anchors[known]), shard(twice)
            rows = []
            order = [np.argsort(x, kind="stable") for x in (own, other, others)]
            present = np.unique(np.concatenate([own, other]))
            cut = [(np.searchsorted(x[o], present), np.searchsorted(x[o], present, "right")) for x, o in zip((own, other, others), order, strict=True)]
            for k, s in enumerate(present.tolist()):
                i, j, m = (o[c[0][k] : c[1][k]] for o, c in zip(order, cut, strict=True))
                i, j = alone[i], known[j]
                rows.append({"shard": s, "single": anchors[i].tobytes(), "doc": doc[i].tobytes(), "crc": crc[i].tobytes(), "twice": twice[m].tobytes(), "known": anchors[j].tobytes(), "known_doc": doc[j].tobytes(), "known_crc": crc[j].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_COUNT_ARROW)

    found_schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int32()), ("anchor", pa.int64())])

    def probe(group: pa.Table) -> pa.Table:
        flat = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in group[c].to_pylist()])
        single = flat("single", np.uint64)
        on = merged_repeats(single, flat("twice", np.uint64))
        anchors = np.concatenate([single[on], flat("known", np.uint64)])
        ids = np.concatenate([flat("doc", np.int64)[on], flat("known_doc", np.int64)])
        crcs = np.concatenate([flat("crc", np.int32)[on], flat("known_crc", np.int32)])
        return pa.table({"doc_id": ids, "crc": crcs, "anchor": anchors.view(np.int64)}, schema=found_schema)

    parts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, _COUNTS)
    return parts.groupBy("shard").applyInArrow(probe, "doc_id long, crc int, anchor long")


def _crc(text: Column) -> Column:
    c = F.crc32(text.cast("binary"))
    return F.when(c < 1 << 31, c).otherwise(c - (1 << 32)).cast("int")


def repeated_windows(docs: DataFrame, scratch: Scratch, n: int = N, gram: int = GRAM, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """doc_id, crc (of the text: it tells apart rows with equal doc_id), at: the windows that also start in a document with a smaller doc_id."""
    d = texts(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * n - 1))
    hits = repeated_anchors(d, n, gram, shard_anchors).groupBy("doc_id", "crc").agg(F.collect_list("anchor").alias("anchors"))  # fewer than the document has words
    hits = scratch.table(hits, "anchors")
    scratch.free()
    found = scratch.table(_candidates(_likely(d, hits, "doc_id").where("_maybe").drop("_maybe"), hits, n, gram), "windows")
    scratch.free()
    open_ = found.where("h1 IS NOT NULL")
    first = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    # written, so that the join reads an exchange on either side and can be split where a window is in many batches
    first = scratch.table(first, "first")
    scratch.free()
    # most windows of repeated anchors are in one document only: a Bloom filter keeps them out of the shuffle
    n_blocks = bloom_blocks(first.count())
    met = possible_hits(open_, "h1", bloom(first, "g1", n_blocks), n_blocks).where("_maybe").drop("_maybe")
    gone = met.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("doc_id") > F.col("first")))
    return gone.select("doc_id", "crc", "at").unionByName(found.where("h1 IS NULL").select("doc_id", "crc", "at"))


def _likely(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs with _maybe: false for documents whose doc_id is surely not among ids (a stored table)."""
    keys = ids.select(F.col(key).alias("doc_id")).distinct()
    n_blocks = bloom_blocks(keys.count())
    return possible_hits(docs, "doc_id", bloom(keys, "doc_id", n_blocks), n_blocks)


def _candidates(docs: DataFrame, hits: DataFrame, n: int, gram: int) -> DataFrame:
    """The windows whose anchor is estimated to occur in two documents, with their fingerprints.

    A window that a document with a smaller doc_id has in the same batch is known to go: h1 and h2 are null.
    """
    own = docs.withColumn("_crc", _crc(F.col("text")))
    joined = own.join(hits.select(F.col("doc_id").alias("_doc"), F.col("crc").alias("_c"), "anchors"), (F.col("doc_id") == F.col("_doc")) & (F.col("_crc") == F.col("_c")))

    def look(doc_id: list, text: list, crc: list, anchors: list) -> dict[str, object]:
        h1, h2, ids_, crcs, place = ([np.zeros(0, k)] for k in (np.uint64, np.uint64, np.int64, np.int32, np.int32))
        for i in sorted(range(len(doc_id)), key=doc_id.__getitem__):
            words = text[i].split()
            ids = _word_ids(words)
            at = np.flatnonzero(np.isin(_anchors(ids, n, gram), np.array(anchors[i], np.int64).view(np.uint64)))
            second = np.fromiter(map(_SECOND.__getitem__, words), np.uint64, len(words))
            h1.append(_runs(ids, n, _P)[at])
            h2.append(_runs(second, n, _Q)[at])
            ids_.append(np.full(len(at), doc_id[i], np.int64))
            crcs.append(np.full(len(at), crc[i], np.int32))
            place.append(at.astype(np.int32))
        h1, h2, ids_, crcs, place = map(np.concatenate, (h1, h2, ids_, crcs, place))
        known = known_later(h1, h2, ids_)
        return {"doc_id": pa.array(ids_), "crc": pa.array(crcs), "at": pa.array(place), "h1": pa.array(h1.view(np.int64), mask=known), "h2": pa.array(h2.view(np.int64), mask=known)}

    return map_batches(joined.select("doc_id", F.col("text").cast("binary").alias("text"), "_crc", "anchors"), look, "doc_id long, crc int, at int, h1 long, h2 long")


def known_later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows a smaller doc has as well, of windows in ascending order of doc."""
    order = np.argsort(h1, kind="stable")
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = d > d[start]
    return out


def dedup(docs: DataFrame, n: int = N, keep: list[str] | None = None, verbatim: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space), and the columns in `keep`.

    Documents that lose words are shuffled to meet the places of their windows, others stay where they are.
    verbatim: a text that loses nothing stays as it is, white space included.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    windows = repeated_windows(docs, scratch, n, **options)
    # the starts of a document's windows, one integer each: never more than its text has words
    found = scratch.table(windows.groupBy(F.col("doc_id").alias("_doc"), F.col("crc").alias("_c")).agg(F.collect_set("at").alias("_places")), "places")
    scratch.free()
    extra = [F.col(c).alias(f"_keep_{c}") for c in keep or []]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    probed = _likely(own, found, "_doc").withColumn("_maybe", F.coalesce("_maybe", F.lit(False)))
    may = probed.where("_maybe").drop("_maybe").withColumn("_crc32", _crc(F.col("text")))
    joined = may.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("_crc32") == F.col("_c")), "left").drop("_crc32", "_doc", "_c")
    joined = joined.unionByName(probed.where("NOT _maybe").drop("_maybe").withColumn("_places", F.lit(None).cast("array<int>")))

    def cut(doc_id: list, text: list, places: list, *more: list) -> dict[str, list]:
        out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept")}
        for t, at in zip(text, places, strict=True):
            words = (t or b"").split()
            stay = words
            if at:
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.array(at)
                edge[starts] += 1
                np.subtract.at(edge, starts + n, 1)
                stay = [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not gone]
            kept = b" ".join(stay)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(stay))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append((t if verbatim and not at and t is not None else kept).decode("utf-8", "surrogatepass"))
        return {"doc_id": doc_id} | out | {f"_keep_{c}": m for c, m in zip(keep or [], more, strict=True)}

    kinds = dict(own.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + "".join(f", `_keep_{c}` {kinds[f'_keep_{c}']}" for c in keep or [])
    made = map_batches(joined.select("doc_id", F.col("text").cast("binary").alias("text"), "_places", *(f"_keep_{c}" for c in keep or [])), cut, schema)
    return made.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", *(F.col(f"_keep_{c}").alias(c) for c in keep or []))


def op5(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.h = f.h AND g.doc_id > f.first),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM hit GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (doc_id)),
w AS (SELECT doc_id, i, w[i] AS word FROM k, unnest(range(1, len(w) + 1)) AS r(i)),
s AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN (SELECT doc_id, unnest(places) AS i FROM gone) AS o USING (doc_id, i) GROUP BY w.doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN s USING (doc_id)
"""
