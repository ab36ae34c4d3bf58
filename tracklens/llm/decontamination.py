"""Benchmark decontamination by a distributed positional inverted index. JVM only.

A window is `n` consecutive words of a benchmark item (an item of fewer words is one window). How often each
benchmark word occurs in the corpus gives every window its `RARE` rarest terms. The stored index holds the
postings of those terms: document, term, position. The lists of a window's terms are shifted by the terms'
offsets and intersected: a start survives where all of them agree (exact phrases), or a place where they lie
within `len + slop` words of each other (proximity). Only documents with such candidates are read again, to verify
all the window's words: in their places, or, for proximity, as often as the window has them within `len + slop`
consecutive words. Corpus words meet the terms in a hash join, broadcast while their measured number allows.

Defined cases: null texts have no words; a document without words has no hit; repeated item texts count as
items of their own; of equally rare terms the first by spelling is taken; rows with equal doc_id are told apart by
their texts, and equal rows get equal results; items with a null item_id hit but are not listed; other columns
are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .native import BROADCAST_BYTES, alnum_words, bind, bloom, bloom_blocks, possible_hits, small

N = 10
#: Rarest terms of a window whose postings are intersected (fewer where the window has fewer different words).
RARE = 2
KEY = ["doc_id", "doc_hash"]


def windows(bench: DataFrame, n: int = N) -> DataFrame:
    """item, at (first word), len, words: the distinct windows of all items."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))
    return items.select("item", "w", F.explode(starts).alias("at")).select("item", "at", F.slice("w", F.col("at") + 1, n).alias("words")).withColumn("len", F.size("words"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, n: occurrences in the corpus, combined before the shuffle. Terms that do not occur have n 0."""
    found = docs.select(F.explode(alnum_words(F.col("text"))).alias("word")).join(small(terms, n_terms, 64), F.col("word") == F.col("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(win: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows with `rare`: their rarest terms, each with its first offset."""
    each = win.select("item", "at", "words", "len", F.posexplode("words").alias("off", "term"))
    terms = each.groupBy("item", "at", "words", "len", "term").agg(F.min("off").alias("off")).join(counts, "term")
    ranked = terms.groupBy("item", "at", "words", "len").agg(F.array_sort(F.collect_list(F.struct("n", "term", "off"))).alias("r"))  # n entries at most
    return ranked.select(F.xxhash64("item", "at").alias("win"), "item", "at", "words", "len", F.slice("r", 1, RARE).alias("rare"))


def index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """doc_id, doc_hash, n_words, term, pos: a row for each posting of the terms, and one without term for each document."""
    words = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), alnum_words(F.col("text")).alias("w"))
    # place 0 stands for the document itself, so that one pass gives its postings and its size
    places = words.select("doc_id", "doc_hash", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    known = F.broadcast(terms) if fits(n_terms) else terms
    found = places.join(known, F.col("word") == F.col("term"), "left").where("term IS NOT NULL OR pos = 0")
    return found.select("doc_id", "doc_hash", "n_words", "term", (F.col("pos") - 1).alias("pos"))


def fits(n_terms: int) -> bool:
    return n_terms * 64 <= BROADCAST_BYTES


def candidates(posting: DataFrame, win: DataFrame, n_windows: int, slop: int | None) -> DataFrame:
    """doc_id, doc_hash, win, start: where the shifted lists of a window's rare terms meet."""
    rare = win.select("win", "len", F.size("rare").alias("n_rare"), F.posexplode("rare").alias("k", "r"))
    rare = rare.select("win", "len", "n_rare", "k", F.col("r.term").alias("_term"), F.col("r.off").alias("off"))
    lists = posting.join(small(rare, RARE * n_windows, 64), F.col("term") == F.col("_term"))
    if slop is None:
        met = lists.groupBy(*KEY, "win", (F.col("pos") - F.col("off")).alias("start"), "n_rare").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("met"))
        return met.where("met = (1 << n_rare) - 1").select(*KEY, "win", "start")
    # proximity: the rarest term's place, and the other's within reach
    first = lists.where("k = 0").select(*KEY, "win", "len", "n_rare", F.col("pos").alias("start"))
    other = lists.where("k = 1").select(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h"), F.col("win").alias("_w"), F.col("pos").alias("_p"))
    near = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")) & (F.col("win") == F.col("_w")) & (F.abs(F.col("_p") - F.col("start")) < F.col("len") + slop)
    return first.join(other, near, "left").where("n_rare = 1 OR _p IS NOT NULL").select(*KEY, "win", "start").distinct()


def verified(docs: DataFrame, found: DataFrame, win: DataFrame, n_windows: int, slop: int | None) -> DataFrame:
    """doc_id, doc_hash, item, start, end of the candidates whose words are all there."""
    own = found.join(small(win.select("win", "item", "words", "len"), n_windows, 256), "win")
    per_doc = own.groupBy(*KEY).agg(F.collect_set(F.struct("start", "item", "words", "len")).alias("c")).select(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h"), "c")
    # a Bloom filter keeps texts without candidates out of the join
    hashes = found.select("doc_hash").distinct()
    n_blocks = bloom_blocks(hashes.count())
    d = docs.withColumn("doc_hash", F.xxhash64("text"))
    likely = possible_hits(d, "doc_hash", bloom(hashes, "doc_hash", n_blocks), n_blocks).where("_maybe").select(*KEY, "text").distinct()
    joined = likely.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")))

    def exact(w: Column) -> Column:
        held = F.filter("c", lambda c: (c["start"] >= 0) & (F.slice(w, F.greatest(c["start"], F.lit(0)) + 1, c["len"]) == c["words"]))
        return F.transform(held, lambda c: F.struct(c["item"].alias("item"), c["start"].cast("int").alias("start"), (c["start"] + c["len"]).cast("int").alias("end")))

    def near(w: Column) -> Column:
        size = lambda c: c["len"] + F.lit(slop)
        span = lambda c, s: F.slice(w, s + 1, size(c))
        times = lambda words, x: F.size(F.filter(words, lambda y: y == x))
        whole = lambda c, s: F.forall(F.array_distinct(c["words"]), lambda x: times(span(c, s), x) >= times(c["words"], x))
        starts = lambda c: F.sequence(F.greatest(F.lit(0), c["start"] - size(c) + 1), c["start"])
        first = F.transform("c", lambda c: F.struct(c["item"].alias("item"), F.array_min(F.filter(starts(c), lambda s: whole(c, s))).cast("int").alias("start"), size(c).alias("n")))
        return F.transform(F.filter(first, lambda c: c["start"].isNotNull()), lambda c: F.struct(c["item"].alias("item"), c["start"].alias("start"), F.least(c["start"] + c["n"], F.size(w)).cast("int").alias("end")))

    hits = joined.select(*KEY, bind(alnum_words(F.col("text")), exact if slop is None else near).alias("hits"))
    return hits.select(*KEY, F.inline("hits")).distinct()


def matches(docs: DataFrame, bench: DataFrame, n: int = N, slop: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents with n_words, exact hits, proximity hits if slop is given): hits are doc_id, doc_hash, item, start, end."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    win = scratch.table(windows(bench, n), "windows")
    terms = scratch.table(win.select(F.explode("words").alias("term")).distinct(), "terms")
    win = scratch.table(anchored(win, term_counts(d, terms, terms.count())), "anchored")
    n_windows = win.count()
    rare = win.select(F.explode("rare.term").alias("term")).distinct()
    stored = scratch.table(index(d, rare, rare.count()), "index")
    base, posting = stored.where("term IS NULL").select(*KEY, "n_words"), stored.where("term IS NOT NULL")
    found = scratch.table(candidates(posting, win, n_windows, None), "candidates")
    near = None
    if slop is not None:
        near = verified(d, scratch.table(candidates(posting, win, n_windows, slop), "near"), win, n_windows, slop)
    return base, verified(d, found, win, n_windows, None), near


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, slop: int | None = None) -> DataFrame:
    """doc_id, doc_hash, n_words, n_hit, n_items, items_sha256, contaminated, items; with slop also n_near and near_items.

    n_near: spans of `len + slop` words that hold all words of a window in any order; exact hits are among them.
    """
    base, hits, near = matches(docs, bench, n, slop)
    spans = hits.groupBy(*KEY, "start", "end").agg(F.collect_set("item").alias("items"))
    before = F.max("end").over(Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    per_doc = new.groupBy(*KEY).agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def with_doc(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("doc_id", "_i").withColumnRenamed("doc_hash", "_h")
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")), "left").drop("_i", "_h")

    all_ = with_doc(base, per_doc)
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    out = [*KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items.alias("items")]
    if near is not None:
        spots = near.groupBy(*KEY).agg(F.countDistinct("start", "end").alias("n_near"), F.array_sort(F.collect_set("item")).alias("near_items"))
        all_ = with_doc(all_, spots)
        out += [F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("near_items", none).alias("near_items")]
    return all_.select(*out)


def op7(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS words, len(w[i:i + 9]) AS n FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS words FROM low, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.words = win.words AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS o(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
