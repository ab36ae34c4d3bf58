"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Word runs of both corpora are hashed to buckets. A bucket's gain is the scaled logarithm of its share in the target over
its share in the corpus; a document's weight is the sum of the gains of its features, and adding Gumbel noise to it and
taking the highest scores draws without replacement in proportion to exp(weight / 1000).

One pass over the texts writes the inverted index: blocks of postings (bucket, document, count) of one batch of documents
and one range of buckets. The blocks are shuffled by (range, part), where a part holds at most PART batches, so that a
frequent bucket is spread over all parts; there they are co-grouped with their range's gains, which come from partial
sums of both corpora's blocks, and give contributions, summed by document. No shuffle key grows with a word's frequency.

Defined cases: a null or blank text has no features and weight 0; rows are judged one by one, equal ones too; a row without
doc_id has a weight but no lot, so its score and rank are null and it does not count as drawable; an empty corpus gives no
rows and an empty target lowers every gain alike; ties in score go to the smaller doc_id, equal rows to any of them; other
columns are ignored; a very long text is a batch of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, Scratch, alnum_words, arrow_schema, map_batches, texts
from .native import small

#: Ranges of buckets, so blocks of a batch; and batches whose blocks of a range meet in one group.
RANGES, PART = 16, 64
#: Longest feature that the bucket cache keeps, in bytes.
CACHED_BYTES = 64

_BLOCK = "corpus int, batch long, part long, range int, n_docs int, buckets binary, places binary, counts binary, doc_ids array<long>, n_features array<long>, n_words array<long>"


class _Buckets(dict):
    """crc32 modulo n of each feature (bytes), kept while the table is small."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % self.n
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


class _Blocks:
    """One a task: makes the blocks of its batches and numbers them."""

    def __init__(self, n_buckets: int, max_n: int):
        self.bucket, self.n_buckets, self.max_n, self.made = _Buckets(n_buckets), n_buckets, max_n, 0
        self.task = TaskContext.get().partitionId()

    def features(self, words: list[bytes]) -> Iterator[bytes]:
        yield from words
        for n in range(2, self.max_n + 1):
            yield from (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))

    def __call__(self, doc_id: list, text: list, corpus: int) -> dict[str, list]:
        words = [alnum_words(t) for t in text]
        found = [np.fromiter(map(self.bucket.__getitem__, self.features(w)), np.int64) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        key, counts = np.unique(np.concatenate(found) * len(text) + np.repeat(np.arange(len(text)), sizes), return_counts=True)
        buckets, places = key // len(text), key % len(text)
        ends = np.searchsorted(buckets * RANGES // self.n_buckets, np.arange(RANGES + 1))
        batch, part = self.task << 32 | self.made, self.task << 32 | self.made // PART
        self.made += 1
        own = (corpus, batch, part)
        rows = [(*own, -1, len(text), None, None, None, doc_id, sizes.tolist(), [len(w) for w in words])]
        for r in range(RANGES):
            at = slice(ends[r], ends[r + 1])
            if at.start < at.stop:
                rows.append((*own, r, len(text), *(x[at].astype("<i4").tobytes() for x in (buckets, places, counts)), None, None, None))
        return dict(zip([f.split()[0] for f in _BLOCK.split(", ")], map(list, zip(*rows, strict=True)), strict=True))


def inverted_index(docs: DataFrame, target: DataFrame, n_buckets: int, max_n: int, scratch: Scratch) -> DataFrame:
    """Stored blocks of both corpora (0: docs, 1: target), and with range -1 what is known of a batch's documents."""
    make = lambda: _Blocks(n_buckets, max_n)

    def blocks(df: DataFrame, corpus: int) -> DataFrame:
        return map_batches(df, lambda own, i, t: own(i, t, corpus), _BLOCK, init=make)

    own = texts(docs)
    other = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.table(blocks(own, 0).unionByName(blocks(other, 1)), "index")


def bucket_gains(index: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, s and t (features of docs and target in it), gain; at most n_buckets rows."""

    def sums(corpus: list, buckets: list, counts: list) -> dict[str, np.ndarray]:
        total = np.zeros((2, n_buckets), np.int64)
        for c, b, n in zip(corpus, buckets, counts, strict=True):
            np.add.at(total[c], np.frombuffer(b, "<i4"), np.frombuffer(n, "<i4"))
        held = np.flatnonzero(total.any(0))
        return {"bucket": held, "s": total[0, held], "t": total[1, held]}

    partial = map_batches(index.where("range >= 0").select("corpus", "buckets", "counts"), sums, "bucket int, s long, t long", text="buckets")
    both = partial.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    share = ((F.col("t") + 1) * F.lit(float(whole.S + n_buckets))) / ((F.col("s") + 1) * F.lit(float(whole.T + n_buckets)))
    return both.withColumn("gain", F.floor(1000 * F.log(share)))


def weights(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, max_n: int = 1) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row of docs, and its place (batch, place) in the index."""
    scratch = Scratch(docs.sparkSession, "resampling")
    index = inverted_index(docs, target, n_buckets, max_n, scratch)
    gains = scratch.table(bucket_gains(index, n_buckets), "gains")
    # at most n_buckets entries in RANGES rows
    by_range = gains.groupBy(F.floor(F.col("bucket") * RANGES / n_buckets).cast("int").alias("range")).agg(F.collect_list("bucket").alias("own"), F.collect_list("gain").alias("gains"))
    blocks = index.where("corpus = 0 AND range >= 0").select("batch", "part", "range", "n_docs", "buckets", "places", "counts")
    met = blocks.select("range", "part").distinct().join(small(by_range, n_buckets, 16), "range").toDF("of_range", "of_part", "own", "gains")

    def contribute(block: pa.Table, gain: pa.Table) -> pa.Table:
        of = np.zeros(n_buckets, np.float64)  # whole numbers, so their sums are exact
        for own, g in zip(gain.column("own").to_pylist(), gain.column("gains").to_pylist(), strict=True):
            of[own] = g
        made = []
        for n, b, p, c in zip(*(block.column(k).to_pylist() for k in ("n_docs", "buckets", "places", "counts")), strict=True):
            made.append(np.bincount(np.frombuffer(p, "<i4"), of[np.frombuffer(b, "<i4")] * np.frombuffer(c, "<i4"), n).astype("<i8").tobytes())
        return pa.table({"batch": block.column("batch"), "partial": pa.array(made, pa.binary())})

    emitted = blocks.groupBy("range", "part").cogroup(met.groupBy("of_range", "of_part")).applyInArrow(contribute, "batch long, partial binary")
    own = index.where("corpus = 0 AND range = -1").select("batch", "doc_ids", "n_features", "n_words")
    final = "doc_id long, n_features long, n_words long, weight long, batch long, place int"
    out = arrow_schema(T.StructType.fromDDL(final))

    def reduce(rows: pa.Table) -> pa.Table:
        """The contributions of a batch (one a range) and its documents."""
        total: np.ndarray | int = 0
        ids, n_features, n_words = [], [], []
        for p, i, f, w in zip(*(rows.column(k).to_pylist() for k in ("partial", "doc_ids", "n_features", "n_words")), strict=True):
            if p is None:
                ids, n_features, n_words = i, f, w
            else:
                total = total + np.frombuffer(p, "<i8")
        n = len(ids)
        sums = total if isinstance(total, np.ndarray) else np.zeros(n, np.int64)
        batch = rows.column("batch")[0].as_py()
        return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip((ids, n_features, n_words, sums, [batch] * n, range(n)), out, strict=True)], schema=out)

    return own.unionByName(emitted, allowMissingColumns=True).groupBy("batch").applyInArrow(reduce, final)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, n_buckets: int = 10_000, max_n: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank is null for what is not drawn.

    Ranks come from a range partitioning by score; only its partitions' row counts reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "draw")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch.table(weights(docs, target, n_buckets, max_n).withColumn("score", F.col("weight") + noise), "scored")
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("batch"), F.asc("place")]
    ranged = scratch.table(scored.where(able).repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "ranged")
    before, total = [], 0
    for r in ranged.groupBy("slice").count().orderBy("slice").collect():  # one row a range partition
        before.append((r["slice"], total))
        total += r["count"]
    starts = docs.sparkSession.createDataFrame(before, "slice int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    ranked = ranged.join(F.broadcast(starts), "slice").withColumn("rank", rank)
    drawn = F.when(F.col("rank") <= percent * total // 100, F.col("rank"))
    cols = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*cols, drawn.alias("rank")).unionByName(scored.where(~able).select(*cols, F.lit(None).cast("long").alias("rank")))


def op13(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 of a string column `x` of the table `v`, over its UTF-8 bytes, by the usual table of 256 remainders.
CRC_TABLE = "tab AS (SELECT list(r ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS r FROM range(256) AS g(i)))"
CRC = "xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"

SQL = rf"""
WITH {CRC_TABLE},
w AS (SELECT 0 AS corpus, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM documents
  UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS MATERIALIZED (SELECT x, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT x FROM w), tab),
b AS MATERIALIZED (SELECT corpus, doc_id, bucket, count(*) AS n FROM w JOIN v USING (x) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 0), 0) AS s, coalesce(sum(n) FILTER (corpus = 1), 0) AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s),
f AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM b JOIN g USING (bucket) WHERE corpus = 0 GROUP BY doc_id),
d AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN f USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM r
"""
