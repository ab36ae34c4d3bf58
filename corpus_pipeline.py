"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of the table (the last one: its
pieces), so that each can be written and read again between stages. run() does that in the shared folder, and
drops a stage's own intermediate tables once its result is written.

Defined cases, for every stage: other columns than the table's are dropped; an empty table gives no rows; rows
without doc_id or text are kept unless the stage's rule takes them out. A null or blank text is rejected by the
classifier. Rows that agree in doc_id and text are one document from the n-gram join on; rows with equal doc_id and
other texts stay, each under its own component; a row without doc_id goes there if its text is that of another row.
Ties in similarity do not exist (links are yes or no); of a group the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import decontamination, jaccard, packing, quality_classifier, substrings
from tracklens.llm.common import Scratch, workspace
from tracklens.llm.native import small
from tracklens.llm.tokens import public_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go."""
    own = docs.select(*COLUMNS)
    return quality_classifier.scored(own).where("_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, five words and similarity 0.8: of each group the document with the smallest doc_id stays, once.

    Rows without doc_id have no place in a group: they go if their text is that of another row, and stay once else.
    """
    own = docs.select(*COLUMNS)
    found = jaccard.near_duplicates(own, n=5, num=80, den=100)
    firsts = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = own.join(firsts, "doc_id", "left_semi").select(*COLUMNS)
    by_text = F.md5(F.col("text").cast("binary"))
    repeated = Scratch(spark, "repeated").table(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "ids")
    ids = small(repeated, repeated.count(), 32)
    once = kept.join(ids, "doc_id", "left_anti").select(*COLUMNS)
    again = kept.join(ids, "doc_id", "left_semi").withColumn("_text", by_text).dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)
    named = once.unionByName(again)
    nameless = own.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return named
    nameless = nameless.withColumn("_text", by_text).dropDuplicates(["_text"])
    known = own.where("doc_id IS NOT NULL").select(by_text.alias("_text")).distinct()  # one row a text, combined before its shuffle
    return named.unionByName(nameless.join(known, "_text", "left_anti").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated passages go; a document of which nothing is left goes too."""
    made = substrings.dedup(docs.select(*COLUMNS), keep=["lang", "source", "n_chars"], verbatim=True)
    left = made.where("n_removed = 0 OR n_removed < n_words")
    n = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", n.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a benchmark phrase go."""
    own = docs.select(*COLUMNS)
    found = decontamination.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h")).distinct()
    return own.join(bad, own["doc_id"].eqNullSafe(bad["_i"]) & (F.xxhash64(own["text"].cast("string")) == bad["_h"]), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces with their sequence and offset."""
    return packing.pack_documents(docs, public_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with workspace():
            made = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
        docs = made
    return docs
