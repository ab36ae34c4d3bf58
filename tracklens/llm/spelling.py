"""Spelling variants by a self-join of the vocabulary's trie with active-node sets.

The vocabulary stands in a trie. A node's active nodes are those at distance one at most, and a child's follow from its
parent's: from the node itself come its parent, its siblings and its children, all at distance one; a node already at
distance one stays active only through an equal character. A terminal node's active terminals are its near words.

The trie is cut into pieces by prefix. A prefix with more than PIECE words is cut further, level by level, so that no piece
is large however many words share a prefix. At a cut level nodes at distance one have to go on with equal rests, so there
the active nodes are rows: a word gives its rest after the level's character was dropped, and its rest with it kept, and
equal (prefix, rest) meet. Their groups hold one word a character of the alphabet. A pair is emitted only at the level
where its words part, hence once.

Defined cases: a null or blank text has no words; rows are counted one by one, equal ones too; a row without doc_id hashes as
the empty id; an empty table gives no rows; ties in the largest count go to the smallest word; other columns are
ignored; words of any length are whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, arrow_schema, map_batches, texts
from .native import small
from .resampling import CRC, CRC_TABLE

#: Words of a piece of the trie, at most (a piece below the last branching may not be cut further and needs not be).
PIECE = 4_000
#: Levels looked at in the first round of cutting; every round looks twice as far.
LEVELS = 3

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _words(least: int, every: int):
    def count(doc_id: list, text: list) -> dict[str, list]:
        found: Counter[bytes] = Counter()
        for i, t in zip(doc_id, text, strict=True):
            if not t:
                continue
            start = zlib.crc32(b"" if i is None else str(i).encode())
            start = zlib.crc32(b":", start)
            for run, n in Counter(_RUN.findall(t.translate(LOWER))).items():
                h = zlib.crc32(run, start)
                if h % every == 0:
                    word = run.decode()
                    at = h % len(word)
                    run = (word[:at] + word[at + 1 :]).encode()
                found[run] += n
        kept = [x for x in ((w.decode(), n) for w, n in found.items() if len(w) >= least) if len(x[0]) >= least]
        return {"word": [w for w, _ in kept], "n": [n for _, n in kept]}

    return count


def vocabulary(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """word, n: runs of letters of all texts, of which one in `every` (by document and run) has lost a character."""
    d = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_batches(d, _words(least_chars, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def pieces(words: DataFrame, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """words with depth: the length of the shortest prefix that at most `piece` words share (or beyond the word's own end)."""
    done, open_, level, width, round_ = None, words, 1, LEVELS, 0
    while True:
        steps = F.explode(F.sequence(F.lit(level), F.lit(level + width - 1))).alias("at")
        prefix = F.xxhash64("at", F.substring("word", 1, F.col("at")))
        full = open_.select("word", steps).select("at", prefix.alias("prefix")).groupBy("at", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("at", "prefix")
        full = scratch.table(full, f"full{round_}")  # at most width / piece of the words
        n = full.count()
        own = open_.select("word", "n", steps).withColumn("prefix", prefix).join(small(full.withColumn("full", F.lit(1)), n, 24), ["at", "prefix"], "left") if n else None
        if own is None:
            settled = open_.withColumn("depth", F.lit(level))
            return settled if done is None else done.unionByName(settled)
        # full prefixes of a word are a chain from above
        deep = scratch.table(own.groupBy("word").agg(F.first("n").alias("n"), F.count("full").alias("k")), f"deep{round_}")
        settled = deep.where(F.col("k") < width).select("word", "n", (F.col("k") + level).cast("int").alias("depth"))
        done = settled if done is None else done.unionByName(settled)
        open_ = deep.where(F.col("k") == width).select("word", "n")
        level, width, round_ = level + width, 2 * width, round_ + 1


def trie_pairs(words: list[tuple[str, int]], skip: int) -> list[tuple[str, int, str, int]]:
    """(word, n, near word, its n) in both directions, of words that agree in their first `skip` characters."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, tuple[str, int]] = {}
    for w, n in words:
        node = 0
        for c in w[skip:]:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
            node = below
        ends[node] = (w, n)
    out = []
    # a node with its active nodes at distance one
    stack: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if node in ends:
            out += [(*ends[node], *ends[v]) for v in active if v in ends]
        own = children[node]
        for c, child in own.items():
            after = {children[v][c] for v in active if c in children[v]}
            after.update(own.values(), children[child].values())
            after.add(node)
            after.discard(child)
            stack.append((child, after))
    return out


def near_words(words: DataFrame, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """word, n, near, near_n: both directions of every pair that one inserted, deleted or replaced character makes equal."""
    cut = scratch.table(pieces(words, scratch, piece), "pieces")
    pair = "word string, n long, near string, near_n long"
    out = arrow_schema(T.StructType.fromDDL(pair))

    def join(rows: pa.Table) -> pa.Table:
        own = list(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
        found = trie_pairs(own, rows.column("depth")[0].as_py())
        return pa.Table.from_arrays([pa.array([p[k] for p in found], f.type) for k, f in enumerate(out)], schema=out)

    inside = cut.withColumn("prefix", F.substring("word", F.lit(1), F.col("depth"))).groupBy("depth", "prefix").applyInArrow(join, pair)

    # active nodes across a cut level: the rest after the level's character, with that character dropped or kept
    level = F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word")))).alias("at")
    rows = cut.select("word", "n", level)
    rest = lambda k: F.expr(f"substring(word, at + {k})")
    head, char = F.expr("left(word, at)"), F.expr("substring(word, at + 1, 1)")
    key = [F.xxhash64("at", head).alias("head"), "at"]
    dropped = rows.where(F.col("at") < F.length("word")).select(*key, rest(2).alias("rest"), char.alias("char"), "word", "n")
    kept = rows.select(*key, rest(1).alias("rest"), char.alias("next"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    on = ["head", "at", "rest"]
    same_head = F.expr("left(word, at) = left(near, at)")
    replaced = dropped.join(dropped.toDF("head", "at", "rest", "other", "near", "near_n"), on).where(F.col("char") != F.col("other")).where(same_head)
    inserted = dropped.join(kept, on).where((F.col("char") != F.col("next")) & same_head)
    across = inserted.select("word", "n", "near", "near_n").unionByName(inserted.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return inside.unionByName(replaced.select("word", "n", "near", "near_n")).unionByName(across)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root from word, form. A form occurs at least ten times as often, so 64-bit counts end a chain after 18 steps."""
    now = forms.select("word", F.col("form").alias("root"))
    for k in range(5):
        above = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        now = scratch.table(now.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), f"roots{k}")
        if not now.where("moved").limit(1).count():
            break
        now = now.select("word", "root")
    return now.select("word", "root")


def variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31, ratio: int = 10, piece: int = PIECE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(vocabulary(docs, least_chars, least_n, every), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    found = near_words(words, scratch, piece).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.col("best.near_n") >= ratio * F.col("n")
    named = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, F.col("best.near_n")).alias("form_n"))
    named = scratch.table(named, "named")
    top = roots(named.where("form IS NOT NULL"), scratch)
    return named.join(top, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Near pairs in SQL: words that agree once a character each (or of one) is left out.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {CRC} AS h FROM c, tab WHERE length(run) >= 7),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) AS g(i)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM d a JOIN v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM d a JOIN v ON a.rest = v.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS top, 0 AS k FROM f UNION ALL SELECT t.word, f.form, k + 1 FROM t JOIN f ON t.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(top, k) AS root FROM t GROUP BY word) USING (word)
"""
