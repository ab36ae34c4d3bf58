"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word n-grams (64-bit hashes). Two sets link when their Jaccard similarity
is at least `num / den`; the result is the component of each document, so links inside a component need not
all be made, but none between different texts may be lost.

1. A counting sketch of bounded size over all n-grams orders tokens rare first (any order is correct).
2. Of n tokens a set's prefix has n - ceil(t n) + k: sets that link share at least k prefix tokens.
   Documents with the same set become one; sets with the same prefix and size become one group.
3. Prefix tokens that several groups share make lists. Short lists (at most `SHORT` groups) give group pairs,
   which need k shared tokens, less those that only long lists could hold. In long lists, each size class
   elects the member with most shared tokens as leader, and members pair with it alone: a group of copies
   costs as many pairs as it has members.
4. Groups of one set are verified pair by pair. Of a pair with a larger group one group's first set is the leader
   of the other group's sets, as it is of its own: members are never multiplied with members. Links are
   decided on the whole sets.
5. Residual join. Let d(x) = x XOR leader. x and y then differ by d(x) XOR d(y). If both link to the leader
   they are connected. If x does not, a y that links to x shares more than half of d(y) with d(x): so the
   prefix rule is applied again, to the differences, under each leader, tokens that the leader lacks first (what
   the leader has and its members lack is common to all of them). Components are kept up to date by round, and
   only pairs of different components are verified: of a list, each member outside its largest component with
   every other. With at most `short` such members a list gives these pairs, at most `short` a member; one with more
   elects one of its members as leader of the others, whose differences go through this step again. Each
   round allows eight times as many, so the rounds end.
6. The components of the last round.

Joins on keys that may be hot (tokens, leaders, equal sets, labels) deal their rows to parts.

Defined cases: a null or blank text has no n-grams, size 0, and is a component of its own; a text of fewer
words than n is one n-gram; a doc_id is one node, and each row of it gets the component of its own text; a null doc_id
links with nothing and has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_HASH, Scratch, chunks, map_batches, texts
from .components import components
from .native import SPLIT, bloom, bloom_blocks, heavy_keys, possible_hits, small, spread_join

SHORT = 10
MAX_LOG_CELLS, SLICE = 22, 1 << 18
_LEVEL_SHIFT = 58


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-cased words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    total = len(ids) - n + 1
    h = ids[:total].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + total]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(h ^ (h >> np.uint64(33)))


class Order:
    """Turns n-gram hashes into tokens whose numeric order is rare first: 6 bits of frequency class, 58 of hash."""

    def __init__(self, log_cells: int, levels: np.ndarray):
        self.log_cells, self.levels = log_cells, levels

    def tokens(self, h: np.ndarray) -> np.ndarray:
        level = self.levels[(h >> np.uint64(64 - self.log_cells)).astype(np.int64)].astype(np.uint64)
        return np.sort(level << np.uint64(_LEVEL_SHIFT) | h >> np.uint64(64 - _LEVEL_SHIFT))


def order(docs: DataFrame, n: int) -> Order:
    """Counts of hash cells over all documents. Tasks send slices of counts, which are added in two grouped steps."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_cells = min(MAX_LOG_CELLS, max(12, (n_bytes // 6).bit_length()))
    salts = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    schema = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])
    per = min(SLICE, 1 << log_cells)

    def pack(a: np.ndarray) -> bytes:
        return zlib.compress(a.astype(np.uint32).tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, salt = np.zeros(1 << log_cells, np.uint32), TaskContext.get().partitionId() % salts
        for batch in batches:
            for part in chunks(batch):
                got = [shingles(t.as_py(), n) for t in part.column(0)]
                at, c = np.unique(np.concatenate(got) >> np.uint64(64 - log_cells), return_counts=True)
                cells[at.astype(np.int64)] += c.astype(np.uint32)
        for s in range(0, len(cells), per):
            if cells[s : s + per].any():
                yield pa.RecordBatch.from_pylist([{"slice": s // per, "salt": salt, "counts": pack(cells[s : s + per])}], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(per, np.uint64)
        for b in group["counts"]:
            total += np.frombuffer(zlib.decompress(b.as_py()), np.uint32)
        first = group.slice(0, 1)
        return pa.table({"slice": first["slice"], "salt": first["salt"], "counts": pa.array([pack(np.minimum(total, 0xFFFFFFFF))], pa.binary())}, schema=schema)

    ddl = "slice int, salt int, counts binary"
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, ddl).groupBy("slice", "salt").applyInArrow(add, ddl)
    levels = np.zeros(1 << log_cells, np.uint8)
    for r in parts.groupBy("slice").applyInArrow(add, ddl).toLocalIterator():  # 2^22 cells at most
        counts = np.frombuffer(zlib.decompress(r.counts), np.uint32)
        levels[r.slice * per : r.slice * per + per] = np.minimum(63, np.floor(2 * np.log2(counts + 1.0)))
    return Order(log_cells, levels)


def _shared_needed(size: int) -> int:
    """k: prefix tokens that sets of this size or more must share."""
    return 1 + min(size // 25, 15)


def _k(size: Column) -> Column:
    return F.lit(1) + F.least(F.floor(size / 25), F.lit(15))


class Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        self.docs = texts(docs).where("doc_id IS NOT NULL")
        self.scratch, self.n_joins = Scratch(self.spark, "jaccard"), 0
        self.order = self.spark.sparkContext.broadcast(order(self.docs, n))

    # sizes a and b can link
    def _fits(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def summaries(self) -> DataFrame:
        """doc_id, n, 128-bit hashes of the set and of its prefix, and the prefix."""
        n, num, den, shared = self.n, self.num, self.den, self.order

        def summarise(doc_id: list, text: list) -> dict[str, list]:
            out = {k: [] for k in ("n", "set1", "set2", "pre1", "pre2", "prefix")}
            for t in text:
                tokens = shared.value.tokens(shingles(t, n))
                size = len(tokens)
                prefix = tokens[: size - -(-num * size // den) + _shared_needed(size)] if size else tokens
                for a, b, x in (("set1", "set2", tokens), ("pre1", "pre2", prefix)):
                    h = xxhash.xxh3_128_digest(x.tobytes())
                    out[a].append(int.from_bytes(h[:8], "little", signed=True))
                    out[b].append(int.from_bytes(h[8:], "little", signed=True))
                out["n"].append(size)
                out["prefix"].append(prefix.view(np.int64))
            return {"doc_id": doc_id} | out

        schema = "doc_id long, n int, set1 long, set2 long, pre1 long, pre2 long, prefix array<long>"
        return self.scratch.table(map_batches(self.docs.select("doc_id", F.col("text").cast("binary").alias("text")), summarise, schema), "summaries")

    def lists(self, summaries: DataFrame, groups: DataFrame) -> DataFrame:
        """token, gid, n, m (how many groups have it): the prefix tokens that several groups share."""
        own = summaries.join(groups.select(F.col("gid").alias("doc_id"), F.col("n").alias("_n"), F.col("pre1").alias("_p1"), F.col("pre2").alias("_p2")), "doc_id").where("n = _n AND pre1 = _p1 AND pre2 = _p2")
        postings = own.select(F.col("doc_id").alias("gid"), "n", F.explode("prefix").alias("token"))
        counts = self.scratch.table(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "shared")
        heavy = self.scratch.table(heavy_keys(counts, ["token"], n="m"), "heavy-tokens")
        return self.scratch.table(spread_join(postings, counts, ["token"], "gid", heavy).select("token", "gid", "n", "m"), "lists")

    def group_pairs(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of short lists with enough shared tokens, leader pairs of long lists): a, b."""
        is_long = F.col("m") > SHORT
        long_ = lists.where(is_long).groupBy("gid").agg(F.count("*").alias("n_long"))
        short = lists.where(~is_long).join(long_, "gid", "left").select("token", F.struct("gid", "n", F.coalesce("n_long", F.lit(0)).alias("l")).alias("m"))
        members = short.groupBy("token").agg(F.array_sort(F.collect_list("m")).alias("ms"))  # SHORT at most
        first = members.select("ms", F.posexplode("ms").alias("i", "x")).select("x", F.explode(F.slice("ms", F.col("i") + 2, SHORT)).alias("y"))
        shared = first.where((F.col("x.gid") < F.col("y.gid")) & self._fits(F.col("x.n"), F.col("y.n"))).groupBy(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("x.n", "y.n")).alias("n"), F.min(F.least("x.l", "y.l")).alias("l"))
        direct = shared.where(F.col("c") >= F.greatest(F.lit(1), _k(F.col("n")) - F.col("l"))).select("a", "b")
        # fewer long-list tokens than any partner needs: short lists alone decide
        least = F.ceil(F.col("n") * self.num / self.den)
        members = lists.where(is_long).join(long_, "gid").where(F.col("n_long") >= _k(least))
        bucket = F.floor(F.log("n") / float(np.log(self.den / self.num))).cast("int")
        keyed = members.select("token", "gid", "m", "n_long", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
        # a list's length is known, so members are dealt to parts at once, and the leader goes to each of them
        parts = F.ceil(F.col("m") / SPLIT).cast("int")
        keyed = keyed.withColumn("part", F.pmod(F.xxhash64("gid"), parts).cast("int"))
        best = keyed.groupBy("token", "bucket", "part").agg(F.max(F.struct("n_long", -F.col("gid"))).alias("b"), F.max("m").alias("m"))
        leaders = best.groupBy("token", "bucket").agg(F.max("b").alias("b"), F.max("m").alias("m")).select("token", "bucket", (-F.col("b.col2")).alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        star = keyed.join(leaders, ["token", "bucket", "part"]).where("gid <> a").select("a", F.col("gid").alias("b")).distinct()
        return direct, star

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """doc_id, n, tokens (sorted, as bytes) of the given documents."""
        n, shared = self.n, self.order

        def make(doc_id: list, text: list) -> dict[str, list]:
            made = [shared.value.tokens(shingles(t, n)) for t in text]
            return {"doc_id": doc_id, "n": [len(x) for x in made], "tokens": [x.tobytes() for x in made]}

        # a Bloom filter of bounded size keeps most other texts out of the shuffle
        ids = self.scratch.table(ids, f"{name}-ids")
        n_blocks = bloom_blocks(ids.count())
        likely = possible_hits(self.docs, "doc_id", bloom(ids, "doc_id", n_blocks), n_blocks).where("_maybe").select("doc_id", "text")
        wanted = likely.join(ids, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
        return self.scratch.table(map_batches(wanted, make, "doc_id long, n int, tokens binary"), name)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, star, linked and, of star pairs, the keys of b's difference from a: uu, ul or lu, as arrays of tokens.

        Star pairs and others share the joins. A leader has many members, so its set goes to parts of them; a member has few leaders.
        """
        num, den = self.num, self.den
        n_blocks = bloom_blocks(pairs.count())

        def side(s: str) -> DataFrame:
            """The sets of this side's documents; a Bloom filter keeps most others out of the shuffle."""
            own = sets.select(F.col("doc_id").alias(s), F.col("tokens").alias(f"t{s}"))
            return possible_hits(own, s, bloom(pairs.select(s).distinct(), s, n_blocks), n_blocks).where("_maybe").drop("_maybe")

        self.n_joins += 1
        heavy = self.scratch.table(heavy_keys(pairs, ["a"]), f"heavy-leaders{self.n_joins}")
        both = spread_join(pairs, side("a"), ["a"], "b", heavy).join(side("b"), "b").select("a", "b", "star", "ta", "tb")

        def check(a: list, b: list, star: list, ta: list, tb: list) -> dict[str, list]:
            out = {"linked": [], "n": [], "d": [], "uu": [], "ul": [], "lu": []}
            for residual, x, y in zip(star, ta, tb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.concatenate([x, y])
                order = np.argsort(merged, kind="stable")
                merged = merged[order]
                same = merged[1:] == merged[:-1]
                common = int(same.sum())
                linked = common > 0 and den * common >= num * (len(x) + len(y) - common)
                keys, d = {"uu": [], "ul": [], "lu": []}, 0
                if residual:
                    alone = np.ones(len(merged), bool)
                    alone[1:] &= ~same
                    alone[:-1] &= ~same
                    mine = order >= len(x)
                    keys, d = _difference_keys(np.concatenate([merged[alone & mine], merged[alone & ~mine]]), len(x), len(y), linked, num, den), int(alone.sum())
                out["linked"].append(linked)
                out["n"].append(len(y))
                out["d"].append(d)
                for k, v in keys.items():
                    out[k].append(v)
            return {"a": a, "b": b, "star": star} | out

        return map_batches(both, check, "a long, b long, star boolean, linked boolean, n int, d int, uu array<long>, ul array<long>, lu array<long>", text="tb")

    def residual_pairs(self, star: DataFrame, labels: DataFrame, short: int, name: str) -> DataFrame:
        """a, b, star: pairs of different components under one leader whose differences from it share prefix tokens, at least one of them unlinked.

        The keys are long enough for any partner; for the pair at hand, whose sizes are known, the shared token
        must lie in the shorter prefix that its own least overlap leaves. Lists with more than `short` members outside
        their largest component elect the one with the smallest doc_id, an unlinked one if there is any, and pair the others with it.
        """
        t = self.scratch.table
        star = star.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b", "left").withColumn("c", F.coalesce("c", "b"))
        # kind 0: unlinked with unlinked; kind 1: unlinked with linked
        each = [(0, "uu", True), (1, "ul", True), (1, "lu", False)]
        entry = [star.where(F.size(c) > 0).select(F.lit(k).alias("kind"), F.col("a").alias("leader"), F.posexplode(c).alias("p", "token"), F.lit(u).alias("u"), F.col("b").alias("x"), "n", "d", "c") for k, c, u in each]
        entries = entry[0].unionByName(entry[1]).unionByName(entry[2])
        key = ["kind", "leader", "token"]
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        by_component = entries.groupBy(*key, "c").agg(one(F.col("u")).alias("n_u"), one(~F.col("u")).alias("n_l"), F.min(F.struct(~F.col("u"), "x")).alias("z"))
        n = F.col("n_u") + F.col("n_l")
        sizes = by_component.groupBy(*key).agg(F.sum(n).alias("m"), F.sum("n_u").alias("n_u"), F.sum("n_l").alias("n_l"), F.count("*").alias("n_c"), F.max(F.struct(n.alias("n"), "c")).alias("most"), F.min("z").alias("z"))
        meets = (F.col("n_c") > 1) & ((F.col("kind") == 0) | (F.col("n_u") > 0) & (F.col("n_l") > 0))
        sizes = t(sizes.where(meets).select(*key, "m", (F.col("m") - F.col("most.n")).alias("others"), F.col("most.c").alias("major"), F.col("z.x").alias("z")), f"{name}-lists")
        heavy = t(heavy_keys(sizes, key, n="m"), f"{name}-heavy")
        held = t(spread_join(entries, sizes, key, "x", heavy), f"{name}-entries")
        most = F.floor((F.col("nx") + F.col("ny")) * (self.den - self.num) / (self.den + self.num))
        shared = F.greatest(F.lit(1), F.ceil((F.col("dx") + F.col("dy") - most) / 2))
        fits = self._fits(F.col("nx"), F.col("ny")) & (F.col("px") <= F.col("dx") - shared) & (F.col("py") <= F.col("dy") - shared)
        side = lambda s, *more: held.where(F.col("others") <= short).select(*key, *(F.col(c).alias(f"{c}{s}") for c in ("x", "p", "u", "n", "d", "c")), *more)
        few = t(side("x", "major").where("cx <> major"), f"{name}-few")  # at most `short` a list
        # two members outside the largest component meet once
        once = (F.col("cy") == F.col("major")) | (F.col("xx") < F.col("xy"))
        near = spread_join(side("y"), few, key, "xy", heavy).where((F.col("cx") != F.col("cy")) & fits & once & ((F.col("kind") == 0) | (F.col("ux") != F.col("uy"))))
        near = near.select(F.least("xx", "xy").alias("a"), F.greatest("xx", "xy").alias("b")).distinct().withColumn("star", F.lit(False))
        far = held.where((F.col("others") > short) & (F.col("x") != F.col("z"))).select(F.col("z").alias("a"), F.col("x").alias("b")).distinct().withColumn("star", F.lit(True))
        return near.unionByName(far)

    def merged(self, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """labels (node, component) after more links (a, b): components of the components that these connect."""
        t = self.scratch.table

        def with_label(rows: DataFrame, s: str, other: str) -> DataFrame:
            own = labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
            return spread_join(rows, own, [s], other, t(heavy_keys(rows, [s]), f"{name}-heavy-{s}"), "left").withColumn(f"c{s}", F.coalesce(f"c{s}", s))

        edges = with_label(with_label(links, "a", "b"), "b", "a").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        edges = t(edges, f"{name}-edges")
        if not edges.limit(1).count():
            return labels
        joined = t(components(edges, Scratch(self.spark, "components")), f"{name}-joined")
        large = t(heavy_keys(labels, ["component"]), f"{name}-large")
        moved = spread_join(labels, joined.select(F.col("node").alias("component"), F.col("component").alias("to")), ["component"], "node", large, "left")
        fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
        return t(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(fresh), name)

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        t, summaries = self.scratch.table, self.summaries()
        key = summaries.where("n > 0").select("doc_id", "n", "set1", "set2", "pre1", "pre2")
        rep = key.groupBy("set1", "set2").agg(F.min("doc_id").alias("sid"), F.count("*").alias("n_docs"), F.first("n").alias("n"), F.first("pre1").alias("pre1"), F.first("pre2").alias("pre2"))
        rep = t(rep, "sets")
        group = ["pre1", "pre2", "n"]
        groups = t(rep.groupBy(*group).agg(F.min("sid").alias("gid"), F.count("*").alias("n_sets")), "groups")
        lists = self.lists(summaries, groups)
        self.scratch.free()
        direct, star = self.group_pairs(lists)
        # the sets of larger groups; each group's first is their leader
        large = groups.where("n_sets > 1")
        several = t(spread_join(rep.select("sid", *group), large.select(*group, "gid"), group, "sid", t(heavy_keys(large, group, n="n_sets"), "heavy-groups")).select("gid", "sid"), "several")
        wide = t(large.select("gid", "n_sets"), "wide")
        n_wide = wide.count()
        has = lambda p, s: p.join(small(wide.select(F.col("gid").alias(s), F.lit(True).alias(f"_{s}")), n_wide, 32), s, "left").withColumn(f"_{s}", F.coalesce(f"_{s}", F.lit(False)))
        pairs = has(has(direct.withColumn("star", F.lit(False)).unionByName(star.withColumn("star", F.lit(True))), "a"), "b")
        pairs = t(pairs.select("a", "b", (F.col("star") | F.col("_a") | F.col("_b")).alias("star"), F.col("_b").alias("wide")), "group-pairs")
        heavy = t(heavy_keys(wide, ["gid"], n="n_sets"), "heavy-expansions")
        members = spread_join(several, pairs.where("wide").select("a", F.col("b").alias("gid")), ["gid"], "sid", heavy).select("a", F.col("sid").alias("b"), F.lit(True).alias("star"))
        own = several.select(F.col("gid").alias("a"), F.col("sid").alias("b"), F.lit(True).alias("star"))
        pairs = pairs.where("NOT wide").select("a", "b", "star").unionByName(members).unionByName(own).where("a <> b")
        pairs = t(pairs.groupBy("a", "b").agg(F.bool_or("star").alias("star")), "pairs")
        self.scratch.free()
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = self.sets(ids, "tokens")
        self.scratch.free()
        labels, short, round_ = None, 8 * SHORT, 0
        while True:
            checked = t(self.verified(pairs, sets), f"checked{round_}")
            found = checked.where("linked").select("a", "b")
            labels = t(components(found, Scratch(self.spark, "components")), "labels0") if labels is None else self.merged(labels, found, f"labels{round_}")
            pairs = t(self.residual_pairs(checked.where("star"), labels, short, f"residual{round_}"), f"pairs{round_}")
            self.scratch.free()
            round_, short = round_ + 1, 8 * short
            if not pairs.limit(1).count():
                break
        labels = labels.select(F.col("node").alias("sid"), F.col("component"))
        known = rep.select("set1", "set2", "sid").join(labels, "sid", "left").select("set1", "set2", F.coalesce("component", "sid").alias("component"))
        heavy = t(heavy_keys(rep, ["set1", "set2"], n="n_docs"), "heavy-sets")
        rows = spread_join(summaries.select("doc_id", "n", "set1", "set2"), known, ["set1", "set2"], "doc_id", heavy, "left")
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _difference_keys(d: np.ndarray, leader: int, own: int, linked: bool, num: int, den: int) -> dict[str, np.ndarray]:
    """Prefixes of the difference d of a set of size `own` from its leader (what the leader lacks comes first), for the residual join.

    A pair of sizes p and q links when its difference is at most (p + q) (den - num) / (den + num). most: the
    largest difference own can have from a partner; least: the fewest tokens an unlinked partner differs by.
    Partners with |d(x)| and |d(y)| share at least half of |d(x)| + |d(y)| - most.
    """
    gap, whole, size = den - num, den + num, len(d)
    largest, smallest = own * den // num, -(-own * num // den)
    most = (own + largest) * gap // whole
    least = (smallest + leader) * gap // whole + 1
    cut = lambda other: d[: max(0, size - max(1, -(-(size + other - most) // 2)) + 1)].view(np.int64)
    none = d[:0].view(np.int64)
    if linked:
        return {"uu": none, "ul": none, "lu": cut(least)}
    return {"uu": cut(max(least, size - most)), "ul": cut(max(0, size - most)), "lu": none}


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for Jaccard >= num / den on word n-grams."""
    out = Join(docs, n, num, den).run()
    rest = texts(docs).where("doc_id IS NULL").select("doc_id", F.col("text").cast("binary").alias("text"))

    def count(doc_id: list, text: list) -> dict[str, list]:
        return {"doc_id": doc_id, "n_shingles": [len(shingles(t, n)) for t in text], "component_id": doc_id}

    return out.unionByName(map_batches(rest, count, "doc_id long, n_shingles long, component_id long"))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS g FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""
__all__ = ["Join", "near_duplicates", "op9"]
