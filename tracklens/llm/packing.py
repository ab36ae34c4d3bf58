"""Best-two-fit packing of token sequences into bins of fixed length.

Lengths are integers up to the bin size, so packing is planned on the histogram of lengths and never on
single documents: at most `capacity` counts reach the driver, whatever the corpus. The plan fills a bin
greedily (largest length that still fits), then takes out its smallest member and looks for two unpacked
lengths that fit the expanded gap more tightly than that member did. A finished bin is repeated as often as
the counts allow, which gives what packing one document at a time would. Pieces get their ranks within
(length, bucket) in parallel, so a length that a third of all pieces share is split over the buckets.

Defined cases: a null or empty text is the end id alone; only documents longer than a bin are cut; rows with
equal doc_id are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, texts
from .tokens import crc, encoder, public_vocabulary

CAPACITY, END_ID = 4096, 1


@dataclass
class Plan:
    """For each length, in the order in which ranks are used up: first rank, slots a bin, first bin, offsets in the bin."""

    capacity: int
    n_bins: int = 0
    by_length: dict[int, list[tuple[int, int, int, list[int]]]] = field(default_factory=dict)

    def add(self, members: list[int], copies: int, used: dict[int, int]) -> None:
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in members:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            self.by_length.setdefault(length, []).append((used.get(length, 0), len(places), self.n_bins, places))
            used[length] = used.get(length, 0) + copies * len(places)
        self.n_bins += copies


class _Counts:
    """Lengths still unpacked, with the largest one up to any bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v
        self.there = sorted(k for k, v in counts.items() if v)

    def take(self, length: int, k: int = 1) -> None:
        self.n[length] -= k
        if self.n[length] == 0:
            self.there.pop(bisect.bisect_left(self.there, length))

    def give(self, length: int) -> None:
        if self.n[length] == 0:
            bisect.insort(self.there, length)
        self.n[length] += 1

    def up_to(self, room: int) -> int:
        i = bisect.bisect_right(self.there, room)
        return self.there[i - 1] if i else 0

    def best_pair(self, room: int, floor: int) -> tuple[int, int] | None:
        """The pair with the largest sum in (floor, room]; of equal sums the most even one."""
        there = np.array(self.there[: bisect.bisect_right(self.there, room)], np.int64)
        if not len(there):
            return None
        i = np.searchsorted(there, room - there, side="right") - 1
        ok = i >= 0
        j = np.where(ok, i, 0)
        # the same length twice needs two of it; else the next smaller one
        twice = ok & (there[j] == there) & (self.n[there] < 2)
        j = np.where(twice, j - 1, j)
        ok &= j >= 0
        sums = np.where(ok, there + there[np.maximum(j, 0)], 0)
        best = int(sums.max(initial=0))
        if best <= floor:
            return None
        k = int(np.flatnonzero(sums == best)[np.argmin(np.abs(2 * there[sums == best] - best))])
        return int(there[k]), int(there[j[k]])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left, out, used = _Counts(counts, capacity), Plan(capacity), {}
    while left.there:
        members, room = [], capacity
        while room and (length := left.up_to(room)):
            k = min(room // length, int(left.n[length]))
            left.take(length, k)
            members += [length] * k
            room -= length * k
        while room and len(members) > 1:  # two for the smallest
            small = members[-1]
            if (pair := left.best_pair(room + small, small)) is None:
                break
            members.pop()
            left.give(small)
            for length in sorted(pair, reverse=True):
                left.take(length)
                members.append(length)
            room += small - sum(pair)
            members.sort(reverse=True)
        need: dict[int, int] = {}
        for length in members:
            need[length] = need.get(length, 0) + 1
        copies = 1 + min(int(left.n[length]) // k for length, k in need.items())
        for length, k in need.items():
            if copies > 1:
                left.take(length, (copies - 1) * k)
        out.add(members, copies, used)
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def cut(doc_id: list, text: list) -> dict[str, list]:
        enc = encoder(vocabulary)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for i, t in zip(doc_id, text, strict=True):
            ids = np.append(np.frombuffer(enc.encode(t), enc.dtype), enc.dtype.type(end_id)).astype("<u4")
            for p, at in enumerate(range(0, len(ids), capacity)):
                own = ids[at : at + capacity]
                for k, v in (("doc_id", i), ("piece", p), ("start", at), ("length", len(own)), ("ids_crc32", crc(own)), ("ids", own.tobytes() if keep_ids else None)):
                    out[k].append(v)
        return out

    made = map_batches(texts(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return made if keep_ids else made.drop("ids")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a stored table: it is read three times) with sequence_id and offset."""
    spark = made.sparkSession
    shared = spark.sparkContext.broadcast(plan({r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity))
    n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = made.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    sizes = key.groupBy(F.col("length").alias("_length"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = sizes.select("_length", "_b", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_b")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = key.withColumn("_own", own).join(before, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select(*made.columns, (F.col("_own") + F.col("_before")).alias("_rank"))

    def place(*cols: list) -> dict[str, list]:
        got = dict(zip(names, cols, strict=True))
        entries, sequence, offset = shared.value.by_length, [], []
        for length, rank in zip(got["length"], got.pop("_rank"), strict=True):
            own = entries[length]
            first, slots, bin_, places = own[bisect.bisect_right(own, rank, key=lambda e: e[0]) - 1]
            sequence.append(bin_ + (rank - first) // slots)
            offset.append(places[(rank - first) % slots])
        return got | {"sequence_id": sequence, "offset": offset}

    names = ranked.columns
    schema = made.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return map_batches(ranked, place, f"{schema},sequence_id:long,offset:long", text="ids")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table(pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces"), capacity)


def op2(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
