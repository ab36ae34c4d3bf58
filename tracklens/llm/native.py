"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side is broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else: lower() where all is ASCII, which is much faster than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def alnum_words(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def small(df, n_rows: int, row_bytes: int):
    """df, broadcast if its measured size allows it."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


# blocked Bloom filter: a key sets one bit in each of the four longs of one 256-bit block

BITS_PER_KEY, BLOCK_BITS = 16, 256


def bloom_blocks(n_keys: int) -> int:
    """Blocks of a filter for n_keys, within BROADCAST_BYTES. Beyond that it passes more and still loses nothing."""
    return max(1, min(-(-n_keys * BITS_PER_KEY // BLOCK_BITS), BROADCAST_BYTES // 64))


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit("bit"))
    return [F.shiftrightunsigned(second, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(4)]


def bloom(keys, column: str, n_blocks: int):
    """_block and its four longs."""
    one, key = F.lit(1).cast("long"), F.col(column)
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("_block"), *(F.call_function("shiftleft", one, b).alias(f"_w{j}") for j, b in enumerate(_bits(key))))
    return bits.groupBy("_block").agg(*(F.bit_or(f"_w{j}").alias(f"_w{j}") for j in range(4)))


def possible_hits(rows, column: str, filter_, n_blocks: int):
    """rows with _maybe: whether the filter has all of a key's bits. The filter's size is bounded by bloom_blocks."""
    key = F.col(column)
    probed = rows.withColumn("_at", F.pmod(F.xxhash64(key), F.lit(n_blocks))).join(small(filter_, n_blocks, 64), F.col("_at") == F.col("_block"), "left")
    found = F.lit(True)
    for j, b in enumerate(_bits(key)):
        found &= F.call_function("getbit", F.coalesce(F.col(f"_w{j}"), F.lit(0).cast("long")), b) == 1
    return probed.withColumn("_maybe", found).drop("_at", "_block", *(f"_w{j}" for j in range(4)))


#: Rows of one key that a join leaves together.
SPLIT = 256


def heavy_keys(rows, keys: list[str], n=None):
    """The keys of more than SPLIT rows and into how many parts they go: _parts. n: the count, where a column has it already."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if n is None else rows.select(*keys, F.col(n).alias("_n"))
    return counts.where(F.col("_n") > SPLIT).select(*keys, F.ceil(F.col("_n") / SPLIT).cast("int").alias("_parts"))


def spread_join(rows, lookup, keys: list[str], by: str, heavy, how: str = "inner"):
    """rows join lookup on keys of which a few may have very many rows: those are dealt by the hash of `by` to parts,
    and lookup's row is copied to each part. heavy: stored heavy_keys(rows), which has at most rows / SPLIT rows.
    """
    n = heavy.count()
    if not n:
        return rows.join(lookup, keys, how)
    parts = small(heavy.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)), "_parts"), n, 64)

    def with_parts(df):
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= df[k] == F.col(f"_h{i}")
        return df.join(parts, same, "left").drop(*(f"_h{i}" for i in range(len(keys))))

    left = with_parts(rows).withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = with_parts(lookup).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")
