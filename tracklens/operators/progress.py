"""Progress lines `key=value`, closed by `progress=`, as blocks and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import eta_s, out_time_s, progress, speed_factor


def pairs(lines: DataFrame, *more: str) -> DataFrame:
    """job, seq, k, v from job, seq, line; k is null for a line without `=`."""
    text = F.trim("line")
    has = text.contains("=")
    return lines.select("job", "seq", F.when(has, F.trim(F.substring_index(text, "=", 1))).alias("k"), F.when(has, F.expr("substring(trim(line), instr(trim(line), '=') + 1)")).alias("v"), *more)


def blocks(lines: DataFrame) -> DataFrame:
    """job, block, kv (last value of a key wins), from job, seq, line. Lines without `=` are skipped; an open block is not shown."""
    got = pairs(lines).where("k IS NOT NULL")
    w = Window.partitionBy("job").orderBy("seq")
    got = got.withColumn("block", F.sum(F.when(F.col("k") == "progress", 1).otherwise(0)).over(w) - F.when(F.col("k") == "progress", 1).otherwise(0))
    last = got.groupBy("job", "block", "k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
    return last.groupBy("job", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("kv"), F.max("seq").alias("seq")).where(F.map_contains_key("kv", F.lit("progress")))


def estimates(blocks_: DataFrame, jobs: DataFrame, base: float = 0.0, span: float = 1.0) -> DataFrame:
    """job, block, progress, fps, eta_s. jobs: job, duration_s and elapsed_s (for blocks without a speed)."""
    got = blocks_.join(jobs, "job").withColumn("_out", out_time_s(F.col("kv")))
    speed = speed_factor(F.try_element_at("kv", F.lit("speed")))
    return got.select("job", "block", progress(F.col("_out"), F.col("duration_s"), base, span).alias("progress"), F.try_element_at("kv", F.lit("fps")).try_cast("double").alias("fps"), eta_s(F.col("_out"), F.col("duration_s"), speed, F.col("elapsed_s")).alias("eta_s"))
