"""Orientation series: clock, sign continuity, resampling. Quaternions are structs q(w, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import fraction
from ..functions.rotation import dot, normalized_step, pack_quat, quat, slerp_step
from .asof import bracket


def samples(raw: DataFrame, clip: str = "clip") -> DataFrame:
    """Rows with a whole quaternion, normalised: clip, ord, t, unit, q.

    The clock is timestamp (microseconds, unit `s`) if the clip has one that advances, else frame + subidx / samples
    of the frame (unit `frame`), else the row's number (unit `frame`). The unit is never guessed from values.
    """
    parts = [F.col(f"q{c}").try_cast("double") for c in "wxyz"]
    whole = F.lit(True)
    for p in parts:
        whole &= p.isNotNull() & ~F.isnan(p)
    have = set(raw.columns)
    opt = lambda c, t: F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)
    got = raw.where(whole).select(F.col(clip).alias("clip"), opt("frame", "long").alias("frame"), opt("subidx", "long").alias("subidx"), opt("timestamp", "long").alias("us"), pack_quat(parts).alias("_raw"))
    got = normalized_step(got, "_raw", "q").drop("_raw")
    w = Window.partitionBy("clip")
    order = w.orderBy(F.coalesce("us", F.lit(0).cast("long")), "frame", "subidx")
    got = got.withColumns({"ord": F.row_number().over(order) - 1, "_first": F.min("us").over(w), "_last": F.max("us").over(w), "_all": F.count_if(F.col("us").isNull()).over(w) == 0, "_n": F.count("*").over(Window.partitionBy("clip", "frame"))})
    clock = F.col("_all") & (F.col("_last") > F.col("_first"))
    sub = F.col("frame").isNotNull() & F.col("subidx").isNotNull()
    t = F.when(clock, (F.col("us") - F.col("_first")) * 1e-6).when(sub, F.col("frame") + F.col("subidx") / F.col("_n")).otherwise(F.col("ord").cast("double"))
    return got.select("clip", "ord", t.alias("t"), F.when(clock, "s").otherwise("frame").alias("unit"), "q")


def seconds(series: DataFrame, source_fps: Column | float) -> DataFrame:
    """t in seconds, frames being those of the source."""
    fps = source_fps if isinstance(source_fps, Column) else F.lit(float(source_fps))
    return series.withColumn("t", F.when(F.col("unit") == "frame", F.col("t") / fps).otherwise(F.col("t"))).drop("unit")


def continuous(series: DataFrame) -> DataFrame:
    """Flips signs so that neighbours never have a negative dot product.

    Flips multiply along a segment, so a row's sign is the parity of negative neighbour products since the last
    product of exactly zero, where the fold starts anew with the row as it is.
    """
    w = Window.partitionBy("clip").orderBy("ord")
    now = quat("q")
    before = [F.lag(c).over(w) for c in now]
    got = series.withColumn("_d", dot(before, now))
    got = got.withColumn("_seg", F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).over(w))
    within = Window.partitionBy("clip", "_seg").orderBy("ord")
    flips = F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).over(within)
    sign = F.when(F.pmod(flips, F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return got.withColumn("_sign", sign).withColumn("q", pack_quat([c * F.col("_sign") for c in now])).drop("_d", "_seg", "_sign")


def resample(series: DataFrame, clips: DataFrame) -> DataFrame:
    """One orientation a frame: clip, frame, q. clips: clip, fps, n_frames. Ends are held."""
    ticks = clips.where("n_frames > 0").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("frame"), "fps").withColumn("at", F.col("frame") / F.col("fps"))
    found = bracket(ticks.drop("fps"), series.select("clip", "t", "ord", "q"), "clip", "at", "t", "ord", left_closed=False)
    f = F.when(F.col("at") <= F.col("a.t"), F.lit(0.0)).otherwise(fraction(F.col("at"), F.col("a.t"), F.col("b.t")))
    got = slerp_step(found.select("clip", "frame", f.alias("_f"), F.col("a.q").alias("a"), F.col("b.q").alias("b")), "a", "b", "_f", "_q")
    return got.select("clip", "frame", F.when(F.col("_f") == 0, F.col("a")).otherwise(F.col("_q")).alias("q"))
