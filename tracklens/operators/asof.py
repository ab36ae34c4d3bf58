"""As-of interpolation without a range join: one shuffle by key, one sort, two window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(ticks: DataFrame, points: DataFrame, by: str, tick: str, time: str, tie: str, left_closed: bool = True) -> DataFrame:
    """Every tick with `a` and `b`, the points around it (structs of all columns of points).

    left_closed: a.time <= tick < b.time (of equal times the last point by `tie` is a); else a.time < tick <= b.time.
    Before the first point both are the first, after the last both the last: values are held outside the track.
    Ticks of keys without points go.
    """
    cols = [c for c in points.columns if c != by]
    order = Window.partitionBy(by).orderBy(time, tie)
    here = F.struct(*cols)
    seg = points.select(by, F.col(time).alias("_t"), F.col(tie).cast("long").alias("_tie"), F.struct(here.alias("a"), F.coalesce(F.lead(here).over(order), here).alias("b")).alias("_seg"), F.lit(None).cast("boolean").alias("_tick"))
    extra = [c for c in ticks.columns if c != by]
    own = ticks.select(by, F.col(tick).alias("_t"), F.lit(None).cast("long").alias("_tie"), F.lit(True).alias("_tick"), F.struct(*extra).alias("_own"))
    both = seg.withColumn("_own", F.lit(None).cast(own.schema["_own"].dataType)).unionByName(own.withColumn("_seg", F.lit(None).cast(seg.schema["_seg"].dataType)))
    side = F.when(F.col("_tick").isNotNull(), 1 if left_closed else 0).otherwise(0 if left_closed else 1)
    w = Window.partitionBy(by).orderBy("_t", side, F.col("_tie"))
    past = F.last("_seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a tick without a point before it is before the first one; a frame that begins at the row would be read to its end for each row
    nxt = F.first("_seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = both.withColumn("_past", past).withColumn("_next", nxt).where("_tick AND (_past IS NOT NULL OR _next IS NOT NULL)")
    return found.select(by, "_own.*", F.coalesce("_past.a", "_next.a").alias("a"), F.coalesce("_past.b", "_next.a").alias("b"))


def grid(windows: DataFrame, by: str, start: str, duration_s: Column, rate_hz: Column) -> DataFrame:
    """One tick i for each i / rate within the duration: by, i, t_rel (seconds), tick (microseconds)."""
    n = F.greatest(F.lit(1), F.floor(duration_s * rate_hz) + 1)
    ok = windows.where((duration_s > 0) & (rate_hz > 0)).select(by, F.col(start).alias("_start"), duration_s.alias("_d"), rate_hz.alias("_r"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i"))
    t_rel = F.least(F.col("i") / F.col("_r"), F.col("_d"))
    return ok.select(by, "i", t_rel.alias("t_rel"), (F.col("_start") + F.rint(t_rel * 1e6).cast("long")).alias("tick"))
