"""Geo tracks: coverage, gaps, resampling, speed, bearing, velocity. Times are microseconds since the epoch.

A track is track_id, t, lat, lon, ele, speed and `ord`, an ordinal that decides between equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, fraction, haversine_m, lerp
from .asof import bracket, grid

GAP_S, FULL_PCT = 5.0, 90.0


def by_time():
    return Window.partitionBy("track_id").orderBy("t", "ord")



def steps(track: DataFrame) -> DataFrame:
    """Each point with dt_s to the next one."""
    return track.withColumn("next_t", F.lead("t").over(by_time())).withColumn("dt_s", (F.col("next_t") - F.col("t")) / 1e6)


def gaps(track: DataFrame, longer_than_s: float = GAP_S) -> DataFrame:
    """track_id, start, end, duration_s of every step longer than the limit."""
    return steps(track).where(F.col("dt_s") > longer_than_s).select("track_id", F.col("t").alias("start"), F.col("next_t").alias("end"), F.col("dt_s").alias("duration_s"))


def coverage(track: DataFrame, windows: DataFrame, longer_than_s: float = GAP_S) -> DataFrame:
    """How well each track covers its window (windows: track_id, start, duration_s). One shuffle of the points.

    A window without track has overlap 0 and offset 0; a null start or duration gives a null report.
    """
    w = windows.select("track_id", F.col("start").alias("_s"), F.col("duration_s").alias("_d"))
    joined = steps(track).join(w, "track_id", "right")
    end = F.col("_s") + F.rint(F.col("_d") * 1e6).cast("long")
    gap = F.when(F.col("dt_s") > longer_than_s, F.struct(F.timestamp_micros("t").alias("start"), F.timestamp_micros("next_t").alias("end"), F.col("dt_s").alias("duration_s")))
    got = joined.groupBy("track_id", "_s", "_d").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("t").between(F.col("_s"), end)).alias("n"), F.array_sort(F.collect_list(gap)).alias("gaps"))
    overlap = F.greatest(F.lit(0.0), (F.least(end, F.col("last")) - F.greatest(F.col("_s"), F.col("first"))) / 1e6)
    known = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    overlap = F.when(F.col("first").isNull(), F.lit(0.0)).otherwise(overlap)
    pct = F.when(F.col("_d") > 0, overlap / F.col("_d") * 100).otherwise(F.lit(0.0))
    offset = F.when(F.col("first").isNull() | (pct >= FULL_PCT), F.lit(0.0)).otherwise((F.col("first") - F.col("_s")) / 1e6)
    return got.select("track_id", *(F.when(known, c).alias(n) for n, c in (("overlap_s", overlap), ("coverage_pct", pct), ("gaps_gt_5s", F.col("gaps")), ("n_points_in_window", F.col("n")), ("suggested_offset_s", offset))))


def resample(track: DataFrame, windows: DataFrame, rate_hz: float = 1.0, offset_s: float = 0.0) -> DataFrame:
    """The track on a regular grid: track_id, i, t_rel, t, lat, lon, ele, speed.

    Tick i is labelled start + i / rate, its position is read offset_s later; outside the track the position is
    held. ele is null unless both neighbours have one. Speed comes from the previous tick; the first tick takes
    the second's.
    """
    ticks = grid(windows, "track_id", "start", F.col("duration_s"), F.lit(rate_hz)).withColumn("at", F.col("tick") + F.lit(round(offset_s * 1e6)))
    points = track.select("track_id", "t", "ord", "lat", "lon", "ele", (F.row_number().over(by_time()) == 1).alias("first"))
    found = bracket(ticks, points, "track_id", "at", "t", "ord")
    # a is held before (and at) the first point, and from the last one on, where a and b are one point
    alone = (F.col("a.t") == F.col("b.t")) & (F.col("a.ord") == F.col("b.ord"))
    held = alone | F.col("a.first") & (F.col("at") <= F.col("a.t"))
    f = F.when(held, F.lit(0.0)).otherwise(fraction(F.col("at"), F.col("a.t"), F.col("b.t")))
    ele = F.when(held, F.col("a.ele")).otherwise(lerp(F.col("a.ele"), F.col("b.ele"), f))
    got = found.select("track_id", "i", "t_rel", F.col("tick").alias("t"), lerp(F.col("a.lat"), F.col("b.lat"), f).alias("lat"), lerp(F.col("a.lon"), F.col("b.lon"), f).alias("lon"), ele.alias("ele"))
    return with_speed(got)


def with_speed(ticks: DataFrame) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("i")
    before = lambda c: F.lag(c).over(w)
    dt = F.col("t_rel") - before("t_rel")
    raw = F.when(dt > 0, haversine_m(before("lat"), before("lon"), F.col("lat"), F.col("lon")) / dt)
    got = ticks.withColumn("_v", raw)
    return got.withColumn("speed", F.when(F.row_number().over(w) == 1, F.coalesce("_v", F.lead("_v").over(w))).otherwise(F.col("_v"))).drop("_v")


def _neighbour(c: str, w) -> tuple[Column, Column]:
    """The pair a movement is read from: this row and the next one, at the end the one before and this row."""
    last = F.lead("i").over(w).isNull()
    return F.when(last, F.lag(c).over(w)).otherwise(F.col(c)), F.when(last, F.col(c)).otherwise(F.lead(c).over(w))


def velocity(ticks: DataFrame, dt_s: float = 1.0) -> DataFrame:
    """Adds bearing, vel_e, vel_n, vel_up; zero where a track stands still, has one row, or no elevation."""
    w = Window.partitionBy("track_id").orderBy("i")
    (la, lb), (oa, ob), (ea, eb) = (_neighbour(c, w) for c in ("lat", "lon", "ele"))
    got = ticks.withColumns({"_la": la, "_lb": lb, "_oa": oa, "_ob": ob, "_ea": ea, "_eb": eb})
    c = F.col
    moves = ((c("_la") != c("_lb")) | (c("_oa") != c("_ob"))) & (F.coalesce("speed", F.lit(0.0)) != 0)
    got = got.withColumn("bearing", F.when(moves, bearing_deg(c("_la"), c("_oa"), c("_lb"), c("_ob"))))
    part = lambda f: F.coalesce(c("speed") * f(F.radians("bearing")), F.lit(0.0))
    up = F.coalesce((c("_eb") - c("_ea")) / dt_s, F.lit(0.0)) if dt_s > 0 else F.lit(0.0)
    return got.withColumns({"vel_e": part(F.sin), "vel_n": part(F.cos), "vel_up": up}).drop("_la", "_lb", "_oa", "_ob", "_ea", "_eb")
