"""Timed-metadata packets of a resampled track: ticks, durations, runs, packet fields."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMESCALE = 90_000
#: Horizontal, vertical and speed accuracy of a packet; its layout (reserved, type, fields).
H_ACC, V_ACC, SPEED_ACC = 5.0, 8.0, 1.0
LAYOUT, TYPE, SIZE = "<HHdiddfffffff", 6, 60


def ticks(samples: DataFrame, seconds: str = "t_rel", by: str = "track_id", order: str = "i", timescale: int = TIMESCALE) -> DataFrame:
    """Adds `tick`, strictly increasing: t'_i = i + max over j <= i of (t_j - j)."""
    w = Window.partitionBy(by).orderBy(order)
    got = samples.withColumn("_n", F.row_number().over(w).cast("long")).withColumn("_raw", F.greatest(F.lit(0).cast("long"), F.rint(F.col(seconds) * timescale).cast("long")))
    return got.withColumn("tick", F.col("_n") + F.max(F.col("_raw") - F.col("_n")).over(w)).drop("_n", "_raw")


def durations(samples: DataFrame, by: str = "track_id", order: str = "i", timescale: int = TIMESCALE) -> DataFrame:
    """Adds `duration` to the next tick; the last repeats its predecessor, a single one lasts a second."""
    w = Window.partitionBy(by).orderBy(order)
    here = F.lead("tick").over(w) - F.col("tick")
    before = F.col("tick") - F.lag("tick").over(w)
    return samples.withColumn("duration", F.coalesce(here, before, F.lit(timescale).cast("long")))


def runs(samples: DataFrame, value: str = "duration", by: str = "track_id", order: str = "i") -> DataFrame:
    """Run-length code: by, run (from 0), cnt, value."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(value).over(w).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    got = samples.withColumn("_change", change).withColumn("run", (F.sum("_change").over(w) - 1).cast("long"))
    return got.groupBy(by, "run").agg(F.count("*").alias("cnt"), F.min(value).alias(value))


def pts(run_table: DataFrame, by: str = "track_id") -> DataFrame:
    """Back from runs to samples: by, sample (from 0), pts, the sum of durations before."""
    each = run_table.select(by, "run", "duration", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt"))).alias("_k"))
    w = Window.partitionBy(by).orderBy("run", "_k")
    return each.select(by, (F.row_number().over(w).cast("long") - 1).alias("sample"), (F.sum("duration").over(w) - F.col("duration")).alias("pts"))


def packet_fields(ticks_: DataFrame, *keep: str) -> DataFrame:
    """The fields of one packet a tick (t in microseconds), and the columns to keep."""
    return ticks_.select("track_id", "i", *keep, (F.col("t") / 1e6).alias("epoch"), F.when(F.col("ele").isNotNull(), 3).otherwise(2).alias("fix_type"), "lat", "lon", F.coalesce("ele", F.lit(0.0)).alias("alt"),
                         F.lit(H_ACC).alias("h_acc"), F.lit(V_ACC).alias("v_acc"), "vel_e", "vel_n", "vel_up", F.lit(SPEED_ACC).alias("speed_acc"))


FIELDS = ["epoch", "fix_type", "lat", "lon", "alt", "h_acc", "v_acc", "vel_e", "vel_n", "vel_up", "speed_acc"]


def _pack(epoch: pd.Series, fix: pd.Series, lat: pd.Series, lon: pd.Series, alt: pd.Series, h: pd.Series, v: pd.Series, e: pd.Series, n: pd.Series, up: pd.Series, acc: pd.Series) -> pd.Series:
    make = struct.Struct(LAYOUT).pack
    return pd.Series([make(0, TYPE, *row) for row in zip(epoch, fix.astype(int), lat, lon, alt, h, v, e, n, up, acc, strict=True)])


def packets(fields: DataFrame, *keep: str) -> DataFrame:
    """track_id, i, the columns to keep, packet (60 bytes)."""
    return fields.select("track_id", "i", *keep, F.pandas_udf(_pack, "binary")(*FIELDS).alias("packet"))


def unpack(packets_: DataFrame, column: str = "packet") -> DataFrame:
    """The fields of each packet, read back; other sizes or types give nulls."""

    @F.pandas_udf("epoch double, fix_type int, lat double, lon double, alt double, h_acc double, v_acc double, vel_e double, vel_n double, vel_up double, speed_acc double")
    def read(raw: pd.Series) -> pd.DataFrame:
        take = struct.Struct(LAYOUT).unpack
        rows = [take(bytes(b))[2:] if b is not None and len(b) == SIZE and int.from_bytes(b[2:4], "little") == TYPE else (None,) * len(FIELDS) for b in raw]
        return pd.DataFrame(rows, columns=FIELDS)

    return packets_.withColumn("_f", read(F.col(column))).select(*(c for c in packets_.columns if c != column), "_f.*")
