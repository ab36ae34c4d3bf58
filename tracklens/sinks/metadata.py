"""Decoded clip metadata as text files: calibration JSON, frames and high-rate orientations as CSV, a folder a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The headers that readers of these files expect, with the columns they come from.
FRAME_HEADER = {"frame": "frame", "timestamp": "timestamp", "qw": "qw", "qx": "qx", "qy": "qy", "qz": "qz", "ax_g": "ax_g", "ay_g": "ay_g", "az_g": "az_g", "iso": "iso", "shutter_raw": "shutter_raw", "color_temp_K": "color_temp_K", "sensor_temp_C": "sensor_temp_C"}
RATE_HEADER = ["frame", "subidx", "qw", "qx", "qy", "qz"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by clip in as many partitions as the session shuffles to. The number is named, as Spark else joins partitions of few
    bytes, and a task then makes the files of all clips one by one: here files cost, not bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip")


def _csv(rows: DataFrame, columns: list, order: list[str], path: str) -> None:
    # a clip's rows are one sorted file; clips are independent
    _dealt(rows.select("clip", *columns)).sortWithinPartitions("clip", *order).write.mode("overwrite").partitionBy("clip").option("header", True).csv(path)


def write_metadata(root: str, frames: DataFrame | None = None, rates: DataFrame | None = None, calibrations: DataFrame | None = None) -> None:
    """Writes root/imu_perframe, root/imu_highrate and root/calibration, each with a folder clip=... a clip.

    frames: clip and the columns of FRAME_HEADER, absent ones are left empty. rates: clip and RATE_HEADER.
    calibrations: clip and lenses, a row a clip. Null values are empty fields; rows without clip go to Spark's default
    partition; a table without rows writes no file.
    """
    if frames is not None:
        have = set(frames.columns)
        _csv(frames, [(F.col(c) if c in have else F.lit(None).cast("string")).alias(name) for name, c in FRAME_HEADER.items()], ["frame", "timestamp"], f"{root}/imu_perframe")
    if rates is not None:
        _csv(rates, RATE_HEADER, ["frame", "subidx"], f"{root}/imu_highrate")
    if calibrations is not None:
        _dealt(calibrations).write.mode("overwrite").partitionBy("clip").json(f"{root}/calibration")


def clip_of(path) -> object:
    """The clip of a file's path in such a folder."""
    return F.url_decode(F.regexp_extract(path, r"/clip=([^/]+)/", 1))
