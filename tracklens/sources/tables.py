"""Track, orientation, calibration and probe files as tables."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.media import rational
from ..schemas import CALIBRATION, IMU_FRAME, IMU_RATE


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


@udtf(returnType="ord int, time string, lat double, lon double, ele double, speed double, error string")
class GpxPoints:
    """LATERAL gpx_points(content): every trkpt at any depth and in any namespace; a broken file is one row with `error`."""

    def eval(self, content: bytes):
        n = 0
        try:
            for _, e in ET.iterparse(io.BytesIO(content or b"")):
                if _local(e.tag) != "trkpt":
                    continue
                lat, lon = e.get("lat"), e.get("lon")
                found = {"time": None, "ele": None, "speed": None}
                for c in e:
                    name = _local(c.tag)
                    for x in c.iter() if name == "extensions" else [c]:
                        if _local(x.tag) in (("speed",) if name == "extensions" else found) and x.text:
                            found[_local(x.tag)] = x.text.strip()
                if lat is not None and lon is not None and found["time"]:
                    yield n, found["time"], float(lat), float(lon), *(float(found[k]) if found[k] else None for k in ("ele", "speed")), None
                    n += 1
        except (ET.ParseError, ValueError) as exc:
            yield n, None, None, None, None, None, str(exc)


def iso_time(c: Column) -> Column:
    """ISO 8601 to a timestamp; without an offset it is UTC; null where it cannot be read."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def read_gpx(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """scan_gpx of the files at path."""
    return scan_gpx(spark.read.format("binaryFile").load(path).select("path", "content"), strict)


def scan_gpx(files: DataFrame, strict: bool = True) -> DataFrame:
    """track_id (the path), ord, t, lat, lon, ele, speed of files (path, content). strict: a broken file or time raises; else its points go."""
    spark = files.sparkSession
    spark.udtf.register("gpx_points", GpxPoints)
    got = spark.sql("SELECT path AS track_id, p.* FROM {files}, LATERAL gpx_points(content) AS p", files=files)
    t = iso_time(F.col("time"))
    if strict:
        t = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid GPX: "), "error")).cast("timestamp")).when(t.isNull(), F.raise_error(F.concat(F.lit("invalid time: "), F.coalesce("time", F.lit("")))).cast("timestamp")).otherwise(t)
    return got.select("track_id", "ord", t.alias("t"), "lat", "lon", "ele", "speed").where("t IS NOT NULL")


def read_imu_frames(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame orientations, with clip. shutter_raw is hex text and never inferred as a number."""
    return spark.read.csv(path, schema=IMU_FRAME, header=True, mode="PERMISSIVE").withColumn("clip", F.col("_metadata.file_path"))


def read_imu_rate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=IMU_RATE, header=True, mode="PERMISSIVE").withColumn("clip", F.col("_metadata.file_path"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibrations with at least one lens; unreadable files give no row."""
    return spark.read.json(path, schema=CALIBRATION, multiLine=True, mode="PERMISSIVE").withColumn("clip", F.col("_metadata.file_path")).where(F.size("lenses") > 0)


PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,r_frame_rate:string,avg_frame_rate:string,tags:map<string,string>>>, format struct<duration:string,size:string,tags:map<string,string>>"


def probe(documents: DataFrame, column: str = "probe") -> DataFrame:
    """The other columns and duration_s, fps, width, height, creation_time, size_bytes, audio, thumbnail from probe JSON.

    The first video stream counts; duration and time fall back from the container to it; null without one.
    """
    got = documents.withColumn("_p", F.from_json(column, PROBE)).withColumn("_v", F.get(F.filter("_p.streams", lambda s: s.getField("codec_type") == "video"), F.lit(0)))
    rate = rational(F.col("_v.r_frame_rate"))
    last = F.try_element_at(F.col("_p.streams"), F.lit(-1))
    return got.select(
        *(c for c in documents.columns if c != column),
        F.coalesce(F.col("_p.format.duration").try_cast("double"), F.col("_v.duration").try_cast("double")).alias("duration_s"),
        F.when(rate > 0, rate).otherwise(rational(F.col("_v.avg_frame_rate"))).alias("fps"),
        F.col("_v.width").alias("width"), F.col("_v.height").alias("height"),
        F.coalesce(iso_time(F.col("_p.format.tags")["creation_time"]), iso_time(F.col("_v.tags")["creation_time"])).alias("creation_time"),
        F.col("_p.format.size").try_cast("long").alias("size_bytes"),
        F.exists("_p.streams", lambda s: s.getField("codec_type") == "audio").alias("audio"),
        ((last.getField("codec_type") == "video") & (last.getField("codec_name") == "mjpeg")).alias("thumbnail"),
    )


def list_files(spark: SparkSession, *globs: str) -> DataFrame:
    """path, name, size_bytes, mtime of files, without reading them."""
    got = spark.read.format("binaryFile").load(list(globs)).select("path", "length", "modificationTime")
    return got.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("_us")).select("path", "name", "size_bytes", (F.col("_us") / 1e6).alias("mtime"))
