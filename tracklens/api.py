"""One entry a task: what an application asks for, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import media
from .operators import camm, catalog, imu, progress, remap, stabilize, track
from .sources import mp4, protobuf, tables


def list_media(spark: SparkSession, base: str) -> DataFrame:
    """Camera files in a folder and its direct sub-folders."""
    found = tables.list_files(spark, f"{base}/*", f"{base}/*/*")
    return found.where(media.extension(F.col("name")) == ".osv")


browse, shortcuts = catalog.browse, catalog.first_by
probe = tables.probe
job_status, plan_jobs, conversion_plan = catalog.latest, catalog.plan_jobs, catalog.conversion_plan
progress_estimates = progress.estimates


def load_track(spark: SparkSession, path: str) -> DataFrame:
    """A track file in the operators' form (t in microseconds)."""
    return tables.read_gpx(spark, path).withColumn("t", F.unix_micros("t"))


def track_coverage(points: DataFrame, windows: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """Coverage of each window, the window moved by offset_s."""
    return track.coverage(points, windows.withColumn("start", F.col("start") + F.lit(round(offset_s * 1e6))))


def track_packets(points: DataFrame, windows: DataFrame, rate_hz: float = 1.0, offset_s: float = 0.0) -> DataFrame:
    """track_id, i, tick, duration, packet: what a metadata track holds."""
    ticks = camm.durations(camm.ticks(track.velocity(track.resample(points, windows, rate_hz, offset_s), 1 / rate_hz)))
    return camm.packets(camm.packet_fields(ticks, "tick", "duration"), "tick", "duration")


def frame_corrections(rate: DataFrame, frames: DataFrame, clips: DataFrame, source_fps: float, **options) -> DataFrame:
    """Corrections from high-rate samples, of clips without any from per-frame samples; has_imu tells whether there were some."""
    high = imu.seconds(imu.samples(rate), source_fps)
    low = imu.seconds(imu.samples(frames), source_fps).join(high.select("clip").distinct(), "clip", "left_anti")
    series = imu.continuous(high.unionByName(low))
    got = stabilize.corrections(imu.resample(series, clips), **options)
    return clips.select("clip").join(got, "clip", "left").withColumn("has_imu", F.col("frame").isNotNull())


def extract_metadata(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with high-rate orientations, calibrations) of camera files (path, content)."""
    tracks = mp4.read_tracks(files)
    samples = mp4.expand_samples(tracks, ["path", "trak"])
    chosen = samples.join(mp4.metadata_track(tracks, samples), ["path", "trak"])
    payloads = mp4.payloads(files, chosen).select("path", "sample", "payload")
    return protobuf.decode_frames(payloads), protobuf.decode_calibration(payloads.where("sample = 0"))


def reproject(spark: SparkSession, image: DataFrame, src_w: int, src_h: int, projection: str, width: int, height: int, **view) -> DataFrame:
    """Pixels of a view of an equirect image."""
    return remap.sample(remap.view(spark, projection, width, height, **view), image, src_w, src_h)


def byte_range(files: DataFrame, header: str | None) -> DataFrame:
    """path, status, first, last and bytes of a Range request for each file (path, content)."""
    size = F.length("content").cast("long")
    status, first, last = media.byte_range(F.lit(header).cast("string"), size)
    got = files.withColumns({"status": status, "first": first, "last": last})
    return got.select("path", "status", "first", "last", F.substr("content", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int")).alias("bytes"))
