"""Containers of any size by byte ranges: boxes, samples and chunks of files, without reading whole files.

Spark data sources `mp4_boxes`, `mp4_headers`, `mp4_samples` and `byte_chunks` (register() makes them known) read `path`, a file or a folder on
any file system that Arrow opens. A partition is a list of byte ranges of at most `range_bytes`, so large files are shared
out and small ones packed together. A file of several ranges has tasks of its own, each up to TASK_BYTES and TASK_RANGES, that
take neighbouring ranges as one. A task seeks to box headers, reads the moov box (tables only, no media) once a file
and then only the samples that begin in its ranges. Filters on track_id, codec and seconds are taken before any payload is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .mp4 import CONTAINERS, SAMPLES, BoxError, header, lists, samples, track

#: Bytes of a range, bytes and ranges of a partition, bytes of a chunk.
RANGE, TASK_BYTES, TASK_RANGES, CHUNK = 256 << 20, 256 << 20, 1024, 1 << 20
#: Samples and payload bytes that leave Python at a time.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 32 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class RangedFile:
    """Reads of parts of one file; `read_bytes` counts what was read."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(own)
        self.size, self.read_bytes = self.file.size(), 0

    def at(self, off: int, n: int) -> bytes:
        self.file.seek(off)
        got = self.file.read(n)
        self.read_bytes += len(got)
        return got

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def walk(f: RangedFile, at: int = 0, end: int | None = None, depth: int = 0, parent: int | None = None, levels: int = 1 << 10) -> Iterator[tuple]:
    """(depth, parent offset, type, offset, size, header size) as mp4.boxes(), from reads of 16 bytes a box. levels: how deep to go."""
    end = f.size if end is None else end
    while at < end:
        try:
            head = f.at(at, min(16, end - at))
            typ, size, n = header(head.ljust(16, b"\0") if end - at >= 16 else head, 0, end - at)
        except BoxError:
            return
        yield depth, parent, typ, at, size, n
        if typ in CONTAINERS and depth + 1 < levels:
            yield from walk(f, at + n + 4 * (typ == b"meta"), at + size, depth + 1, at, levels)
        at += size


def tracks(f: RangedFile) -> Iterator[dict]:
    """The trak boxes' sample tables: what lies in moov is read, one track at a time."""
    for depth, _, typ, off, size, head in walk(f, levels=2):
        if depth == 1 and typ == b"trak":
            yield track(f.at(off, size), 0, size, head)


_TABLES = (("sizes", ()), ("chunk_offsets", ()), ("stsc", ("first", "spc", "sdi")), ("stts", ("cnt", "dur")))


def sample_tables(of: list[dict]) -> tuple[np.ndarray, ...]:
    """mp4.samples() of tracks read from a file."""
    return samples(*(lists([t[name] for t in of], fields) for name, fields in _TABLES))


def sample_table(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset, size and time (in the track's units) of each sample; cut off where sizes or chunks end."""
    _, _, _, off, size, pts = sample_tables([t])
    return off, size, pts.data


@dataclass
class Ranges(InputPartition):
    """(path, first byte, end) of each range."""

    ranges: list[tuple[str, int, int]]


def plan(path: str, range_bytes: int) -> list[Ranges]:
    """The byte ranges of all files at path, in partitions of bounded bytes and count. Names of hidden files are left out."""
    from pyarrow import fs

    remote = "://" in path or path.startswith("file:")
    system, own = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)
    info = system.get_file_info(own)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(own, recursive=True))
    prefix = path[: len(path) - len(own)] if remote and path.endswith(own) else "file://" if remote else ""
    out: list[Ranges] = [Ranges([])]
    held = 0
    for x in sorted((x for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
        for lo in range(0, max(x.size, 1), range_bytes):
            hi = min(x.size, lo + range_bytes)
            other = out[-1].ranges and out[-1].ranges[-1][0] != prefix + x.path and (hi - lo == range_bytes or out[-1].ranges[-1][1] > 0)
            if out[-1].ranges and (held + hi - lo > TASK_BYTES or len(out[-1].ranges) >= TASK_RANGES or other):
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append((prefix + x.path, lo, hi))
            held += hi - lo
    return out


def spans(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The ranges with neighbours of one file made one, so that a task reads a file's tables once, not once a range."""
    out: list[tuple[str, int, int]] = []
    for path, lo, hi in ranges:
        if out and out[-1][0] == path and out[-1][2] == lo:
            path, lo, _ = out.pop()
        out.append((path, lo, hi))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.range_bytes = int(options.get("range_bytes", RANGE))

    def partitions(self) -> list[Ranges]:
        return plan(self.options["path"], self.range_bytes)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, lo, hi in spans(partition.ranges):
            with RangedFile(path) as f:
                yield from self.rows(f, path, lo, hi)


class BoxReader(_Reader):
    """All boxes, or those of the first `levels` levels: boxes below are then neither read nor made into rows."""

    def rows(self, f: RangedFile, path: str, lo: int, hi: int) -> Iterator[tuple]:
        if lo == 0:  # headers of one file are few; its first range walks them
            for depth, parent, typ, off, size, head in walk(f, levels=int(self.options.get("levels", 1 << 10))):
                yield path, depth, parent, typ.decode("latin-1"), off, size, head


class ChunkReader(_Reader):
    """Chunks of `chunk_bytes`, of the bytes from `first` to `last` if given."""

    def rows(self, f: RangedFile, path: str, lo: int, hi: int) -> Iterator[tuple]:
        step = int(self.options.get("chunk_bytes", CHUNK))
        first, last = int(self.options.get("first", 0)), min(f.size - 1, int(self.options.get("last", f.size - 1)))
        k = max(0, -((first - lo) // step)) if lo > first else 0
        at = first + k * step
        while at < hi and at <= last:  # a chunk belongs to the range that it begins in
            yield path, k, at, f.at(at, min(step, last + 1 - at))
            k, at = k + 1, at + step


class SampleReader(_Reader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.equal = {k: options[k] for k in ("track_id", "codec") if k in options}
        self.after, self.before = float(options.get("from_s", "-inf")), float(options.get("to_s", "inf"))

    def rows(self, f: RangedFile, path: str, lo: int, hi: int) -> Iterator[tuple]:
        for batch in self.parts(f, path, lo, hi):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def parts(self, f: RangedFile, path: str, lo: int, hi: int) -> Iterator:
        held, n = [], 0
        for k, t in enumerate(tracks(f)):
            if any(str(t[name]) != str(value) for name, value in self.equal.items()):
                continue
            held.append((k, t))
            n += len(t["sizes"]) + len(t["chunk_offsets"]) + 8
            if n > SAMPLES:
                yield from self.batches(f, path, lo, hi, held)
                held, n = [], 0
        if held:
            yield from self.batches(f, path, lo, hi, held)

    def batches(self, f: RangedFile, path: str, lo: int, hi: int, held: list[tuple[int, dict]]) -> Iterator:
        import pyarrow as pa

        payload = self.options.get("payload", "false") == "true"
        of, number, _, off, size, pts = sample_tables([t for _, t in held])
        scale = np.array([t["timescale"] or 0 for _, t in held], np.int64)[of]
        seconds = np.where(scale > 0, pts.data / np.maximum(scale, 1), 0.0)
        kept = np.flatnonzero((off >= lo) & (off < hi) & (seconds >= self.after) & (seconds < self.before))
        column = lambda name, kind: pa.array([t[name] for _, t in held], kind)
        of_track = [pa.array([k for k, _ in held], pa.int32()), column("track_id", pa.int64()), column("codec", pa.string()), column("handler", pa.string())]
        names = ["path", "trak", "track_id", "codec", "handler", "sample", "off", "size", "pts", "seconds", "payload"]
        total, start = np.cumsum(size[kept]), 0
        while start < len(kept):
            end = min(start + BATCH_ROWS, int(np.searchsorted(total, (total[start - 1] if start else 0) + BATCH_BYTES, "right"))) if payload else start + BATCH_ROWS
            i = kept[start : max(end, start + 1)]
            data = [f.at(o, n) for o, n in zip(off[i].tolist(), size[i].tolist(), strict=True)] if payload else [None] * len(i)
            own = pa.array(of[i])
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(i)), *(x.take(own) for x in of_track), *(pa.array(x[i]) for x in (number, off, size, pts.data, seconds)), pa.array(data, pa.binary())], names=names)
            start += len(i)


class PushingSampleReader(SampleReader):
    """Takes equality on track and codec and bounds on seconds; Spark keeps the rest, and bounds that are not of this half-open form."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in ("track_id", "codec") and name not in self.equal:
                self.equal[name] = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "seconds":
                self.after = max(self.after, f.value)
                if isinstance(f, GreaterThan):
                    yield f
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "seconds":
                self.before = min(self.before, f.value if isinstance(f, LessThan) else float(np.nextafter(f.value, np.inf)))
            else:
                yield f


class BatchedSampleReader(SampleReader):
    def read(self, partition: Ranges) -> Iterator:
        """Arrow batches, each of the samples of many tracks worked out at once."""
        for path, lo, hi in spans(partition.ranges):
            with RangedFile(path) as f:
                yield from self.parts(f, path, lo, hi)


class PushingBatchedSampleReader(BatchedSampleReader, PushingSampleReader):
    pass


class HeaderReader(_Reader):
    """The movie header and the first video track, one row a file that has a moov box."""

    def rows(self, f: RangedFile, path: str, lo: int, hi: int) -> Iterator[tuple]:
        from ..sinks.boxes import VIDEO_ENTRIES

        if lo:
            return
        for depth, _, typ, off, size, head in walk(f, levels=1):
            if depth == 0 and typ == b"moov":
                break
        else:
            return
        scale = duration = following = None
        for depth, _, typ, at, n, h in walk(f, off + head, off + size, 1, off, levels=2):
            if depth == 1 and typ == b"mvhd":
                body = f.at(at + h, n - h)
                long = body[0] == 1
                scale, duration = struct.unpack_from(">IQ" if long else ">II", body, 20 if long else 12)
                (following,) = struct.unpack(">I", body[-4:])
        video = next(((k, t["track_id"], t["codec"]) for k, t in enumerate(tracks(f)) if t["handler"] == "vide"), (None, None, None))
        yield path, scale, duration, following, *video, None if video[2] is None else video[2].encode("latin-1") in VIDEO_ENTRIES


class Mp4HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4_headers"

    def schema(self) -> str:
        return "path string, timescale long, duration long, next_track_id long, video_trak int, video_track_id long, entry string, known_entry boolean"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(dict(self.options))


class Mp4BoxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4_boxes"

    def schema(self) -> str:
        return "path string, depth int, parent_off long, typ string, off long, size long, hdr int"

    def reader(self, schema) -> DataSourceReader:
        return BoxReader(dict(self.options))


class ByteChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_chunks"

    def schema(self) -> str:
        return "path string, chunk long, off long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))


class Mp4SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4_samples"

    def schema(self) -> str:
        return "path string, trak int, track_id long, codec string, handler string, sample long, off long, size long, pts long, seconds double, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return (PushingBatchedSampleReader if self.options.get("pushdown") == "true" else BatchedSampleReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    from ..sinks.container import FileSink

    for source in (Mp4BoxSource, Mp4HeaderSource, ByteChunkSource, Mp4SampleSource, FileSink):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    """One of the sources. Filters are pushed where the session allows a Python source to take them."""
    register(spark)
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format(kind).options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}, pushdown=pushed).load(path)


def frames_at(samples: DataFrame, wanted: DataFrame, trak: int = 0) -> DataFrame:
    """For each (path, t) the sample that is shown at t: the last one of the track that begins at or before it, or the first.

    samples: an index of `mp4_samples` without payloads; only the rows found go on to payloads_of().
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    keep = ["sample", "off", "size"]
    own = samples.where(F.col("trak") == trak).select("path", F.col("seconds").alias("t"), F.struct("seconds", *keep).alias("s"), F.lit(0).alias("kind"))
    asked = wanted.select("path", "t", F.lit(None).cast(own.schema["s"].dataType).alias("s"), F.lit(1).alias("kind"))
    w = Window.partitionBy("path").orderBy("t", "kind")
    first = F.first("s", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # from the row on it would be quadratic
    met = own.unionByName(asked).withColumn("s", F.coalesce(F.last("s", True).over(w), first)).where("kind = 1 AND s IS NOT NULL")
    return met.select("path", "t", "s.seconds", *(f"s.{c}" for c in keep))


def payloads_of(hits: DataFrame) -> DataFrame:
    """hits (path, off, size and more) with `payload`, read by range: no other byte of the files is touched."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*hits.schema.fields, T.StructField("payload", T.BinaryType())])

    def run(batches):
        for b in batches:
            paths, offs, sizes = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "off", "size"))
            order = sorted(range(len(paths)), key=lambda k: (paths[k], offs[k]))
            data: list[bytes | None] = [None] * len(paths)
            name, f = None, None
            for k in order:
                if paths[k] != name:
                    if f:
                        f.file.close()
                    name, f = paths[k], RangedFile(paths[k])
                data[k] = f.at(offs[k], sizes[k])
            if f:
                f.file.close()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "payload"])

    return hits.repartition("path").mapInArrow(run, schema)
