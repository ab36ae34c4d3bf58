"""Containers written from rows: a data source sink that puts files together from parts and publishes them at the end of the job.

Rows are (name, part, bytes, source, off, size): a part is given as bytes or as a range of another file, which is copied by range.
write_files() brings the parts of a file to one task, in order. Tasks write under a folder of the job's own; the commit
moves whole files to their names, and a job that fails removes its folder, so no reader ever sees a part of a file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from ..operators import camm

PARTS = "name string, part long, bytes binary, source string, off long, size long"
#: Bytes copied at a time.
COPY = 4 << 20
#: Places of the packets and of moov among a file's parts.
PACKETS, MOOV = 1 << 40, 1 << 41


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, name) of the files of a task."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    @staticmethod
    def _system(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator) -> Written:
        from ..sources.ranged import RangedFile

        system, own = self._system(self.staging)
        folder = f"{own}/{uuid.uuid4().hex}"  # a repeated attempt has a folder of its own
        system.create_dir(folder, recursive=True)
        out, name, files, seen = None, None, [], set()
        try:
            for batch in iterator:
                columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "bytes", "source", "off", "size"))
                for row_name, data, source, off, size in zip(*columns, strict=True):
                    if row_name != name or out is None:
                        if out is not None:
                            out.close()
                        name = row_name
                        if name in seen or not name or ".." in name.split("/") or name.startswith("/"):
                            raise ValueError(f"no file name, or parts of it out of order: {name!r}")
                        seen.add(name)
                        files.append((f"{folder}/{len(files)}", name))
                        out = system.open_output_stream(files[-1][0], buffer_size=1 << 20)
                    if data is not None:
                        out.write(data)
                    elif source is not None:
                        with RangedFile(source) as f:
                            for at in range(off, off + size, COPY):
                                got = f.at(at, min(COPY, off + size - at))
                                out.write(got)
                            if size and at + len(got) != off + size:
                                raise ValueError(f"{source} ends before {off + size}")
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, own = self._system(self.path)
        done = [x for m in messages if m is not None for x in m.files]
        names = [n for _, n in done]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("parts of one file came to several tasks")
        for folder in sorted({n.rpartition("/")[0] for n in names} - {""}):
            system.create_dir(f"{own}/{folder}", recursive=True)
        for temporary, name in done:
            system.move(temporary, f"{own}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, own = self._system(self.staging)
        system.delete_dir_contents(own, missing_dir_ok=True)
        if system.get_file_info(own).type.name != "NotFound":
            system.delete_dir(own)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return PARTS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


def write_files(parts: DataFrame, path: str) -> None:
    """Files at path/name from their parts in order of `part`. A file of equal name is replaced."""
    from ..sources.ranged import register

    register(parts.sparkSession)
    have = set(parts.columns)
    types = {"bytes": "binary", "source": "string", "off": "long", "size": "long"}
    own = parts.select("name", F.col("part").cast("long").alias("part"), *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types.items()))
    own.repartition("name").sortWithinPartitions("name", "part").write.format("file_parts").mode("append").save(path)


def muxed(files: DataFrame, packets: DataFrame | None = None, spherical: bool = False) -> DataFrame:
    """Parts (for write_files) of files (path, name) with a track of packets (path, i, packet, duration) and spherical boxes.

    Media and tracks that do not change stay where they are and are copied by range when written; moov is put at the end, its
    chunk offsets moved, a track at a time, if it stood before media. Packets (60 bytes each) are parts of their own and never
    held together: what a task holds of a file is one track and the runs of the durations.
    """
    own, steps = files.select("path", "name"), "array<struct<run:bigint,cnt:bigint,duration:bigint>>"
    if packets is None:
        joined = own.withColumn("steps", F.lit(None).cast(steps))
    else:
        w = Window.partitionBy("path").orderBy("i", "packet", "duration")
        given = packets.select("path", F.col("i").cast("long").alias("i"), "packet", F.col("duration").cast("long").alias("duration"))
        rows = given.withColumn("n", F.row_number().over(w).cast("long"))
        timed = camm.runs(rows.select("path", "n", "duration"), by="path", order="n").groupBy("path")
        joined = own.join(timed.agg(F.sort_array(F.collect_list(F.struct("run", "cnt", "duration"))).cast(steps).alias("steps")), "path", "left")
        packet = F.when(F.length("packet") == camm.SIZE, F.col("packet")).otherwise(F.raise_error(F.lit(f"a packet has {camm.SIZE} bytes")).cast("binary"))
        moved = rows.join(own, "path").select("name", (F.col("n") + PACKETS).alias("part"), packet.alias("bytes"), *(F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("off", "long"), ("size", "long"))))

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in PARTS.split(", ")]
        types = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for k in range(batch.num_rows):
                path, name, timing = (batch.column(batch.schema.get_field_index(c))[k] for c in ("path", "name", "steps"))
                held, parts = 0, []
                for part in _remade(path.as_py(), timing.values if timing.is_valid else None, spherical):
                    parts.append((name.as_py(), *part))
                    held += len(part[1] or b"")
                    if held > COPY:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)
                        held, parts = 0, []
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    made = joined.mapInArrow(run, PARTS)
    return made if packets is None else made.unionByName(moved)


def _remade(path: str, timing, spherical: bool):
    """(part, bytes, source, off, size) of a file with moov at its end, without the packets themselves."""
    from ..sources.mp4 import BoxError
    from ..sources.ranged import RangedFile, walk
    from .boxes import Tree, _move_chunks, head, packet_track, spherical_track

    with RangedFile(path) as f:
        tops = [(typ, off, size, n) for _, _, typ, off, size, n in walk(f, levels=1)]
        place = next(((off, size, n) for typ, off, size, n in tops if typ == b"moov"), None)
        if place is None:
            raise BoxError(f"{path} has no moov box")
        at, size, n = place
        kept = [(off, length) for _, off, length, _ in tops if off != at]
        for k, (off, length) in enumerate(kept):
            yield k, None, path, off, length
        inside = [(typ, off, length) for _, _, typ, off, length, _ in walk(f, at + n, at + size, 1, at, levels=2)]
        if sum(length for *_, length in inside) < size - n - 8 * len(inside) - 16:
            raise BoxError("the file does not end with a whole box")
        mvhd = next((x for x in inside if x[0] == b"mvhd"), None)
        small = Tree(b"moov", b"", children=Tree.parse(f.at(*mvhd[1:])) if mvhd else [])
        if timing is not None:
            counts, lasting = (timing.field(c).to_numpy(zero_copy_only=False) for c in ("cnt", "duration"))
            yield PACKETS, packet_track(small, sum(length for _, length in kept), int(counts.sum()), camm.SIZE, counts, lasting), None, None, None
        behind, wanted, total, same = any(off > at for off, _ in kept), spherical, 0, None
        for k, (typ, off, length) in enumerate(inside):
            data = small.children[0].write() if timing is not None and (typ, off, length) == mvhd else None
            if typ == b"trak" and (behind or wanted):
                trak = Tree.parse(f.at(off, length))[0]
                if behind:
                    _move_chunks(Tree(b"moov", b"", children=[trak]), at, size)
                done = wanted and spherical_track(trak)
                wanted &= not done
                data = trak.write() if behind or done else None
            total += length if data is None else len(data)
            if data is None and same and same[2] == off:
                same = same[0], same[1], off + length
                continue
            if same:
                yield MOOV + 1 + same[0], None, path, same[1], same[2] - same[1]
            same = (k, off, off + length) if data is None else None
            if data is not None:
                yield MOOV + 1 + k, data, None, None, None
        if same:
            yield MOOV + 1 + same[0], None, path, same[1], same[2] - same[1]
        if wanted:
            raise BoxError("no video track")
        more = b"".join(c.write() for c in small.children[1:]) if timing is not None else b""
        yield MOOV, head(b"moov", total + len(more)), None, None, None
        yield MOOV + 1 + len(inside), more, None, None, None


def grown(box_table: DataFrame, inserts: DataFrame) -> DataFrame:
    """The boxes of box_table (path, depth, parent_off, off, size and more) after inserts (path, parent_off, at, n): new_off, new_size.

    n bytes are put in at byte `at`, inside the box at parent_off (null: between top-level boxes). They make all boxes around
    them longer and move what begins at or behind them. Ancestors come from a closure over the adjacency, one join a level
    (box trees are a few levels deep), moves from running sums over the file's positions: no box meets each insert.
    """
    keys = box_table.select("path", "off", "parent_off", "depth")
    depth = keys.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    at = inserts.where("parent_off IS NOT NULL").groupBy("path", F.col("parent_off").alias("off")).agg(F.sum("n").alias("n"))
    total = at
    for _ in range(depth):
        at = at.join(keys, ["path", "off"]).where("parent_off IS NOT NULL").groupBy("path", F.col("parent_off").alias("off")).agg(F.sum("n").alias("n"))
        total = total.unionByName(at)
    longer = total.groupBy("path", "off").agg(F.sum("n").alias("_more"))
    return _moved(box_table, inserts, "off").join(longer, ["path", "off"], "left").withColumn("new_size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more")


def _moved(rows: DataFrame, inserts: DataFrame, column: str) -> DataFrame:
    """rows (path, column and more) with new_<column>: the position plus all bytes put in at or before it."""
    rest = F.struct(*[c for c in rows.columns if c != "path"])
    own = rows.select("path", F.col(column).alias("_p"), F.lit(0).cast("long").alias("_n"), rest.alias("_r"), F.lit(1).alias("_k"))
    put = inserts.select("path", F.col("at").alias("_p"), F.col("n").cast("long").alias("_n"), F.lit(None).cast(own.schema["_r"].dataType).alias("_r"), F.lit(0).alias("_k"))
    w = Window.partitionBy("path").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.unionByName(put).withColumn("_by", F.sum("_n").over(w)).where("_k = 1")
    return met.select("path", "_r.*", (F.col("_p") + F.col("_by")).alias(f"new_{column}"))


def moved_chunks(chunks: DataFrame, inserts: DataFrame) -> DataFrame:
    """Chunk offsets (path, chunk_off and more) with new_chunk_off, as stco and co64 have to say after the inserts."""
    return _moved(chunks, inserts, "chunk_off")
