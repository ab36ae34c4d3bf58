"""Side-car tracks, command scripts, PGM rasters, panorama XMP; and a writer for one file a row."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XMP_MARKER = b"http://ns.adobe.com/xap/1.0/\0"


def gpx_documents(ticks: DataFrame) -> DataFrame:
    """track_id, content: one GPX text a track (t in microseconds), points in order."""
    c = F.col
    ele = F.when(c("ele").isNotNull(), F.format_string("<ele>%.2f</ele>", "ele")).otherwise("")
    speed = F.when(c("speed").isNotNull(), F.format_string("<extensions><speed>%.3f</speed></extensions>", "speed")).otherwise("")
    time = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    point = F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', "lat", "lon"), ele, F.lit("<time>"), time, F.lit("</time>"), speed, F.lit("</trkpt>"))
    got = ticks.select("track_id", F.struct("i", point.alias("p")).alias("x")).groupBy("track_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tracklens" xmlns="http://www.topografix.com/GPX/1.1"><trk><trkseg>'
    return got.select("track_id", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x.getField("p")), ""), F.lit("</trkseg></trk></gpx>")).alias("content"))


def command_scripts(lines: DataFrame) -> DataFrame:
    """clip, content: the command lines of a clip in frame order (clips without lines have no row)."""
    got = lines.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "line"))).alias("xs"))
    return got.select("clip", F.concat(F.array_join(F.transform("xs", lambda x: x.getField("line")), "\n"), F.lit("\n")).alias("content"))


def pgm(values: np.ndarray, maximum: int) -> bytes:
    """Binary PGM: one byte a pixel up to 255, else two, big-endian."""
    h, w = values.shape
    return b"P5\n%d %d\n%d\n" % (w, h, maximum) + values.astype(np.uint8 if maximum < 256 else ">u2").tobytes()


def pgm_rasters(pixels: DataFrame, key: str, value: str, maximum: int, missing: int = 0) -> DataFrame:
    """key, content: one raster a key, from row, col and a value (null: missing). A raster is one task's."""

    def write(g: pd.DataFrame) -> pd.DataFrame:
        out = np.full((int(g["row"].max()) + 1, int(g["col"].max()) + 1), missing, np.int64)
        out[g["row"].astype(int), g["col"].astype(int)] = g[value].fillna(missing).astype(np.int64)
        return pd.DataFrame({key: [g[key].iloc[0]], "content": [pgm(out, maximum)]})

    return pixels.select(key, "row", "col", value).groupBy(key).applyInPandas(write, f"{key} {dict(pixels.dtypes)[key]}, content binary")


#: Attributes of a whole equirectangular panorama; {w} and {h} are its size.
GPANO = """\
GPano:ProjectionType="equirectangular"
GPano:UsePanoramaViewer="True"
GPano:FullPanoWidthPixels="{w}"
GPano:FullPanoHeightPixels="{h}"
GPano:CroppedAreaImageWidthPixels="{w}"
GPano:CroppedAreaImageHeightPixels="{h}"
GPano:CroppedAreaLeftPixels="0"
GPano:CroppedAreaTopPixels="0"
"""
XMP_PACKET = """<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<rdf:Description rdf:about="" xmlns:GPano="http://ns.google.com/photos/1.0/panorama/"
%s />
</rdf:RDF></x:xmpmeta>
<?xpacket end="w"?>"""
SOI, APP1, APP_MARKERS, MAX_SEGMENT = 0xD8, 0xE1, range(0xE0, 0xF0), 65_535


def panorama_xmp(width: int, height: int) -> bytes:
    return (XMP_PACKET % GPANO.format(w=width, h=height)).encode()


def jpeg_segments(jpeg: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments before the image data, the start-of-image marker first."""
    if len(jpeg) >= 2 and jpeg[0] == 0xFF and jpeg[1] == SOI:
        yield SOI, 0, 2
        start = 2
        for _ in range(len(jpeg)):
            if start + 4 > len(jpeg) or jpeg[start] != 0xFF:
                return
            marker, size = jpeg[start + 1], int.from_bytes(jpeg[start + 2 : start + 4], "big")
            end = start + 2 + size
            if end > len(jpeg):
                return
            yield marker, start, end
            start = end


def segment(marker: int, payload: bytes) -> bytes:
    size = len(payload) + 2
    if size > MAX_SEGMENT:
        raise ValueError(f"a segment holds {MAX_SEGMENT - 2} bytes, not {len(payload)}")
    return bytes([0xFF, marker]) + size.to_bytes(2, "big") + payload


def add_panorama(jpeg: bytes, width: int, height: int) -> bytes:
    """The JPEG with panorama XMP in an APP1 segment behind the application segments that it starts with."""
    head = list(takewhile(lambda s: s[0] == SOI or s[0] in APP_MARKERS, jpeg_segments(jpeg)))
    if not head:
        raise ValueError("content does not start like a JPEG image")
    place = head[-1][2]
    return b"".join([jpeg[:place], segment(APP1, XMP_MARKER + panorama_xmp(width, height)), jpeg[place:]])


def add_panoramas(images: DataFrame) -> DataFrame:
    """path, content with XMP, from path, content, width, height."""

    @F.pandas_udf("binary")
    def add(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([add_panorama(bytes(b), int(x), int(y)) for b, x, y in zip(raw, w, h, strict=True)])

    return images.select("path", add("content", "width", "height").alias("content"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content to folder/name and gives name, path, n_bytes. folder: one that all executors mount.

    A file appears whole or not at all: it is written under a name of its own and then renamed, so a task that is
    run again replaces its files by equal ones. Names must be plain and unique (see free_names).
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                if not name or name != os.path.basename(name) or name in (".", ".."):
                    raise ValueError(f"{name!r} is no plain file name")
                raw = content.encode() if isinstance(content, str) else bytes(content)
                own = os.path.join(folder, f".{uuid.uuid4().hex}.part")
                with open(own, "wb") as f:
                    f.write(raw)
                paths.append(os.path.join(folder, name))
                os.replace(own, paths[-1])
            yield pd.DataFrame({"name": batch["name"], "path": paths, "n_bytes": [os.path.getsize(p) for p in paths]})

    return files.select("name", "content").mapInPandas(write, "name string, path string, n_bytes long")


def free_names(files: DataFrame, taken: DataFrame | None = None, order: str = "name") -> DataFrame:
    """files with `name` made unique: of rows with one name the first keeps it unless it is in taken (name); each other one
    gets the smallest free number, as -1, -2 and so on before the extension."""
    stem, ext = (F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", i) for i in (1, 2))
    rows = files.withColumns({"_stem": stem, "_ext": ext, "_k": F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1})
    known = files.select("name", F.lit(False).alias("_there"))
    if taken is not None:
        known = known.unionByName(taken.select("name", F.lit(True).alias("_there")))
    known = known.groupBy("name").agg(F.bool_or("_there").alias("_there"))
    s, n, e = (F.regexp_extract("name", r"^(.+)-([1-9]\d*)(\.[^.]*)?$", i) for i in (1, 2, 3))
    used = known.select(s.alias("_s"), e.alias("_e"), n.try_cast("long").alias("n")).where("n IS NOT NULL").groupBy("_s", "_e").agg(F.collect_set("n").alias("_used"))
    own = known.where("_there").select(F.col("name").alias("_taken"))
    got = rows.join(used, (F.col("_stem") == F.col("_s")) & (F.col("_ext") == F.col("_e")), "left").join(own, F.col("name") == F.col("_taken"), "left")
    k = (F.col("_k") + F.when(F.col("_taken").isNotNull(), 1).otherwise(0)).cast("long")
    numbers = F.coalesce("_used", F.array().cast("array<long>"))
    free = F.element_at(F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)) + F.size(numbers)), numbers), F.greatest(k, F.lit(1)).cast("int"))
    name = F.when(k == 0, F.col("name")).otherwise(F.concat("_stem", F.lit("-"), free.cast("string"), "_ext"))
    return got.withColumn("name", name).select(*files.columns)
