"""Files that rows become: panorama segments, whole files, free names; and the readable dump of messages."""

import struct

import pytest
from pyspark.sql import functions as F

from tracklens.sinks import files


def test_jpeg_segments_and_panorama():
    app = lambda m, p: bytes([0xFF, m]) + struct.pack(">H", len(p) + 2) + p
    jpeg = b"\xff\xd8" + app(0xE0, b"JFIF\0") + app(0xE2, b"icc") + app(0xDB, b"q" * 9) + app(0xE1, b"late") + b"\xff\xda\0\2data"
    assert [m for m, _, _ in files.jpeg_segments(jpeg)][:5] == [0xD8, 0xE0, 0xE2, 0xDB, 0xE1]
    out = files.add_panorama(jpeg, 8, 4)
    segs = list(files.jpeg_segments(out))
    assert [m for m, _, _ in segs][:5] == [0xD8, 0xE0, 0xE2, 0xE1, 0xDB]
    _, start, end = segs[3]
    assert out[start + 4 : end].startswith(files.XMP_MARKER) and out[:start] + out[end:] == jpeg
    for part in (b'ProjectionType="equirectangular"', b'FullPanoWidthPixels="8"', b'CroppedAreaImageHeightPixels="4"', b'CroppedAreaTopPixels="0"'):
        assert part in out[start:end]
    assert files.add_panorama(b"\xff\xd8\xff", 1, 1).endswith(b"\xff") and list(files.jpeg_segments(b"")) == []
    with pytest.raises(ValueError):
        files.segment(0xE1, bytes(70_000))


def test_write_files(spark, tmp_path):
    df = spark.createDataFrame([("a.gpx", "x"), ("b.gpx", "yy"), ("c.gpx", "")], "name string, content string")
    got = files.write_files(df, str(tmp_path)).collect()
    assert sorted((r.name, r.n_bytes) for r in got) == [("a.gpx", 1), ("b.gpx", 2), ("c.gpx", 0)]
    files.write_files(df, str(tmp_path)).collect()
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["a.gpx", "b.gpx", "c.gpx"]
    with pytest.raises(Exception, match="plain file name"):
        files.write_files(spark.createDataFrame([("../a", "x")], "name string, content string"), str(tmp_path)).collect()


def test_free_names(spark):
    names = ["a.mp4", "a.mp4", "a-1.mp4", "b", "c.x.mp4", "d.mp4", "d.mp4"]
    taken = ["d.mp4", "d-7.mp4", "b"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = {r.i: r.name for r in files.free_names(df, spark.createDataFrame([(n,) for n in taken], "name string"), order="i").collect()}
    assert got == {0: "a.mp4", 1: "a-2.mp4", 2: "a-1.mp4", 3: "b-1", 4: "c.x.mp4", 5: "d-1.mp4", 6: "d-2.mp4"}
    assert len(set(got.values()) | set(taken)) == len(names) + len(taken)


def test_readable_dump(spark):
    from tracklens.sources.protobuf import PbTree

    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    message = b"\x08\x01\x10\x02"
    raw = field(1, message) + field(2, b"\x0a " + b"y" * 32) + field(3, b"line\n\tend\r") + field(4, struct.pack("<3f", 1, 2, 3)) + field(5, b"\x00" * 68) + field(6, b"\x0a\x2a" + b"x" * 42)
    got = [(r.path, r.kind) for r in spark.createDataFrame([(raw,)], "b binary").lateralJoin(PbTree(F.col("b").outer())).collect()]
    kinds = dict(got)
    assert (kinds["1"], kinds["1.1"], kinds["3"], kinds["4"], kinds["5"]) == ("message", "varint", "text", "floats", "bytes")
    assert kinds["2"] == "text" and kinds["6"] == "message"


def test_ship_lets_workers_import(spark):
    from tracklens.session import ship

    ship(spark)
    ship(spark)
    assert spark.sparkContext._tracklens_shipped
