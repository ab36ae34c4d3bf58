"""Ranged reads and the container sink: files beyond 2 GB, byte counts, failed jobs, growth of boxes."""

import os
import random
import struct

import pytest


def box(typ, body=b""):
    return struct.pack(">I4s", len(body) + 8, typ) + body


def full(typ, *numbers, fmt="I"):
    return box(typ, bytes(4) + struct.pack(f">{len(numbers)}{fmt}", *numbers))


def trak(track_id, codec, sizes, offsets, spc=1, scale=25):
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + box(codec, bytes(8)))
    co64 = box(b"co64", struct.pack(">II", 0, len(offsets)) + struct.pack(f">{len(offsets)}Q", *offsets))
    stbl = box(b"stbl", stsd + full(b"stts", 1, len(sizes), 40) + full(b"stsc", 1, 1, spc, 1) + full(b"stsz", 0, len(sizes), *sizes) + co64)
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">6I", 0, 0, 0, scale, 0, 0)) + box(b"hdlr", bytes(8) + b"meta" + bytes(12)) + box(b"minf", stbl))
    return box(b"trak", box(b"tkhd", struct.pack(">6I", 0, 0, 0, track_id, 0, 0)) + mdia)


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """A sparse file of 5 GB: ftyp, mdat with a 64-bit size, moov at the end; samples at its start, middle and end."""
    path = str(tmp_path_factory.mktemp("clips") / "big.mp4")
    at = [40, 41, (3 << 30) + 5, (5 << 30) - 7]
    size = 5 << 30
    with open(path, "wb") as f:
        f.write(box(b"ftyp", bytes(8)) + struct.pack(">I4sQ", 1, b"mdat", size - 16))
        for k, p in enumerate(at):
            f.seek(p)
            f.write(bytes([65 + k]))
        f.seek(size)
        f.write(box(b"moov", trak(1, b"avc1", [1] * 4, at) + trak(2, b"djmd", [1, 1], at[2:])))
    return path, at, size


def test_samples_beyond_2_gb(spark, big):
    from tracklens.sources import ranged

    path, at, _ = big
    got = ranged.read(spark, "mp4_samples", path, payload=True, range_bytes=1 << 30)
    assert got.rdd.getNumPartitions() == 6
    rows = sorted((r.track_id, r.sample, r.off, bytes(r.payload), r.seconds) for r in got.collect())
    assert rows == [(1, k, p, bytes([65 + k]), 40 * k / 25) for k, p in enumerate(at)] + [(2, k, p, bytes([67 + k]), 40 * k / 25) for k, p in enumerate(at[2:])]
    boxes = [(r.typ, r.off, r.size, r.hdr) for r in ranged.read(spark, "mp4_boxes", path).orderBy("off").collect()]
    assert boxes[:3] == [("ftyp", 0, 16, 8), ("mdat", 16, (5 << 30) - 16, 16), ("moov", 5 << 30, os.path.getsize(path) - (5 << 30), 8)]


def test_only_what_is_asked_is_read(big):
    from tracklens.sources import ranged

    path, at, size = big
    with ranged.RangedFile(path) as f:
        rows = list(ranged.SampleReader({"path": path, "payload": "true", "codec": "djmd"}).rows(f, path, 3 << 30, 4 << 30))
        assert [(r[6], r[10]) for r in rows] == [(at[2], b"C")]
        assert f.read_bytes < 3000
    with ranged.RangedFile(path) as f:
        chunks = list(ranged.ChunkReader({"path": path, "first": "10", "last": str((1 << 30) + 2_000_000), "chunk_bytes": "1048576"}).rows(f, path, 1 << 30, 2 << 30))
        assert [(k, off, len(b)) for _, k, off, b in chunks] == [(1024, (1 << 30) + 10, 1 << 20), (1025, (1 << 30) + 10 + (1 << 20), 2_000_000 - 10 - (1 << 20) + 1)]


def test_filters_reach_the_reader(spark, big):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    from tracklens.sources import ranged

    path, at, _ = big
    r = ranged.PushingSampleReader({"path": path})
    rest = list(r.pushFilters([EqualTo(("track_id",), 1), GreaterThan(("seconds",), 1.0), LessThan(("seconds",), 4.0), EqualTo(("sample",), 3)]))
    assert rest == [GreaterThan(("seconds",), 1.0), EqualTo(("sample",), 3)]
    with ranged.RangedFile(path) as f:
        assert [(x[2], x[5]) for x in r.rows(f, path, 0, 1 << 40)] == [(1, 1), (1, 2)]
    before = spark.conf.get(ranged.PUSHDOWN, None)
    spark.conf.set(ranged.PUSHDOWN, "true")
    try:
        got = ranged.read(spark, "mp4_samples", path).where("codec = 'avc1' AND seconds > 1.6 AND seconds <= 4.8")
        assert sorted(x.sample for x in got.collect()) == [2, 3]
    finally:
        spark.conf.set(ranged.PUSHDOWN, before or "false")


def test_chunks_of_several_files(spark, tmp_path):
    from tracklens.sources import ranged

    rng = random.Random(3)
    data = {f"f{k}": rng.randbytes(n) for k, n in enumerate((0, 1, 99, 1000, 1001))}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    got = ranged.read(spark, "byte_chunks", f"file://{tmp_path}", range_bytes=300, chunk_bytes=70, first=1, last=990).collect()
    for name, b in data.items():
        own = sorted((r.chunk, r.off, bytes(r.bytes)) for r in got if r.path.endswith(name))
        assert own == [(k, 1 + 70 * k, b[1:991][70 * k : 70 * k + 70]) for k in range(-(-max(0, min(len(b), 991) - 1) // 70))]


def test_sample_table_equals_a_plain_walk():
    from tracklens.sources import ranged

    rng = random.Random(1)
    for _ in range(60):
        chunks = sorted(rng.sample(range(1000, 9000), rng.randrange(0, 9)))
        stsc, first = [], 1
        for _ in range(rng.randrange(0, 4)):
            stsc.append((first, rng.randrange(0, 4), 1))
            first += rng.randrange(1, 4)
        sizes = [rng.randrange(0, 50) for _ in range(rng.randrange(0, 20))]
        stts = [(rng.randrange(0, 9), rng.randrange(1, 5)) for _ in range(3)]
        times, want, i, pts = [d for n, d in stts for _ in range(n)], [], 0, 0
        for c, off in enumerate(chunks, 1):
            for _ in range(([0] + [s for f, s, _ in stsc if f <= c])[-1]):
                if i < len(sizes):
                    want.append((off, sizes[i], pts))
                    off, pts, i = off + sizes[i], pts + (times[i] if i < len(times) else 0), i + 1
        got = ranged.sample_table({"sizes": sizes, "chunk_offsets": chunks, "stsc": stsc, "stts": stts})
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_sink_copies_ranges_and_publishes_whole_files(spark, tmp_path, big):
    from tracklens.sinks import container

    path, at, _ = big
    (tmp_path / "src").write_bytes(bytes(range(256)) * 50_000)
    rows = [("a/x.bin", 2, b"tail", None, None, None), ("a/x.bin", 0, b"head", None, None, None), ("a/x.bin", 1, None, str(tmp_path / "src"), 3, 9_000_000), ("y.bin", 0, None, path, at[2], 3), ("z", 0, None, None, None, None)]
    df = spark.createDataFrame(rows, container.PARTS).repartition(4)
    container.write_files(df, f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"head" + (bytes(range(256)) * 50_000)[3:9_000_003] + b"tail"
    assert (tmp_path / "out/y.bin").read_bytes() == b"C\0\0" and (tmp_path / "out/z").read_bytes() == b""
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "y.bin", "z"]


def test_failed_sink_leaves_nothing(spark, tmp_path):
    from tracklens.sinks import container

    (tmp_path / "out").mkdir()
    (tmp_path / "out/keep").write_bytes(b"old")
    rows = [("good", 0, b"x", None, None, None), ("keep", 0, b"new", None, None, None), ("bad", 0, None, str(tmp_path / "missing"), 0, 5)]
    with pytest.raises(Exception, match="missing"):
        container.write_files(spark.createDataFrame(rows, container.PARTS), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["keep"] and (tmp_path / "out/keep").read_bytes() == b"old"
    with pytest.raises(Exception, match="no file name"):
        container.write_files(spark.createDataFrame([("../up", 0, b"x", None, None, None)], container.PARTS), str(tmp_path / "out"))


def test_frames_at_ties_and_edges(spark):
    from tracklens.sources import ranged

    index = spark.createDataFrame([("f", 0, t, k, 10 * k, 5) for k, t in enumerate([1.0, 2.0, 2.0, 3.5])] + [("f", 1, 0.0, 9, 9, 9), ("g", 1, 0.0, 0, 0, 1)], "path string, trak int, seconds double, sample long, off long, size long")
    wanted = spark.createDataFrame([("f", 0.5), ("f", 2.0), ("f", 2.0), ("f", 3.4), ("f", 99.0), ("g", 1.0)], "path string, t double")
    got = sorted((r.path, r.t, r.sample) for r in ranged.frames_at(index, wanted).collect())
    assert got == [("f", 0.5, 0), ("f", 2.0, 2), ("f", 2.0, 2), ("f", 3.4, 2), ("f", 99.0, 3)]


def test_growth_equals_rebuilding_the_file(spark):
    """Boxes after inserts are those that a walk of the changed bytes finds."""
    from tracklens.sinks import container
    from tracklens.sources.mp4 import boxes

    rng = random.Random(2)
    frame = {}
    rows, inserts = [], []
    for name in "pqr":
        traks = b"".join(box(b"trak", box(b"tkhd", bytes(rng.randrange(9))) + box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", bytes(7)))))) for _ in range(3))
        old = box(b"ftyp", bytes(4)) + box(b"moov", box(b"mvhd", bytes(5)) + traks) + box(b"mdat", bytes(50))
        found = list(boxes(old))
        rows += [(name, d, p, t.decode(), o, n, h) for d, p, t, o, n, h in found]
        put = [(p_off, at, n) for p_off, at, n in [(None, 12, 10), *((o, o + s, 8 * k + 9) for k, (d, p, t, o, s, h) in enumerate(found) if t in (b"trak", b"stbl", b"moov"))]]
        inserts += [(name, *x) for x in put]
        frame[name] = (old, found, put)
    schema = "path string, depth int, parent_off long, typ string, off long, size long, hdr int"
    got = {(r.path, r.off): (r.new_off, r.new_size) for r in container.grown(spark.createDataFrame(rows, schema), spark.createDataFrame(inserts, "path string, parent_off long, at long, n long")).collect()}
    for name, (_, found, put) in frame.items():
        around = {o: p for d, p, t, o, s, h in found}
        more = dict.fromkeys(around, 0)
        for p_off, _, n in put:
            while p_off is not None:
                more[p_off] += n
                p_off = around[p_off]
        for d, p, t, o, s, h in found:
            assert got[name, o] == (o + sum(n for _, at, n in put if at <= o), s + more[o])
    chunks = spark.createDataFrame([("p", 0, 5), ("p", 1, 12), ("p", 2, 400)], "path string, chunk int, chunk_off long")
    assert [r.new_chunk_off for r in container.moved_chunks(chunks, spark.createDataFrame([("p", None, 12, 10)], "path string, parent_off long, at long, n long")).orderBy("chunk").collect()] == [5, 22, 410]


@pytest.mark.parametrize("first", ["moov", "mdat"])
def test_muxed_files_equal_the_bytes_function(spark, tmp_path, first):
    from tracklens.sinks import boxes as B
    from tracklens.sinks import container

    mvhd = full(b"mvhd", 0, 0, 1000, 0, *[0] * 20, 7)
    video = trak(1, b"avc1", [3, 4], [0, 0]).replace(b"meta" + bytes(12), b"vide" + bytes(12))
    size = len(box(b"moov", mvhd + video))
    at = 16 + 8 + (size if first == "moov" else 0)
    video = trak(1, b"avc1", [3, 4], [at, at + 3]).replace(b"meta" + bytes(12), b"vide" + bytes(12))
    moov, mdat = box(b"moov", mvhd + video), box(b"mdat", b"abcdefg")
    buf = box(b"ftyp", bytes(8)) + (moov + mdat if first == "moov" else mdat + moov)
    (tmp_path / "a.mp4").write_bytes(buf)
    packets = [bytes([k]) * 60 for k in range(4)]
    files = spark.createDataFrame([(str(tmp_path / "a.mp4"), "a.mp4"), (str(tmp_path / "a.mp4"), "copy/b.mp4")], "path string, name string")
    rows = spark.createDataFrame([(str(tmp_path / "a.mp4"), k, packets[k], 90_000) for k in (2, 0, 3, 1)], "path string, i int, packet binary, duration int")
    container.write_files(container.muxed(files, rows, spherical=True), str(tmp_path / "out"))
    media, tree = B.relocated(buf)
    B.with_spherical(tree)
    want = media + B.with_packets(tree, len(media), packets, [90_000] * 4) + tree.write()
    for name in ("a.mp4", "copy/b.mp4"):
        got = (tmp_path / "out" / name).read_bytes()
        assert got == want and [p for p, _ in B.read_packets(got)] == [0, 90_000, 180_000, 270_000] and B.spherical_xml(got)
    container.write_files(container.muxed(files.limit(1)), str(tmp_path / "plain"))
    assert sorted((tmp_path / "plain").iterdir())[0].read_bytes() == media + B.relocated(buf)[1].write()


def test_movie_headers(spark, tmp_path, big):
    from tracklens.sources import ranged

    long = box(b"mvhd", bytes([1]) + bytes(3) + struct.pack(">QQIQ", 1, 2, 600, 1 << 40) + bytes(76) + struct.pack(">I", 9))
    video = trak(5, b"xxxx", [1], [0]).replace(b"meta" + bytes(12), b"vide" + bytes(12))
    (tmp_path / "a").write_bytes(box(b"moov", long + trak(4, b"djmd", [1], [0]) + video))
    (tmp_path / "b").write_bytes(box(b"ftyp", bytes(8)))
    (tmp_path / "c").write_bytes(box(b"moov", trak(4, b"djmd", [1], [0])))
    got = {r.path[-1]: tuple(r)[1:] for r in ranged.read(spark, "mp4_headers", str(tmp_path)).collect()}
    assert got == {"a": (600, 1 << 40, 9, 1, 5, "xxxx", False), "c": (None,) * 7}
    with ranged.RangedFile(big[0]) as f:
        assert list(ranged.HeaderReader({"path": big[0]}).rows(f, big[0], 0, 1)) and f.read_bytes < 3000


def test_tables_are_read_once_a_task_not_once_a_range(tmp_path, monkeypatch):
    from tracklens.sources import ranged

    at = list(range(24, 24 + 40 * 300, 40))
    (tmp_path / "a.mp4").write_bytes(box(b"ftyp", bytes(8)) + box(b"mdat", bytes(40 * 300)) + box(b"moov", trak(1, b"djmd", [40] * 300, at)))
    (tmp_path / "b.mp4").write_bytes((tmp_path / "a.mp4").read_bytes())
    parsed = []
    whole = ranged.tracks
    monkeypatch.setattr(ranged, "tracks", lambda f: parsed.append(1) or whole(f))
    reader = ranged.SampleReader({"path": str(tmp_path), "range_bytes": "64"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted((r[0][-5], r[6]) for r in rows) == sorted((n, o) for n in "ab" for o in at)
    assert len(parsed) == 2
    monkeypatch.setattr(ranged, "TASK_RANGES", 50)  # a file of many ranges is still shared out
    parsed.clear()
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 600 and len(parsed) == len(reader.partitions()) == 2 * -(-os.path.getsize(tmp_path / "a.mp4") // (64 * 50))


def test_packets_are_parts_and_times_may_be_long(spark, tmp_path):
    """No row holds a file's packets or tracks, and a track may last more than four bytes say; several files share a batch."""
    from tracklens.sinks import container
    from tracklens.sources import ranged

    mvhd, data = full(b"mvhd", 0, 0, 1000, 0, *[0] * 20, 7), box(b"mdat", b"abc")
    others = b"".join(trak(k, b"djmd", [3], [24]) for k in range(1, 6))
    for name in "ab":
        (tmp_path / name).write_bytes(box(b"ftyp", bytes(8)) + data + box(b"moov", mvhd + others))
    files = spark.createDataFrame([(str(tmp_path / x), x) for x in "ab"], "path string, name string").coalesce(1)
    last = {"a": [3_000_000_000, 2_000_000_000, 5], "b": [7, 7, 9, 9, 1]}
    rows = spark.createDataFrame([(str(tmp_path / x), k, bytes([k]) * 60, n) for x, ns in last.items() for k, n in enumerate(ns)], "path string, i int, packet binary, duration long")
    parts = container.muxed(files, rows)
    assert parts.where("length(bytes) = 60").count() == 8 and parts.where("source IS NOT NULL AND off > 24").count() == 2
    container.write_files(parts, str(tmp_path / "out"))
    got = ranged.read(spark, "mp4_samples", str(tmp_path / "out"), codec="camm", payload=True).orderBy("path", "sample").collect()
    assert [(r.path[-1], r.pts, bytes(r.payload)) for r in got] == [(x, sum(ns[:k]), bytes([k]) * 60) for x, ns in last.items() for k in range(len(ns))]
    boxes = ranged.read(spark, "mp4_boxes", str(tmp_path / "out"), levels=2)
    assert {r.depth for r in boxes.collect()} == {0, 1} and boxes.where("typ = 'trak'").count() == 12


def test_the_sample_source_gives_many_tracks_a_batch(tmp_path):
    """Batches instead of a row at a time, bounded in rows and payload bytes, in the order of the tracks."""
    from tracklens.sources import ranged

    traks = b"".join(trak(k, b"djmd", [2, 3], [8, 10]) for k in range(1, 301))
    path = tmp_path / "many.mp4"
    path.write_bytes(box(b"mdat", b"abcde") + box(b"moov", traks))
    reader = ranged.BatchedSampleReader({"path": str(path), "payload": "true"})
    batches = list(reader.read(ranged.Ranges([(str(path), 0, path.stat().st_size)])))
    assert [b.num_rows for b in batches] == [600]
    got = batches[0].to_pydict()
    assert got["trak"] == [k // 2 for k in range(600)] and got["sample"] == [0, 1] * 300 and got["payload"] == [b"ab", b"cde"] * 300
