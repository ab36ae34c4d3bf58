import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.sinks import boxes as W
from tracklens.sinks import files as K
from tracklens.sources import mp4, tables
from tracklens.sources import protobuf as P


def movie(moov_first: bool) -> bytes:
    media = W.box(b"mdat", bytes(range(100)))
    ftyp = W.box(b"ftyp", b"isom" + bytes(4))

    def moov(first: int) -> bytes:
        entry = W.box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(70))
        stbl = W.box(b"stbl", W.full(b"stsd", W.u32(1), entry), W.full(b"stts", W.u32(2, 3, 10, 2, 20)), W.full(b"stsc", W.u32(2, 1, 2, 1, 2, 3, 1)), W.full(b"stsz", W.u32(0, 5, 10, 20, 30, 15, 25)), W.full(b"stco", W.u32(2, first, first + 30)))
        hdlr = W.full(b"hdlr", W.u32(0), b"vide", bytes(12), b"v\0")
        mdia = W.box(b"mdia", W.full(b"mdhd", W.u32(0, 0, 25, 70), bytes(4)), hdlr, W.box(b"minf", stbl))
        tkhd = W.full(b"tkhd", W.u32(0, 0, 1, 0, 70), bytes(60))
        mvhd = W.full(b"mvhd", W.u32(0, 0, 1000, 2800), bytes(76), W.u32(2))
        return W.box(b"moov", mvhd, W.box(b"trak", tkhd, mdia))

    if moov_first:
        n = len(ftyp) + len(moov(0)) + 8
        return ftyp + moov(n) + media
    return ftyp + media + moov(len(ftyp) + 8)


def samples(buf: bytes) -> list[bytes]:
    t = next(mp4.track(buf, o, s, h) for _, _, typ, o, s, h in mp4.boxes(buf) if typ == b"trak")
    a, b = t["chunk_offsets"]
    return [buf[a : a + 10], buf[a + 10 : a + 30], buf[b : b + 30], buf[b + 30 : b + 45], buf[b + 45 : b + 70]]


@pytest.mark.parametrize("moov_first", [False, True])
def test_tracks_and_samples(spark, moov_first):
    buf = movie(moov_first)
    files = spark.createDataFrame([("f", bytearray(buf)), ("g", bytearray(buf[:50])), ("e", None)], "path string, content binary")
    tracks = mp4.read_tracks(files)
    r = tracks.collect()
    assert [(x.path, x.codec, x.handler, x.timescale, x.track_id) for x in r] == [("f", "avc1", "vide", 25, 1)]
    s = mp4.expand_samples(tracks, ["path", "trak"]).orderBy("sample").collect()
    assert [(x.sample, x.chunk, x.size, x.pts) for x in s] == [(0, 1, 10, 0), (1, 1, 20, 10), (2, 2, 30, 20), (3, 2, 15, 30), (4, 2, 25, 50)]
    got = mp4.payloads(files, mp4.expand_samples(tracks, ["path", "trak"])).orderBy("sample").collect()
    assert [bytes(x.payload) for x in got] == samples(buf)
    kids = mp4.children(mp4.read_boxes(files), "moov")
    assert [x.typ for x in kids.orderBy("off").collect()] == ["mvhd", "trak"]


def test_box_headers():
    big = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    assert [x[2:] for x in mp4.boxes(big)] == [(b"free", 0, 20, 16)]
    assert [x[2:] for x in mp4.boxes(struct.pack(">I4s", 0, b"mdat") + bytes(9))] == [(b"mdat", 0, 17, 8)]
    for bad in (bytes(5), struct.pack(">I4s", 4, b"free"), struct.pack(">I4s", 99, b"free")):
        with pytest.raises(mp4.BoxError):
            mp4.header(bad, 0, len(bad))


@pytest.mark.parametrize("moov_first", [False, True])
def test_packet_track_and_spherical_boxes(moov_first):
    buf = movie(moov_first)
    packets = [struct.pack(W.LAYOUT, 0, 6, 1e9 + i, 3, 47.0, 7.0, *[1.0] * 8)[: W.SIZE] if False else struct.pack(W.LAYOUT, 0, 6, 1e9 + i, 3, 47.0, 7.0, 1, 2, 3, 4, 5, 6, 7) for i in range(4)]
    out = W.add_packets(W.add_spherical(buf), packets, [90_000] * 4)
    assert samples(out) == samples(buf)
    got = W.read_packets(out)
    assert [p for p, _ in got] == [0, 90_000, 180_000, 270_000] and got[2][1][2] == 1e9 + 2
    assert "<GSpherical:ProjectionType>equirectangular" in W.spherical_xml(out) and b"sv3d" in out
    assert [t for d, _, t, *_ in mp4.boxes(out) if d == 0] == [b"ftyp", b"mdat", b"mdat", b"moov"]
    with pytest.raises(mp4.BoxError):
        W.add_packets(buf, [], [])


def field(n: int, wire: int, payload: bytes) -> bytes:
    return bytes([n << 3 | wire]) if n < 16 else bytes([(n << 3 | wire) & 0x7F | 0x80, n >> 4])


def msg(n: int, body: bytes) -> bytes:
    return field(n, 2, b"") + bytes([len(body)]) + body


def f32(n: int, x: float) -> bytes:
    return field(n, 5, b"") + struct.pack("<f", x)


def test_frames_and_calibration(spark):
    quat = b"".join(f32(k, v) for k, v in ((1, 1.0), (2, 0.0), (3, 0.5), (4, 0.25)))
    inner = msg(1, bytes([2 << 3, 0x96, 0x01])) + msg(2, msg(9, quat) + msg(3, f32(1, 100.0)) + msg(4, msg(1, b"\x01\x64"))) + msg(3, msg(2, msg(1, msg(3, quat) + msg(3, f32(1, 1.0)))))
    df = spark.createDataFrame([(0, bytearray(msg(3, inner))), (1, bytearray(msg(1, b""))), (2, None)], "sample int, payload binary")
    (r,) = P.decode_frames(df).collect()
    assert (r.sample, r.timestamp, r.qw, r.qy, r.iso, r.shutter_raw, r.ax_g, len(r.rate)) == (0, 150, 1.0, 0.5, 100.0, "0164", None, 1)
    assert P.high_rate(P.decode_frames(df), ["sample"]).first().qz == 0.25
    lens = f32(1, 1048.0) + f32(3, 7.0) + msg(22, struct.pack("<2f", 1, 2))
    cal = msg(1, msg(1, msg(10, b"M1"))) + msg(2, msg(6, msg(1, lens) + msg(2, f32(2, 1.0))))
    (c,) = P.decode_calibration(spark.createDataFrame([(bytearray(cal),)], "payload binary")).collect()
    assert c.model == "M1" and [(x.fx, x.cx, x.radial_lut_1) for x in c.lenses] == [(1048.0, 7.0, [1.0, 2.0])]
    assert P.is_message(cal) and not P.is_message(b"\xff\xff") and not P.is_message(b"")
    with pytest.raises(P.Truncated):
        P.varint(b"\x80", 0)


def test_gpx_scan(spark, tmp_path):
    head = '<gpx xmlns="http://www.topografix.com/GPX/1.1" xmlns:x="urn:x"><trk><trkseg>'
    body = ('<trkpt lat="1" lon="2"><ele>3</ele><time>2026-07-07T20:00:00Z</time></trkpt><trkpt lat="1" lon="2"><time>2026-07-07T22:00:01+02:00</time><extensions><x:a><x:speed>4.5</x:speed></x:a></extensions></trkpt>'
            '<trkpt lat="1" lon="2"/><trkpt lat="1"><time>2026-07-07T20:00:00Z</time></trkpt><trkpt lat="5" lon="6"><time>2026-07-07T20:00:02</time></trkpt>')
    (tmp_path / "a.gpx").write_text(head + body + "</trkseg></trk></gpx>")
    got = tables.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("ord").selectExpr("unix_micros(t) % 60000000 AS us", "lat", "ele", "speed").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 3.0, None), (1_000_000, 1.0, None, 4.5), (2_000_000, 5.0, None, None)]
    (tmp_path / "bad.gpx").write_text(head)
    with pytest.raises(Exception, match="invalid GPX"):
        tables.read_gpx(spark, str(tmp_path / "bad.gpx")).collect()
    assert tables.read_gpx(spark, str(tmp_path / "bad.gpx"), strict=False).count() == 0


def test_csv_json_and_probe(spark, tmp_path):
    (tmp_path / "i.csv").write_text("frame,timestamp,qw,qx,qy,qz,ax_g,ay_g,az_g,iso,shutter_raw,color_temp_K,sensor_temp_C\n0,5,1,0,0,0,0,0,1,100,0164,5000,27\n")
    assert tables.read_imu_frames(spark, str(tmp_path / "i.csv")).first().shutter_raw == "0164"
    (tmp_path / "c.json").write_text('{"model": "M", "lenses": [{"fx": 1.5, "dist": [0.1]}]}')
    (tmp_path / "d.json").write_text('{"model": "M", "lenses": []}')
    assert [r.lenses[0].fx for r in tables.read_calibration(spark, str(tmp_path / "*.json")).collect()] == [1.5]
    doc = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"hevc","width":8,"height":4,"r_frame_rate":"0/0","avg_frame_rate":"30000/1001"}],"format":{"duration":"2.5","size":"9","tags":{"creation_time":"2026-07-07T20:00:00Z"}}}'
    r = tables.probe(spark.createDataFrame([("a", doc)], "path string, probe string")).first()
    assert (r.duration_s, r.width, r.size_bytes, r.audio, r.thumbnail) == (2.5, 8, 9, True, False) and abs(r.fps - 29.97) < 0.001
    files = tables.list_files(spark, str(tmp_path / "*.csv")).collect()
    assert [x.name for x in files] == ["i.csv"] and files[0].size_bytes > 0


def test_sidecars(spark):
    ticks = spark.createDataFrame([("a", 1, 1_783_454_401_500_000, 1.0, 2.0, None, 3.25), ("a", 0, 1_783_454_400_000_000, 1.0, 2.0, 4.0, None)], "track_id string, i int, t long, lat double, lon double, ele double, speed double")
    text = K.gpx_documents(ticks).first().content
    assert text.index("20:00:00.000Z") < text.index("20:00:01.500Z") and "<speed>3.250</speed>" in text and 'lat="1.0000000"' in text
    lines = spark.createDataFrame([("c", 1, "b"), ("c", 0, "a")], "clip string, frame int, line string")
    assert K.command_scripts(lines).first().content == "a\nb\n"
    px = spark.createDataFrame([("m", 0, 0, 300), ("m", 0, 1, None)], "k string, row int, col int, v int")
    assert bytes(K.pgm_rasters(px, "k", "v", 65535, 65535).first().content) == b"P5\n2 1\n65535\n" + struct.pack(">2H", 300, 65535)
    assert K.pgm(np.array([[1, 2]]), 255) == b"P5\n2 1\n255\n\x01\x02"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xd9"
    out = K.add_panorama(jpeg, 8, 4)
    assert out.startswith(jpeg[:8] + b"\xff\xe1") and out.endswith(b"\xff\xd9") and b'GPano:FullPanoWidthPixels="8"' in out
    with pytest.raises(ValueError):
        K.add_panorama(b"no", 1, 1)


def test_live_gaps_and_states(spark, tmp_path):
    from tracklens.streaming.live import job_states, live_gaps

    rows = [("a", 0), ("a", 3), ("a", 12), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_gaps(stream, "k", "t").writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.key, r.duration_s) for r in spark.table("gaps").collect()] == [("a", 9.0)]
    log = spark.createDataFrame([("j", 1, "queued"), ("j", 3, "done"), ("j", 2, "running")], "job string, seq long, status string")
    assert job_states(log).first().status == "done"


def test_samples_of_many_tracks_at_once(spark):
    """Runs, offsets and times against a plain count of chunk after chunk; sizes, chunks and runs that end early, none at all, counts out of range."""
    import random

    rng = random.Random(11)
    rows = []
    for k in range(60):
        n, c = rng.randrange(12), rng.randrange(6)
        firsts = sorted(rng.sample(range(0 if k % 7 == 0 else 1, 9), rng.randrange(4)))
        stsc = [(f, rng.choice([0, 1, 2, 3, 1 << 31]), 1) for f in firsts]
        stts = [(rng.choice([0, 1, 2, 5, (1 << 32) - 1]), rng.randrange(50)) for _ in range(rng.randrange(4))]
        rows.append((f"f{k % 9}", k, [rng.randrange(1, 90) for _ in range(n)], [1000 * i + k for i in range(1, c + 1)], stsc, stts))
    want = []
    for path, k, sizes, chunks, stsc, stts in rows:
        sample = 0
        for chunk, off in enumerate(chunks, 1):
            spc = next((s for f, s, _ in reversed(stsc) if f <= chunk), 0)
            for _ in range(min(spc, len(sizes) - sample)):
                left, pts = sample, 0
                for cnt, dur in stts:
                    pts, left = pts + min(left, cnt) * dur, left - min(left, cnt)
                want.append((path, k, sample, chunk, off, sizes[sample], pts if sample < sum(c for c, _ in stts) else None))
                off, sample = off + sizes[sample], sample + 1
    schema = "path string, trak int, sizes array<bigint>, chunk_offsets array<bigint>, stsc array<struct<first:bigint,spc:bigint,sdi:bigint>>, stts array<struct<cnt:bigint,dur:bigint>>"
    got = mp4.expand_samples(spark.createDataFrame(rows, schema), ["path", "trak"])
    assert sorted(map(repr, (tuple(r) for r in got.select("path", "trak", "sample", "chunk", "off", "size", "pts").collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1  # tracks are read once
