import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions import geo, lens, media
from tracklens.functions import rotation as R
from tracklens.operators import camm, catalog, imu, progress, remap, stabilize, track

START = 1_783_454_400_000_000  # 2026-07-07T20:00:00Z


def walk(spark, n=71, ele=True):
    rows = [("a", START - 30_000_000 + i * 1_000_000, i, 47.9 + 0.000045 * i, 7.15 + 0.00001 * i, 250 + 0.2 * i if ele else None) for i in range(n)]
    return spark.createDataFrame(rows, "track_id string, t long, ord long, lat double, lon double, ele double")


def window(spark, start=START, seconds=10.0):
    return spark.createDataFrame([("a", start, seconds)], "track_id string, start long, duration_s double")


def test_coverage_of_a_covered_window(spark):
    r = track.coverage(walk(spark), window(spark)).first()
    assert (r.n_points_in_window, r.coverage_pct, r.suggested_offset_s, r.gaps_gt_5s) == (11, 100.0, 0.0, [])


def test_coverage_suggests_the_track_start_and_lists_gaps(spark):
    r = track.coverage(walk(spark), window(spark, START + 3_600_000_000)).first()
    assert (r.overlap_s, r.coverage_pct, r.suggested_offset_s) == (0.0, 0.0, -3630.0)
    two = spark.createDataFrame([("a", START, 0, 1.0, 1.0, None), ("a", START + 12_000_000, 1, 1.0, 1.0, None)], walk(spark).schema)
    assert [g.duration_s for g in track.coverage(two, window(spark)).first().gaps_gt_5s] == [12.0]
    empty = track.coverage(walk(spark, 0), window(spark)).first()
    assert (empty.overlap_s, empty.suggested_offset_s, empty.n_points_in_window) == (0.0, 0.0, 0)


def test_resample_labels_positions_and_speed(spark):
    got = track.resample(walk(spark), window(spark)).orderBy("i").collect()
    assert len(got) == 11 and [r.t for r in got] == [START + i * 1_000_000 for i in range(11)]
    assert (got[0].lat, got[0].lon, got[0].ele) == pytest.approx((47.90135, 7.1503, 256.0))
    assert all(4.5 < r.speed < 5.5 for r in got) and got[0].speed == got[1].speed
    moved = track.resample(walk(spark), window(spark), offset_s=5.0).orderBy("i").first()
    assert moved.t == START and (moved.lat, moved.lon, moved.ele) == pytest.approx((47.901575, 7.15035, 257.0))


def test_resample_holds_outside_and_needs_points(spark):
    got = track.resample(walk(spark), window(spark, START + 10**9 * 3600, 5.0)).collect()
    assert len(got) == 6 and {round(r.lat, 6) for r in got} == {round(47.9 + 0.000045 * 70, 6)}
    assert track.resample(walk(spark, 0), window(spark)).count() == 0
    assert track.resample(walk(spark), window(spark, seconds=0.0)).count() == 0


def test_a_lone_elevation_survives_only_where_it_is_held(spark):
    t = spark.createDataFrame([("a", START, 0, 1.0, 1.0, 9.0), ("a", START + 4_000_000, 1, 1.0, 1.0, None)], walk(spark).schema)
    assert [r.ele for r in track.resample(t, window(spark, seconds=4.0)).orderBy("i").collect()] == [9.0, None, None, None, None]


def test_bearing_is_never_negative_and_velocity_points_there(spark):
    b = spark.range(1).select(geo.bearing_deg(F.lit(1.0), F.lit(1.0), F.lit(1.1), F.lit(0.9)).alias("b")).first().b
    assert 270 < b < 360
    v = track.velocity(track.resample(walk(spark), window(spark))).orderBy("i").collect()
    assert all(r.vel_n > 4.5 and r.vel_e > 0 and r.vel_up == pytest.approx(0.2, abs=1e-6) for r in v)


def test_strict_ticks_equal_the_fold(spark):
    rng = random.Random(3)
    raw = [rng.randrange(0, 40) for _ in range(60)]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(raw)], "track_id string, i int, t_rel double")
    got = [r.tick for r in camm.durations(camm.ticks(df, timescale=1)).orderBy("i").collect()]
    want = []
    for x in raw:
        want.append(x if not want or x > want[-1] else want[-1] + 1)
    assert got == want
    runs = camm.runs(camm.durations(camm.ticks(df, timescale=1)))
    pts = [r.pts for r in camm.pts(runs).orderBy("sample").collect()]
    assert [p + want[0] for p in pts] == want


def test_packets_have_sixty_bytes_and_read_back(spark):
    f = camm.packet_fields(track.velocity(track.resample(walk(spark, ele=False), window(spark))))
    p = camm.packets(f)
    assert {len(r.packet) for r in p.collect()} == {60}
    r = camm.unpack(p).orderBy("i").first()
    assert (r.fix_type, r.alt, r.h_acc, r.epoch) == (2, 0.0, 5.0, START / 1e6)


def test_euler_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-179, 179), rng.uniform(-89, 89), rng.uniform(-179, 179)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, p double, r double")
    m = df.select("*", R.pack_matrix(R.euler_matrix(F.col("y"), F.col("p"), F.col("r"))).alias("m"))
    for r in m.select("y", "p", "r", *(c.alias(n) for c, n in zip(R.euler(R.matrix("m")), "abc", strict=True))).collect():
        assert (r.a, r.b, r.c) == pytest.approx((r.y, r.p, r.r), abs=1e-6)


def axis(x, y, z, deg):
    h = math.radians(deg) / 2
    return (math.cos(h), *(math.sin(h) * v for v in (x, y, z)))


def frames(spark, quats):
    return spark.createDataFrame([("c", i, dict(zip("wxyz", q, strict=True))) for i, q in enumerate(quats)], "clip string, frame long, q struct<w:double,x:double,y:double,z:double>")


def test_levelling_and_strength(spark):
    def size(q, s):
        r = stabilize.corrections(frames(spark, [q]), "horizon", s).first()
        return max(abs(r.yaw), abs(r.pitch), abs(r.roll))

    assert size(axis(0, 1, 0, -90), 1.0) < 1e-4
    tilted = axis(1, 0, 0, 30)
    assert size(tilted, 1.0) > size(tilted, 0.5) > size(tilted, 0.2) > 0


def test_lock_keeps_the_reference_and_smooth_is_finite(spark):
    qs = [axis(0, 0, 1, 10.0 * i) for i in range(4)]
    r = {x.frame: x for x in stabilize.corrections(frames(spark, qs), "lock", ref_frame=2).collect()}
    assert max(abs(r[2].yaw), abs(r[2].pitch), abs(r[2].roll)) < 1e-6 < abs(r[0].yaw) + abs(r[0].pitch) + abs(r[0].roll)
    jitter = [axis(0, 0, 1, 5 * math.sin(i / 5) + 3 * (-1) ** i) for i in range(20)]
    assert all(math.isfinite(v) for x in stabilize.corrections(frames(spark, jitter), "smooth", 0.3).collect() for v in (x.yaw, x.pitch, x.roll))
    with pytest.raises(ValueError):
        stabilize.corrections(frames(spark, qs), "spin")


def test_smoothing_equals_the_fold(spark):
    def slerp(a, b, f):
        d = sum(x * y for x, y in zip(a, b, strict=True))
        b, d = ([-x for x in b], -d) if d < 0 else (b, d)
        t = math.acos(min(1.0, d))
        wa, wb = (1 - f, f) if d > 0.9995 else (math.sin((1 - f) * t) / math.sin(t), math.sin(f * t) / math.sin(t))
        q = [x * wa + y * wb for x, y in zip(a, b, strict=True)]
        n = math.sqrt(sum(x * x for x in q))
        return [x / n for x in q]

    rng = random.Random(5)
    qs = [axis(0, 0.6, 0.8, rng.uniform(-60, 60)) for _ in range(12)]
    got = [[r.qs[c] for c in "wxyz"] for r in stabilize.smooth(frames(spark, qs), 3).orderBy("frame").collect()]
    for i, g in enumerate(got):
        part = qs[max(0, i - 3) : i + 4]
        acc = list(part[0])
        for k, q in enumerate(part[1:], 2):
            acc = slerp(acc, q, 1 / k)
        assert g == pytest.approx(acc, abs=1e-9)


def test_deltas_telescope_to_the_target(spark):
    angles = spark.createDataFrame([("c", i, 10.0 * i, 5.0 - i, 3.0 * i) for i in range(6)], "clip string, frame long, yaw double, pitch double, roll double")
    d = stabilize.deltas(angles)

    def mat(y, p, r):
        y, p, r = map(math.radians, (y, p, r))
        a = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
        b = np.array([[1, 0, 0], [0, math.cos(p), -math.sin(p)], [0, math.sin(p), math.cos(p)]])
        c = np.array([[math.cos(r), -math.sin(r), 0], [math.sin(r), math.cos(r), 0], [0, 0, 1]])
        return a @ b @ c

    state = np.eye(3)
    for i, x in enumerate(d.orderBy("frame").collect()):
        state = state @ mat(x.dyaw, x.dpitch, x.droll)
        assert np.allclose(state, mat(10.0 * i, 5.0 - i, 3.0 * i), atol=1e-9)
    assert stabilize.commands(d).orderBy("frame").first().line.startswith("0.000000 v360 yaw 0.0000, v360 pitch 5.0000")


def test_sign_continuity_equals_the_fold(spark):
    rng = random.Random(2)
    qs = [[rng.choice([-1, 0, 1]) + rng.random() * 0 for _ in range(4)] for _ in range(80)]
    df = spark.createDataFrame([("c", i, dict(zip("wxyz", map(float, q), strict=True))) for i, q in enumerate(qs)], "clip string, ord long, q struct<w:double,x:double,y:double,z:double>")
    want = [list(map(float, qs[0]))]
    for q in qs[1:]:
        d = sum(a * b for a, b in zip(want[-1], q, strict=True))
        want.append([-float(x) if d < 0 else float(x) for x in q])
    assert [[r.q[c] + 0.0 for c in "wxyz"] for r in imu.continuous(df).orderBy("ord").collect()] == [[x + 0.0 for x in q] for q in want]


def test_imu_clock_units_and_resample(spark):
    rows = [(f, s, *axis(1, 0, 0, f + s / 4)) for f in range(40) for s in range(4)] + [(41, 0, float("nan"), 0.0, 0.0, 0.0)]
    raw = spark.createDataFrame(rows, "frame int, subidx int, qw double, qx double, qy double, qz double").withColumn("clip", F.lit("c"))
    s = imu.samples(raw)
    assert s.count() == 160 and {r.unit for r in s.collect()} == {"frame"}
    got = imu.resample(imu.continuous(imu.seconds(s, 25.0)), spark.createDataFrame([("c", 25.0, 40)], "clip string, fps double, n_frames int")).orderBy("frame").collect()
    roll = 2 * math.degrees(math.atan2(got[20].q.x, got[20].q.w))
    assert len(got) == 40 and 18 < roll < 22


def test_remap_grid_invariants(spark):
    g = remap.grid(remap.ideal_lenses(spark), 172, 86)
    ok = g.where("valid")
    assert ok.count() > 0.5 * g.count() and ok.agg(F.max("sx")).first()[0] < 3840
    m = {r.m for r in remap.mask(g).collect()}
    assert {0, 255} <= m and any(0 < x < 255 for x in m)
    front = g.where("lens = 1 AND row = 43 AND col = 43").first()
    assert abs(front.sx - 1919) < 60 and abs(front.sy - 1919) < 60


def test_lut_scale_of_the_calibration_rows(spark):
    t = spark.range(1).select(lens.lut_scale(F.lit(1000.0), F.lit(5.0), F.lit(5.0), [F.lit(0.0)] * 4, F.array(*[F.lit(5.0)] * 14), F.array(*[F.lit(1005.0)] * 14)).alias("s"), lens.lut_scale(F.lit(1.0), F.lit(0.0), F.lit(0.0), [F.lit(0.0)] * 4, F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("one"))
    assert (t.first().s, t.first().one) == (pytest.approx(2 / math.pi), 1.0)


def test_media_rules(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(media.norm180(F.lit(180.0)), media.norm180(F.lit(-190.0))) == (-180.0, 170.0)
    a, b = media.ratio_parts(F.lit("16:9"))
    w, h, v = media.flat_size(F.lit(1920.0), a, b, F.lit(90.0))
    assert one(w, h, F.round(v, 2)) == (1920, 1080, 58.72)
    for bad in ("0:1", "x:2", "NaN:1", "1:NaN", "1:0", "100:1", "1:2:3", ""):
        assert one(*media.ratio_parts(F.lit(bad))) == (None, None)
    for text, want in (("bytes=10-19", (206, 10, 19)), ("bytes=-5", (206, 1019, 1023)), ("bytes=5-", (206, 5, 1023)), ("bytes=2000-", (416, None, None)), ("bytes=-", (416, None, None)), ("nonsense", (416, None, None))):
        assert one(*media.byte_range(F.lit(text), F.lit(1024).cast("long"))) == want
    assert one(media.inside(F.lit("/a/bc"), F.array(F.lit("/a/b"))), media.inside(F.lit("/a/b/c"), F.array(F.lit("/a/b")))) == (False, True)
    kv = lambda **x: F.create_map(*(F.lit(v) for p in x.items() for v in p))
    assert one(media.out_time_s(kv(out_time_us="-5")), media.out_time_s(kv(out_time_us="N/A", out_time="00:01:02.5")), media.out_time_s(kv(out_time="N/A"))) == (0.0, 62.5, None)


def test_browse_and_shortcuts(spark):
    rows = [("Docs", True), ("Alpha", True), (".hidden", True), ("clip_b.osv", False), ("CLIP_A.OSV", False), ("trace.gpx", False)]
    e = spark.createDataFrame([(f"/x/{n}", n, d) for n, d in rows], "path string, name string, is_dir boolean")
    assert [r.name for r in catalog.browse(e, "osv").collect()] == ["Alpha", "Docs", "CLIP_A.OSV", "clip_b.osv"]
    assert [r.name for r in catalog.browse(e).collect()] == ["Alpha", "Docs"]
    s = spark.createDataFrame([("/r", 2, "b"), ("/r", 1, "a"), ("/q", 3, "c")], "real string, prio int, name string")
    assert {r.name for r in catalog.first_by(s, ["real"], ["prio"]).collect()} == {"a", "c"}


def test_progress_blocks(spark):
    lines = ["fps=24", "speed=2x", "out_time_us=5000000", "junk", "progress=continue", "out_time_us=10000000", "progress=end", "fps=1"]
    df = spark.createDataFrame([("j", i, x) for i, x in enumerate(lines)], "job string, seq long, line string")
    jobs = spark.createDataFrame([("j", 10.0, 4.0)], "job string, duration_s double, elapsed_s double")
    got = progress.estimates(progress.blocks(df), jobs).orderBy("block").collect()
    assert [(r.progress, r.fps, r.eta_s) for r in got] == [(0.5, 24.0, 2.5), (1.0, None, 0.0)]


def test_packet_layout_is_fixed():
    assert struct.calcsize(camm.LAYOUT) == camm.SIZE == 60


def test_plan_strings(spark):
    cols = "input string, output string, out_w int, codec string, wanted string, has_hardware boolean, quality int, interp string, mode string, has_maps boolean, fps_out double, commands string, maps array<string>"
    maps = [f"m{i}" for i in range(5)]
    rows = [("a", "o", 7680, "hevc", "auto", False, 20, "odd", "v360", False, None, None, None), ("b", "o", 3840, "h264", "auto", True, 18, "line", "auto", True, 5.0, "/t/x:y", maps), ("c", "o", 3840, "h264", "cpu", True, 18, "line", "calibrated", False, None, None, None)]
    a, b, c = catalog.conversion_plan(spark.createDataFrame(rows, cols)).orderBy("input").collect()
    assert "yaw=90:w=7680:h=3840:interp=lanczos,format=yuv420p10le[v]" in a.argv[a.argv.index("-filter_complex") + 1] and a.argv[-1] == "o" and "libx265" in a.argv
    graph = b.argv[b.argv.index("-filter_complex") + 1]
    assert b.mode == "calibrated" and b.argv.count("-i") == 6 and "[0:1]fps=5,format=gbrp[b1]" in graph and r"sendcmd=f=/t/x\:y,v360=e:e" in graph and b.encoder == "h264_nvenc"
    assert c.argv is None and c.mode is None


def test_names_and_views(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(media.format_bytes(F.lit(1536)), media.format_duration(F.lit(3723.4)), media.format_duration(F.lit(59.6)), media.format_eta(F.lit(-1.0))) == ("1.5 KB", "1h02m03s", "1m00s", "—")
    assert one(*media.split_name(F.lit("a.b.osv")), *media.split_name(F.lit(".x")), media.basename(F.lit("/a/b/")), media.dirname(F.lit("/a/b"))) == ("a.b", ".osv", ".x", "", "b", "/a")
    assert one(media.ratio_text(F.lit(2.5), F.lit(3.0)), media.url_quote(F.lit("/a b/c"))) == ("2.5:3", "/a%20b/c")
    assert one(media.view_yaw(F.lit(190.0)), media.view_latitude(F.lit(99.0)), media.jpeg_q(F.lit(95)), media.jpeg_q(F.lit(100))) == (-170.0, 85.0, 2, 2)


def test_even_and_quality_at_the_edge_of_the_tolerance(spark, tmp_path):
    """901.6 / 46 / 10 and 901.6 / 10 / 46 lie on different sides of 1.96."""
    import duckdb

    from tracklens.plans.queries import QUERIES, SQL

    rows = [(1, 46, 901.6), (2, 46, 902.0), (3, 0, 900.0), (4, 45, 918.0)]
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.execute(SQL["even_and_quality"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["even_and_quality"](spark, str(tmp_path)).collect()) == want


def test_remaining_time_is_scaled_by_the_ratio(spark):
    """60 * 197.6 / 102.4 would be 115.78125, a tie that rounds to another fourth digit."""
    got = spark.range(1).select(media.eta_s(F.lit(102.4), F.lit(300.0), F.lit(None).cast("double"), F.lit(60.0)).alias("x")).first().x
    assert got == 60 * ((300 - 102.4) / 102.4) and got < 115.78125


def test_generated_images_are_not_broadcast(spark):
    """Spark takes exploded pixels to be as small as the rows they come from."""
    clips = spark.range(3).select(F.col("id").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"), F.lit(10.0).alias("v_span_deg"), F.lit(0.0).alias("yaw_deg"))
    image = clips.select("clip", "row", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col")).selectExpr("clip", "row", "col", "row AS r", "col AS g", "CAST(clip AS INT) AS b")
    view = remap.views(clips.where("row = 0").drop("row"), "cylindrical", 4, 2)
    lens = image.selectExpr("clip", "0 AS lens", "row AS sx", "col AS sy", "r", "g", "b")
    grid = lens.selectExpr("clip", "lens", "sx AS row", "sy AS col", "sx", "sy")
    for got, n in ((remap.sample(view, image, 6, 6, ("clip",)), 24), (remap.gather(grid, lens, ("clip",)), 108)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("b = clip").count() == n


def test_no_window_frame_is_read_to_its_end_for_each_row(spark):
    """A frame from the row to the end of a series costs the square of its length."""
    from tracklens.operators.asof import bracket
    from tracklens.sources.ranged import frames_at

    ticks = spark.createDataFrame([("a", x / 2) for x in range(-3, 9)] + [("c", 1.0)], "k string, at double")
    points = spark.createDataFrame([("a", float(t), t) for t in range(4)] + [("b", 1.0, 0)], "k string, t double, ord int")
    got = bracket(ticks, points, "k", "at", "t", "ord")
    assert sorted((r.at, r.a.t, r.b.t) for r in got.collect()) == [(x / 2, float(min(3, max(0, x // 2))), float(0 if x < 0 else min(3, x // 2 + 1))) for x in range(-3, 9)]
    index = spark.createDataFrame([("f", 0, 1.0 + i, i, 10 * i, 10) for i in range(3)], "path string, trak int, seconds double, sample long, off long, size long")
    met = frames_at(index, spark.createDataFrame([("f", 0.0), ("f", 2.5), ("f", 9.0), ("g", 1.0)], "path string, t double"))
    assert sorted((r.t, r.sample) for r in met.collect()) == [(0.0, 0), (2.5, 1), (9.0, 2)]
    for df in (got, met):
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().executedPlan().toString()


def test_smoothing_is_dealt_in_blocks(spark):
    """Blocks of any length give what one block gives, and a long clip is not one task's fold."""
    rng = random.Random(7)
    df = frames(spark, [axis(0.6, 0, 0.8, rng.uniform(-170, 170)) for _ in range(41)]).unionByName(spark.createDataFrame([("d", 0, None), ("d", 5, dict(zip("wxyz", axis(1, 0, 0, 9), strict=True)))], "clip string, frame long, q struct<w:double,x:double,y:double,z:double>"))
    whole, *others = ([(r.clip, r.frame, *r.qs) for r in stabilize.smooth(df, 6, block).orderBy("clip", "frame").collect()] for block in (1000, 41, 8, 1))
    assert len(whole) == 43 and all(x == whole for x in others)
    assert whole[-2][2:] == whole[-1][2:] == pytest.approx(axis(1, 0, 0, 9))
