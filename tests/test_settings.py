"""Settings, stored results, metadata files and proxies against plain versions."""

import csv
import glob
import hashlib
import json
import random

import pytest


def test_settings_against_json_module(spark):
    from tracklens.operators import settings as S

    fields = [S.Field("source_dir", "/home", ("src",)), S.Field("output_dir", "/new", ("out", "target"), ("/old", "/older"))]
    rng = random.Random(3)
    docs = ["{broken", None, "", "[1]", "7", "null", "{}", '{"source_dir": null, "src": "/b"}']
    for _ in range(120):
        doc = {k: rng.choice(["/old", "/older", "/x y", "é\"q\"", None]) for k in ("source_dir", "src", "output_dir", "out", "target") if rng.random() < 0.4}
        docs.append(json.dumps(doc | {k: rng.choice([1, [1, {"z": None}], "t", None]) for k in ("extra", "more") if rng.random() < 0.5}))

    def model(text):
        try:
            d = json.loads(text)
        except (TypeError, ValueError):
            d = {}
        d = d if isinstance(d, dict) else {}
        out, changed, known = {}, False, set()
        for f in fields:
            names = (f.name, *f.older)
            known |= set(names)
            value = next((d[n] for n in names if n in d), f.default)
            changed |= value in f.legacy or any(n in d for n in f.older)
            out[f.name] = f.default if value in f.legacy else value
        return out, {k: v for k, v in d.items() if k not in known}, changed

    frame = spark.createDataFrame(list(enumerate(docs)), "k int, document string")
    loaded = S.load(frame, fields).cache()
    got = {r.k: ({"source_dir": r.source_dir, "output_dir": r.output_dir}, json.loads(r.rest), r.migrated) for r in loaded.selectExpr("k", "source_dir", "output_dir", "to_json(rest, map('ignoreNullFields', 'false')) AS rest", "migrated").collect()}
    assert got == {k: model(t) for k, t in enumerate(docs)}
    saved = {r.k: json.loads(r.document) for r in S.save(loaded, fields).collect()}
    assert saved == {k: model(t)[0] | model(t)[1] for k, t in enumerate(docs)}
    changes = [(0, 1, "/a", None), (0, 3, None, "/c"), (0, 2, "/b", "/no"), (5, 1, None, None), (999, 1, "/x", "/y")]
    now = {r.k: (r.source_dir, r.output_dir) for r in S.change(loaded, spark.createDataFrame(changes, "k int, seq int, source_dir string, output_dir string"), fields, "k").collect()}
    assert now[0] == ("/b", "/c") and all(now[k] == tuple(model(t)[0].values()) for k, t in enumerate(docs) if k) and len(now) == len(docs)
    assert S.load(frame.limit(0), fields).count() == 0
    folders = spark.createDataFrame([(1, "/o"), (1, "/o"), (2, "/o"), (2, "/n"), (3, "/n")], "owner int, path string")
    assert [tuple(r) for r in S.moves(folders, [("/o", "/n")]).collect()] == [(1, "/o", "/n")]


def test_cache_computes_what_is_missing_or_spoilt(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracklens.sinks.cache import Cache

    cache, asked = Cache(spark, f"file://{tmp_path}/c", "i int, v long"), []

    def compute(missing):
        asked.append(sorted({r.key for r in missing.collect()}))
        return missing.select("key", "seed").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), (F.col("seed") * 100 + F.col("i")).alias("v"))

    keys = lambda *n: spark.createDataFrame([(hashlib.sha1(str(x).encode()).hexdigest(), x) for x in n], "key string, seed int")
    name = lambda *n: sorted(hashlib.sha1(str(x).encode()).hexdigest() for x in n)
    assert cache.fill(keys(), compute) == 1 and not asked
    cache.fill(keys(1, 2, 2, 3), compute)
    cache.fill(keys(2, 3, 4), compute)
    cache.fill(keys(1, 2, 3, 4), compute)
    assert asked == [name(1, 2, 3), name(4)]
    want = sorted((x, i, x * 100 + i) for x in (1, 2, 3, 4) for i in range(10))
    assert sorted((r.seed, r.i, r.v) for r in cache.read(keys(1, 2, 3, 4)).collect()) == want
    # rows that are not what the ledger says are computed again, and no others
    bad = name(2)[0]
    spark.createDataFrame([(0, 7)], "i int, v long").write.mode("overwrite").parquet(f"file://{tmp_path}/c/rows/key={bad}")
    cache.fill(keys(1, 2, 3, 4), compute, content=False)
    assert len(asked) == 2
    cache.fill(keys(1, 2, 3, 4), compute)
    assert asked[2:] == [[bad]] and sorted((r.seed, r.i, r.v) for r in cache.read(keys(1, 2, 3, 4)).collect()) == want

    # a run that fails leaves no key that counts as stored
    def fails(missing):
        return compute(missing).withColumn("v", F.when(F.col("i") == 9, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        cache.fill(keys(5), fails)
    assert cache.valid(keys(5), content=False).count() == 0
    cache.fill(keys(5), compute)
    assert cache.read(keys(5)).count() == 10


def test_cache_of_many_small_results(spark, tmp_path):
    """Runs share files, however many keys they have; a key's rows are those of its last run."""
    from pyspark.sql import functions as F

    from tracklens.sinks.cache import Cache

    cache, asked = Cache(spark, f"file://{tmp_path}/c", "i int, v long", many=True), []

    def compute(missing):
        asked.append(missing.count())
        return missing.repartition(1).select("key", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), (F.col("seed") * 100 + F.col("i")).alias("v"))

    keys = lambda a, b: spark.range(a, b).select(F.sha1(F.col("id").cast("string")).alias("key"), F.col("id").alias("seed"))
    for a, b in ((0, 200), (100, 300), (0, 300)):
        cache.fill(keys(a, b), compute)
    assert asked == [200, 100]
    assert len(glob.glob(f"{tmp_path}/c/rows/**/*.parquet", recursive=True)) <= 4
    want = sorted((x, i, x * 100 + i) for x in range(300) for i in range(3))
    assert sorted((r.seed, r.i, r.v) for r in cache.read(keys(0, 300)).collect()) == want
    # a run whose rows were lost is computed again; what is left of its number is replaced, and earlier rows are not given
    spark.createDataFrame([(0, 7, hashlib.sha1(b"0").hexdigest())], "i int, v long, key string").write.mode("append").parquet(f"file://{tmp_path}/c/rows/run=2")
    spark.createDataFrame([(0, 7, "left")], "i int, v long, key string").write.parquet(f"file://{tmp_path}/c/rows/run=3")
    assert cache.rows().count() == 900
    spark.createDataFrame([], "i int, v long, key string").write.mode("overwrite").parquet(f"file://{tmp_path}/c/rows/run=2")
    assert cache.fill(keys(0, 300), compute) == 3 and asked == [200, 100, 100]
    assert sorted((r.seed, r.i, r.v) for r in cache.read(keys(0, 300)).collect()) == want

    def fails(missing):
        return compute(missing).withColumn("v", F.when(F.col("i") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        cache.fill(keys(300, 310), fails)
    assert cache.valid(keys(300, 310), content=False).count() == 0 and cache.fill(keys(300, 310), compute) == 4
    assert cache.read(keys(0, 310)).count() == 930


def test_metadata_files(spark, tmp_path):
    from tracklens.sinks import metadata

    frames = spark.createDataFrame([("a/b c", 1, 7, 0.1, "0f"), ("a/b c", 0, None, None, None), ("x", 5, 2, 1e-9, "00")], "clip string, frame int, timestamp long, qw double, shutter_raw string")
    rates = spark.createDataFrame([("x", 1, 1, 0.5, 0.0, 0.25, 1.0), ("x", 1, 0, 1.0, 0.0, None, 0.0)], "clip string, frame int, subidx int, qw double, qx double, qy double, qz double")
    root = f"file://{tmp_path}/m"
    metadata.write_metadata(root, frames, rates)
    read = lambda kind: {f.split("clip=")[1].split("/")[0]: list(csv.reader(open(f))) for f in glob.glob(f"{tmp_path}/m/{kind}/*/*.csv")}
    got = read("imu_perframe")
    assert len(got) == 2 and all(x[0] == list(metadata.FRAME_HEADER) for x in got.values())
    assert [r[:3] for r in got["a%2Fb c"][1:]] == [["0", "", ""], ["1", "7", "0.1"]] and got["x"][1][2] == "1.0E-9" and got["x"][1][10] == "00"
    assert read("imu_highrate")["x"] == [metadata.RATE_HEADER, ["1", "0", "1.0", "0.0", "", "0.0"], ["1", "1", "0.5", "0.0", "0.25", "1.0"]]
    metadata.write_metadata(f"{root}-empty", frames.limit(0), rates.limit(0))


def test_metadata_files_of_many_clips_are_shared_out(spark, tmp_path):
    """Small rows do not bring the files of all clips to one task."""
    from tracklens.sinks import metadata

    clips = spark.range(40).selectExpr("id AS clip", "0 AS frame", "0 AS subidx", "1.0D AS qw", "0.0D AS qx", "0.0D AS qy", "0.0D AS qz")
    metadata.write_metadata(f"file://{tmp_path}/m", clips.drop("subidx"), clips, clips.selectExpr("clip", "'s' AS serial", "array(named_struct('fx', 1.0D)) AS lenses"))
    for kind, n in (("imu_perframe", 40), ("imu_highrate", 40), ("calibration", 40)):
        files = [f for f in glob.glob(f"{tmp_path}/m/{kind}/*/*") if not f.endswith(".crc")]
        assert len(files) == n and len({f.split("/part-")[1][:5] for f in files}) == 4


def test_proxies(spark):
    from tracklens.operators import catalog

    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    files = spark.createDataFrame([("/v/é a.OSV", "12.5", True), ("/v/b.mp4", None, True), ("/v/b.mp4", None, True), ("/v/c.mp4", "1.0", False)], "path string, mtime string, finished boolean")
    there = spark.createDataFrame([(f"/k/previews/{sha('/v/b.mp4:0')}.mp4",)] * 2, "path string")
    got = {(r.path, r.kind): r for r in catalog.proxies(files, there, "/k").collect()}
    assert set(got) == {("/v/é a.OSV", "preview"), ("/v/é a.OSV", "navigation"), ("/v/b.mp4", "preview")}
    assert got["/v/b.mp4", "preview"].argv is None
    nav = got["/v/é a.OSV", "navigation"]
    assert nav.target == f"/k/{sha('/v/é a.OSV:12.5:navproxy')}_nav.mp4" and nav.argv[-1] == nav.target + ".part" and nav.argv[:6] == ["ffmpeg", "-y", "-v", "error", "-i", "/v/é a.OSV"]
