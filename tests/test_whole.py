"""Whole-table forms of queries whose SQL covers a part of the table only, against brute force."""


def test_stsc_expand_all(spark, tmp_path):
    from tracklens.plans.queries import QUERIES

    orders = [(10 * c + i, c) for c in (7, 200, 201, 950) for i in range(1, 5)]
    items = [(o, n, 1, 1, float(o % 7 + n), 1.0) for o, c in orders for n in range(1, c % 3 + 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = set()
    for clip in {c for _, c in orders}:
        keys = sorted(o for o, c in orders if c == clip)
        sizes, sample = [int(x[4]) for x in sorted(items) if x[0] in keys], 0
        for chunk, key in enumerate(keys, 1):
            off = key * 1000
            for _ in range(2 if chunk < 3 else 3):
                if sample < len(sizes):
                    want.add((clip, sample, chunk, off, sizes[sample], sample * 40))
                    off, sample = off + sizes[sample], sample + 1
    got = [(r.clip, r.sample, r.chunk, r.off, r.size, r.pts) for r in QUERIES["stsc_expand_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {r[0] for r in got} == {7, 200, 201, 950}


def test_imu_resample_all(spark, tmp_path):
    import math
    import random

    from tracklens.plans.queries import QUERIES

    rng = random.Random(4)
    sizes = {0: 1, 1: 12, 2: 71}
    rows = [(100 * c + i, [rng.gauss(0, 1) for _ in range(4)], c) for c, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r[0], r[1]): r[2:] for r in QUERIES["imu_resample_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {(c, k) for c, n in sizes.items() for k in range(math.floor((n - 1) * 0.8) + 1)}
    for (c, k), q in got.items():
        own = [r[1] for r in rows if r[2] == c]
        at = min(k / 0.8, sizes[c] - 1)
        i = min(int(at), sizes[c] - 1)
        a, b = ([x / math.hypot(*v) for x in v] for v in (own[i], own[min(i + 1, sizes[c] - 1)]))
        d = sum(x * y for x, y in zip(a, b))
        b, d, f = [x * math.copysign(1, d) for x in b], min(abs(d), 1), at - i
        u, v = (1 - f, f) if d > 0.9995 else (math.sin((1 - f) * math.acos(d)) / math.sin(math.acos(d)), math.sin(f * math.acos(d)) / math.sin(math.acos(d)))
        want = [u * x + v * y for x, y in zip(a, b)]
        want = [x / math.hypot(*want) for x in want]
        assert abs(abs(sum(x * y for x, y in zip(want, q))) - 1) < 1e-4, (c, k)


def test_lens_lut_scale_all(spark, tmp_path):
    import math

    from tracklens.plans.queries import _DIST, QUERIES

    keys = [1, 7, 8, 9, 16, 2000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: (r.lens, r.scale) for r in QUERIES["lens_lut_scale_all"](spark, str(tmp_path)).collect()}
    t0, t = math.radians(85), math.radians(90)
    poly = t0 + sum(k * t0 ** (2 * i + 3) for i, k in enumerate(_DIST))
    slope = 1 + sum((2 * i + 3) * k * t0 ** (2 * i + 2) for i, k in enumerate(_DIST))
    radius = 1048.43787 * (poly + slope * (t - t0))
    assert set(got) == set(keys)
    for key, (n, scale) in got.items():
        mean = sum(math.hypot(1800 * math.cos(i / 3) + n, 1800 * math.sin(i / 3)) for i in range(1, 14)) / 13
        assert n == key % 8 and abs(scale - mean / radius) < 2e-6
