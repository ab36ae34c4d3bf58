"""Folder trees, shortcuts and tails against plain versions."""

import os


def test_tree_listing_and_shortcuts(spark, tmp_path):
    from tracklens.operators import catalog

    paths = ["/a/B/x.osv", "/a/b/y.OSV", "/a/c.gpx", "/a/.hidden/z.osv", "/a/.h.osv", "/top.osv", "a/b/deep/er/q.txt"]
    index = catalog.tree(spark.createDataFrame([(p, 1) for p in paths], "path string, size int")).cache()
    want = set()
    for p in paths:
        p = "/" + p.strip("/")
        is_dir = False
        while p != "/":
            up = os.path.dirname(p)
            want.add((up, None if up == "/" else os.path.dirname(up), os.path.basename(p), p, is_dir))
            p, is_dir = up, True
    assert {(r.dir, r.parent, r.name, r.path, r.is_dir) for r in index.collect()} == want
    shown = [(r.name, r.is_dir, r.parent) for r in catalog.listing(index, "/a", "/a", "osv, .GPX").collect()]
    assert shown == [("B", True, None), ("b", True, None), ("c.gpx", False, None)]
    assert [(r.name, r.parent) for r in catalog.listing(index, "/a/b", "/a", "osv").collect()] == [("deep", "/a"), ("y.OSV", "/a")]
    src = lambda *rows: spark.createDataFrame([(f"{p}!", p, k, i) for i, (p, k) in enumerate(rows)], "label string, path string, kind string, ord int")
    got = catalog.shortcuts([src(("/a/b", "home"), ("/top.osv", "home")), src(("/a", "removable"), ("/a/b", "removable")), src(("/gone", "camera"))], index)
    assert sorted((r.path, r.kind) for r in got.collect()) == [("/a", "removable"), ("/a/b", "home")]


def test_error_tail_and_aliases(spark):
    from pyspark.sql import functions as F

    from tracklens.operators import catalog

    lines = [("p", k, f"line {k} " + "y" * (k % 30)) for k in range(100)] + [("q", 0, "  only  "), ("r", 0, "")]
    got = {r.job: r.tail for r in catalog.error_tail(spark.createDataFrame(lines[::-1], "job string, seq int, line string")).collect()}
    text = lambda j: "".join(f"{x}\n" for _, _, x in [r for r in lines if r[0] == j][-40:]).strip()[-800:]
    assert got == {j: text(j) for j in "pqr"}
    maps = spark.createDataFrame([(0, {"b": "1", "a": "2"}), (1, {"b": None, "a": "2"}), (2, {"c": "3"}), (3, None)], "k int, m map<string,string>")
    assert [r.v for r in maps.select("k", catalog.first_present(F.col("m"), "b", "a").alias("v")).orderBy("k").collect()] == ["1", None, None, None]
