"""Settings documents, folder moves, proxies, metadata files and stored maps: parts have documents, which line items change;
customers own folders; pages are camera files; events are frames; suppliers are clips, two of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import cache_key
from ..operators import catalog, remap, settings
from ..scratch import Scratch
from ..sinks import metadata
from ..sinks.cache import Cache
from ..sources.tables import read_calibration, read_imu_frames, read_imu_rate
from .queries import query, table
from .view_queries import _MAP, H, W, calibrations

FIELDS = [settings.Field("source_dir", "/home", ("src",)), settings.Field("output_dir", "/videos/new", ("out", "target"), ("/videos/old", "/films/old"))]
# documents of three versions, and some that cannot be read; the same expression in both engines
_DOC = """CASE WHEN p_partkey % 13 = 0 THEN '{broken' WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '[1, 2]'
  WHEN p_partkey % 3 = 0 THEN concat('{"src": "/in/', p_brand, '", "out": "', CASE WHEN p_size % 4 = 0 THEN '/films/old' ELSE concat('/o/', p_type) END, '", "note": {"size": ', p_size, '}}')
  WHEN p_partkey % 3 = 1 THEN concat('{"source_dir": ', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE concat('"/in/', p_name, '"') END, ', "target": "/t/', p_size, '", "out": "/not this"}')
  ELSE concat('{"output_dir": "', CASE WHEN p_size % 2 = 0 THEN '/videos/old' ELSE concat('/o/', p_size) END, '", "note": [', p_partkey, '], "out": "/nor this"}') END"""
_HAS = "list_contains(json_keys(j), '{}')"


def _value(f: settings.Field) -> str:
    cases = " ".join(f"WHEN {_HAS.format(n)} THEN json_extract_string(j, '$.{n}')" for n in (f.name, *f.older))
    return f"CASE {cases} ELSE '{f.default}' END"


_LOAD = f"""d AS (SELECT p_partkey, {_DOC} AS t FROM part), o AS (SELECT p_partkey, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN CAST(t AS JSON) ELSE CAST('{{}}' AS JSON) END AS j FROM d),
v AS (SELECT p_partkey, j, {_value(FIELDS[0])} AS source_dir, {_value(FIELDS[1])} AS o FROM o),
s AS (SELECT p_partkey, source_dir, CASE WHEN o IN ('/videos/old', '/films/old') THEN '/videos/new' ELSE o END AS output_dir, CAST(json_extract(j, '$.note') AS VARCHAR) AS note,
  coalesce(o IN ('/videos/old', '/films/old'), false) OR {_HAS.format('src')} OR {_HAS.format('out')} OR {_HAS.format('target')} AS migrated FROM v)"""
_CHANGE = """c AS (SELECT l_partkey AS p_partkey, arg_max('/c/' || l_orderkey, l_orderkey) FILTER (l_linenumber = 1) AS source_dir, arg_max('/d/' || l_orderkey, l_orderkey) FILTER (l_linenumber = 2) AS output_dir FROM lineitem GROUP BY 1),
n AS (SELECT s.p_partkey, coalesce(c.source_dir, s.source_dir) AS source_dir, coalesce(c.output_dir, s.output_dir) AS output_dir, note FROM s LEFT JOIN c USING (p_partkey))"""


def _loaded(s, d) -> DataFrame:
    return settings.load(table(s, d, "part").select("p_partkey", F.expr(_DOC).alias("document")), FIELDS)


def _changed(s, d) -> DataFrame:
    li = table(s, d, "lineitem").where("l_linenumber < 3")
    one = lambda k, p: F.when(F.col("l_linenumber") == k, F.concat(F.lit(p), "l_orderkey"))
    changes = li.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("seq"), one(1, "/c/").alias("source_dir"), one(2, "/d/").alias("output_dir"))
    return settings.change(_loaded(s, d), changes, FIELDS, "p_partkey")


@query("settings_load", f"WITH {_LOAD} SELECT * FROM s")
def _(s, d):
    return _loaded(s, d).withColumn("note", F.to_json(F.try_element_at("rest", F.lit("note")))).drop("rest")


@query("settings_save", f"""WITH {_LOAD}, {_CHANGE} SELECT p_partkey, '{{"source_dir":' || CASE WHEN source_dir IS NULL THEN 'null' ELSE '"' || source_dir || '"' END || ',"output_dir":"' || output_dir || '"' || coalesce(',"note":' || note, '') || '}}' AS document FROM n""")
def _(s, d):
    return settings.save(_changed(s, d), FIELDS)


@query("settings_round_trip", f"WITH {_LOAD}, {_CHANGE} SELECT p_partkey, source_dir, output_dir, note, false AS migrated FROM n")
def _(s, d):
    """Documents of the present version are read without migration and with the same values."""
    again = settings.load(settings.save(_changed(s, d), FIELDS), FIELDS)
    return again.withColumn("note", F.to_json(F.try_element_at("rest", F.lit("note")))).drop("rest")


@query("settings_moves", """SELECT c_custkey AS owner, '/cfg/old' AS src, '/cfg/new' AS dst FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, '/cache/old', '/cache/new' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0""")
def _(s, d):
    have = F.array_compact(F.array(*(F.when(F.col("c_custkey") % m == 0, F.lit(p)) for m, p in ((2, "/cfg/old"), (3, "/cfg/new"), (5, "/cache/old"), (7, "/cache/new")))))
    folders = table(s, d, "customer").select(F.col("c_custkey").alias("owner"), F.explode(have).alias("path"))
    return settings.moves(folders, [("/cfg/old", "/cfg/new"), ("/cache/old", "/cache/new")])


def _words(x: list[str]) -> str:
    return "', '".join(x)


@query("proxy_plan", f"""WITH f AS (SELECT page_id, '/v/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.OSV' ELSE '.mp4' END AS path, CASE WHEN page_id % 11 = 0 THEN '0' ELSE page_id || '.5' END AS m, page_id % 4 = 1 AS finished FROM pages),
p AS (SELECT page_id, path, 'preview' AS kind, '/cache/previews/' || sha1(path || ':' || m) || '.mp4' AS target FROM f WHERE finished
  UNION ALL SELECT page_id, path, 'navigation', '/cache/' || sha1(path || ':' || m || ':navproxy') || '_nav.mp4' FROM f WHERE page_id % 3 = 0)
SELECT path, kind, target, '/api/media?path=' || target AS url, CASE WHEN NOT (page_id % 5 = 0 AND kind = 'preview') THEN array_to_string(['ffmpeg', '-y', '-v', 'error', '-i', path] || CASE WHEN kind = 'preview' THEN ['{_words(catalog.PREVIEW)}'] ELSE ['{_words(catalog.NAVIGATION)}'] END || [target || '.part'], ' ') END AS argv FROM p""")
def _(s, d):
    k = F.col("page_id")
    files = table(s, d, "pages").select(k, F.concat(F.lit("/v/"), k, F.when(k % 3 == 0, ".OSV").otherwise(".mp4")).alias("path"), F.when(k % 11 != 0, F.concat(k, F.lit(".5"))).alias("mtime"), (k % 4 == 1).alias("finished"))
    there = files.where("page_id % 5 = 0").select(F.concat(F.lit("/cache/previews/"), cache_key(F.col("path"), F.coalesce("mtime", F.lit("0"))), F.lit(".mp4")).alias("path"))
    return catalog.proxies(files, there, "/cache").withColumn("argv", F.array_join("argv", " "))


# metadata files, written and read again

_FRAMES = """SELECT user_id AS clip, CAST(event_id AS INTEGER) AS frame, {us} AS timestamp, value AS qw, value / 3 AS qx, CASE WHEN event_id % 7 <> 0 THEN -value END AS qy, 1e-9 * event_id AS qz, CAST(event_id % 5 AS DOUBLE) AS ax_g, 0e0 AS ay_g, 1e0 AS az_g,
  CAST(event_id % 3200 AS DOUBLE) AS iso, CASE WHEN event_id % 2 = 0 THEN {hex} END AS shutter_raw, CAST(event_id % 9000 AS INTEGER) AS "color_temp_K", value + 0.25e0 AS "sensor_temp_C" FROM {events}"""


@query("metadata_frames_csv", _FRAMES.format(us="epoch_us(ts)", hex="'0' || lower(hex(event_id % 4096))", events="events"))
def _(s, d):
    out, e = Scratch(s, "metadata"), table(s, d, "events")
    sql = _FRAMES.format(us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)", hex="'0' || lower(hex(event_id % 4096))", events="{e}").replace('"', "`")
    metadata.write_metadata(out.root, frames=s.sql(sql, e=e))
    return read_imu_frames(s, out.path("imu_perframe")).withColumn("clip", metadata.clip_of(F.col("clip")).cast("long"))


@query("metadata_rates_csv", "SELECT user_id AS clip, CAST(event_id AS INTEGER) AS frame, CAST(k AS INTEGER) AS subidx, value AS qw, k / 7 AS qx, value * k AS qy, CAST(NULL AS DOUBLE) AS qz FROM events, range(0, 4) AS r(k)")
def _(s, d):
    out = Scratch(s, "metadata")
    e = table(s, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), "value", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("subidx"))
    metadata.write_metadata(out.root, rates=e.select("clip", "frame", "subidx", F.col("value").alias("qw"), (F.col("subidx") / 7).alias("qx"), (F.col("value") * F.col("subidx")).alias("qy"), F.lit(None).cast("double").alias("qz")))
    return read_imu_rate(s, out.path("imu_highrate")).withColumn("clip", metadata.clip_of(F.col("clip")).cast("long"))


@query("metadata_calibration_json", "SELECT s_suppkey AS clip, CAST(k AS INTEGER) AS lens, 1000e0 + s_acctbal AS fx, 1919e0 + k AS cx, s_name AS serial FROM supplier, range(0, 2) AS r(k) WHERE s_suppkey % 10 <> 0")
def _(s, d):
    """Clips without lenses give no rows when read."""
    out, k = Scratch(s, "metadata"), F.col("s_suppkey")
    lenses = F.when(k % 10 != 0, F.array(*(F.struct((F.col("s_acctbal") + 1000.0).alias("fx"), F.lit(1919.0 + i).alias("cx")) for i in range(2)))).otherwise(F.array())
    metadata.write_metadata(out.root, calibrations=table(s, d, "supplier").select(k.alias("clip"), F.col("s_name").alias("serial"), lenses.alias("lenses")))
    got = read_calibration(s, out.path("calibration")).withColumn("clip", metadata.clip_of(F.col("clip")).cast("long"))
    return got.select("clip", "serial", F.posexplode("lenses").alias("lens", "l")).select("clip", "lens", "l.fx", "l.cx", "serial")


# stored maps

_FILE = "s_suppkey - s_suppkey % 2"
_KEY = "sha1('/clips/' || file || ':' || mtime || ':' || '32')"


@query("map_cache", f"""WITH files AS (SELECT DISTINCT {_FILE} AS s_suppkey FROM supplier), {_MAP.replace("FROM supplier,", "FROM files,")},
c AS (SELECT s_suppkey AS clip, {_FILE} AS file FROM supplier), o AS (SELECT file, min(clip % 3) AS least FROM c GROUP BY file),
k AS (SELECT clip, c.file, CASE WHEN c.file % 10 = 0 THEN '2.0' ELSE '1.0' END AS mtime, CASE WHEN c.file % 10 = 0 THEN 3 WHEN least = 0 THEN 1 ELSE 2 END AS run FROM c JOIN o ON c.file = o.file)
SELECT k.clip, {_KEY} AS key, CAST(run AS INTEGER) AS run, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM k JOIN gr ON gr.clip = k.file GROUP BY ALL""")
def _(s, d):
    """Maps of a third of the clips, then of all, then of all after a tenth of the files changed: each key is computed once."""
    cache = Cache(s, Scratch(s, "map-cache").root, 'lens int, row int, col int, sx int, sy int, valid boolean, weight double', many=True)
    clips = table(s, d, "supplier").select(F.col("s_suppkey").alias("clip"), F.expr(_FILE).alias("file"))

    def keyed(some: DataFrame, mtime) -> DataFrame:
        return some.withColumn("key", cache_key(F.concat(F.lit("/clips/"), "file"), mtime, F.lit(str(W))))

    def compute(missing: DataFrame) -> DataFrame:
        files = missing.select("key", "file").distinct()
        lenses = calibrations(s, d, files.select("file").distinct().withColumnRenamed("file", "clip"))
        return remap.grids(files.join(lenses.withColumnRenamed("clip", "file"), "file"), W, H, ("key",))

    before = keyed(clips, F.lit("1.0"))
    after = keyed(clips, F.when(F.col("file") % 10 == 0, "2.0").otherwise("1.0"))
    for some in (before.where("clip % 3 = 0"), before, after, after):
        cache.fill(some, compute)
    maps = cache.rows().groupBy("key").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
    return after.join(maps, "key").join(cache.latest().select("key", "run"), "key").select("clip", "key", "run", "n", "n_valid")
