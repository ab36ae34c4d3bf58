"""The telemetry queries over the driver's tables, each with its SQL.

Roles: events is a track or sample series (user_id the clip), embeddings[0..3] an orientation, conversations
frames with sub-samples, orders/lineitem chunks with samples, nation/region a box hierarchy, pages paths,
documents payloads. Floats are rounded on both sides, with + 0 against negative zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, lens, media
from ..functions import rotation as R
from ..operators import camm, catalog, imu, progress, stabilize, track

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n) + F.lit(0.0)


# tracks

START_US, DURATION_S, RATE = 1_704_153_600_000_000, 864_000.0, 1 / 21_600
DAY_S = 86_400.0
_T = """track AS (SELECT user_id AS track_id, epoch_us(ts) AS t, 47.9e0 + value / 1e4 AS lat, 7.15e0 + (event_id % 1000) / 1e4 AS lon,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 250e0 + value / 10e0 END AS ele, event_id AS ord FROM events)"""
_SEG = "seg AS (SELECT *, lead(t) OVER w AS nt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(ele) OVER w AS nele, row_number() OVER w AS rn FROM track WINDOW w AS (PARTITION BY track_id ORDER BY t, ord))"


def _resample_sql(offset_us: int = 0) -> str:
    return f"""{_T}, {_SEG},
ticks AS (SELECT DISTINCT track_id, i, least(i / (1e0 / 21600e0), 864000e0) AS t_rel FROM track, unnest(range(0, CAST(floor(864000e0 * (1e0 / 21600e0)) AS BIGINT) + 1)) AS r(i)),
tk AS (SELECT *, {START_US} + CAST(round_even(t_rel * 1e6, 0) AS BIGINT) AS t, {START_US} + CAST(round_even(t_rel * 1e6, 0) AS BIGINT) + {offset_us} AS p FROM ticks),
one AS (SELECT * FROM seg WHERE rn = 1),
hit AS (SELECT tk.track_id, tk.i, tk.t_rel, tk.t, tk.p, coalesce(s.t, one.t) AS ta, coalesce(s.lat, one.lat) AS la, coalesce(s.lon, one.lon) AS lo, coalesce(s.ele, CASE WHEN s.t IS NULL THEN one.ele END) AS el,
        s.nt, s.nlat, s.nlon, s.nele, s.rn FROM tk ASOF LEFT JOIN seg AS s ON tk.track_id = s.track_id AND tk.p >= s.t JOIN one ON one.track_id = tk.track_id),
pos AS (SELECT track_id, i, t_rel, t, CASE WHEN nt IS NULL OR p <= ta AND rn = 1 THEN la ELSE la + (nlat - la) * ((p - ta) / (nt - ta)) END AS lat,
        CASE WHEN nt IS NULL OR p <= ta AND rn = 1 THEN lo ELSE lo + (nlon - lo) * ((p - ta) / (nt - ta)) END AS lon,
        CASE WHEN nt IS NULL OR p <= ta AND rn = 1 THEN el ELSE el + (nele - el) * ((p - ta) / (nt - ta)) END AS ele FROM hit)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _brg(a: str, b: str, c: str, d: str) -> str:
    y, x = f"sin(radians({d} - {b})) * cos(radians({c}))", f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
    return f"((degrees(atan2({y}, {x})) + 360e0) % 360e0)"


_SPEED = f"""raw AS (SELECT *, CASE WHEN lag(t_rel) OVER w IS NOT NULL THEN {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / (t_rel - lag(t_rel) OVER w) END AS v FROM pos WINDOW w AS (PARTITION BY track_id ORDER BY i)),
ticks2 AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN coalesce(v, lead(v) OVER w) ELSE v END AS speed FROM raw WINDOW w AS (PARTITION BY track_id ORDER BY i))"""


def _track(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.lit(47.9) + F.col("value") / 1e4).alias("lat"), (F.lit(7.15) + F.col("event_id") % 1000 / 1e4).alias("lon"), F.when(F.col("event_id") % 7 != 0, F.lit(250.0) + F.col("value") / 10).alias("ele"), F.col("event_id").alias("ord"))


def _windows(t: DataFrame) -> DataFrame:
    return t.select("track_id").distinct().select("track_id", F.lit(START_US).alias("start"), F.lit(DURATION_S).alias("duration_s"))


def _ticks(spark: SparkSession, d: str, offset_s: float = 0.0) -> DataFrame:
    t = _track(spark, d)
    return track.resample(t, _windows(t), RATE, offset_s)


def _place(ticks: DataFrame, *more) -> DataFrame:
    return ticks.select("track_id", "i", "t", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("ele", 4).alias("ele"), *more)


_PLACE = "track_id, i, t, round(lat, 7) + 0e0 AS lat, round(lon, 7) + 0e0 AS lon, round(ele, 4) + 0e0 AS ele"


@query("track_resample", f"WITH {_resample_sql()} SELECT {_PLACE} FROM pos")
def _(s, d):
    return _place(_ticks(s, d))


@query("track_resample_offset", f"WITH {_resample_sql(5_000_000_000)} SELECT {_PLACE} FROM pos")
def _(s, d):
    return _place(_ticks(s, d, 5000.0))


@query("track_resample_speed", f"WITH {_resample_sql()}, {_SPEED} SELECT {_PLACE}, round(speed, 4) + 0e0 AS speed FROM ticks2")
def _(s, d):
    return _place(_ticks(s, d), rnd("speed", 4).alias("speed"))


@query("track_coverage", f"""WITH {_T}, g AS (SELECT *, (lead(t) OVER (PARTITION BY track_id ORDER BY t, ord) - t) / 1e6 AS dt FROM track),
a AS (SELECT track_id, min(t) AS f, max(t) AS l, count(*) FILTER (t BETWEEN {START_US} AND {START_US} + 864000000000) AS n, count(*) FILTER (dt > 86400e0) AS n_gaps FROM g GROUP BY 1),
o AS (SELECT *, greatest(0e0, (least({START_US} + 864000000000, l) - greatest({START_US}, f)) / 1e6) AS overlap FROM a)
SELECT track_id, round(overlap, 6) AS overlap_s, round(overlap / 864000e0 * 100e0, 6) AS coverage_pct, n AS n_points_in_window,
  CASE WHEN overlap / 864000e0 * 100e0 >= 90e0 THEN 0e0 ELSE round((f - {START_US}) / 1e6, 6) + 0e0 END AS suggested_offset_s, n_gaps FROM o""")
def _(s, d):
    t = _track(s, d)
    got = track.coverage(t, _windows(t), DAY_S)
    return got.select("track_id", rnd("overlap_s").alias("overlap_s"), rnd("coverage_pct").alias("coverage_pct"), "n_points_in_window", rnd("suggested_offset_s").alias("suggested_offset_s"), F.size("gaps_gt_5s").cast("long").alias("n_gaps"))


@query("track_points_in_window", f"WITH {_T} SELECT track_id, t, ord FROM track WHERE t BETWEEN {START_US} AND {START_US} + 864000000000")
def _(s, d):
    return _track(s, d).where(F.col("t").between(START_US, START_US + int(DURATION_S * 1e6))).select("track_id", "t", "ord")


_GAPS = f"WITH {_T}, g AS (SELECT track_id, t AS start, lead(t) OVER (PARTITION BY track_id ORDER BY t, ord) AS stop FROM track)"


@query("track_gap_list", f"{_GAPS} SELECT track_id, start, stop, round((stop - start) / 1e6, 6) AS duration_s FROM g WHERE (stop - start) / 1e6 > 86400e0")
def _(s, d):
    return track.gaps(_track(s, d), DAY_S).select("track_id", "start", F.col("end").alias("stop"), rnd("duration_s").alias("duration_s"))


@query("track_gaps", f"{_GAPS} SELECT track_id, count(*) AS n_gaps, round(max((stop - start) / 1e6), 6) AS longest_s FROM g WHERE (stop - start) / 1e6 > 86400e0 GROUP BY 1")
def _(s, d):
    return track.gaps(_track(s, d), DAY_S).groupBy("track_id").agg(F.count("*").alias("n_gaps"), rnd(F.max("duration_s")).alias("longest_s"))


_STEP = f"WITH {_T}, s AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM track WINDOW w AS (PARTITION BY track_id ORDER BY t, ord))"


def _steps(s, d):
    w = track.by_time()
    return _track(s, d).withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)}).where("plat IS NOT NULL")


@query("track_step_distance", f"{_STEP} SELECT track_id, ord, round({_hav('plat', 'plon', 'lat', 'lon')}, 3) + 0e0 AS metres FROM s WHERE plat IS NOT NULL")
def _(s, d):
    return _steps(s, d).select("track_id", "ord", rnd(geo.haversine_m(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("track_bearing", f"{_STEP} SELECT track_id, ord, round({_brg('plat', 'plon', 'lat', 'lon')}, 5) + 0e0 AS bearing FROM s WHERE plat IS NOT NULL AND (plat <> lat OR plon <> lon)")
def _(s, d):
    got = _steps(s, d).where("plat <> lat OR plon <> lon")
    return got.select("track_id", "ord", rnd(geo.bearing_deg(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 5).alias("bearing"))


_ENU = f"""WITH {_resample_sql()}, {_SPEED},
n AS (SELECT *, lead(i) OVER w IS NULL AS last, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon, lead(ele) OVER w AS bele, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon, lag(ele) OVER w AS aele FROM ticks2 WINDOW w AS (PARTITION BY track_id ORDER BY i)),
p AS (SELECT track_id, i, t, lat, lon, ele, speed, CASE WHEN last THEN alat ELSE lat END AS la, CASE WHEN last THEN alon ELSE lon END AS lo, CASE WHEN last THEN aele ELSE ele END AS el, CASE WHEN last THEN lat ELSE blat END AS lb, CASE WHEN last THEN lon ELSE blon END AS ob, CASE WHEN last THEN ele ELSE bele END AS eb FROM n),
b AS (SELECT *, CASE WHEN (la <> lb OR lo <> ob) AND coalesce(speed, 0) <> 0 THEN {_brg('la', 'lo', 'lb', 'ob')} END AS brg FROM p),
v AS (SELECT *, coalesce(speed * sin(radians(brg)), 0e0) AS vel_e, coalesce(speed * cos(radians(brg)), 0e0) AS vel_n, coalesce((eb - el) / 21600e0, 0e0) AS vel_up FROM b)"""


@query("track_enu_velocity", f"{_ENU} SELECT track_id, i, round(vel_e, 5) + 0e0 AS vel_e, round(vel_n, 5) + 0e0 AS vel_n, round(vel_up, 6) + 0e0 AS vel_up FROM v")
def _(s, d):
    return track.velocity(_ticks(s, d), 21_600.0).select("track_id", "i", rnd("vel_e", 5).alias("vel_e"), rnd("vel_n", 5).alias("vel_n"), rnd("vel_up", 6).alias("vel_up"))


_FIELDS = """SELECT track_id, i, round(t / 1e6, 6) AS epoch, CASE WHEN ele IS NULL THEN 2 ELSE 3 END AS fix_type, round(lat, 7) + 0e0 AS lat, round(lon, 7) + 0e0 AS lon, round(coalesce(ele, 0e0), 3) + 0e0 AS alt, 5e0 AS h_acc, 8e0 AS v_acc, round(vel_e, 4) + 0e0 AS vel_e, 1e0 AS speed_acc FROM v"""


def _fields(s, d, got: DataFrame) -> DataFrame:
    return got.select("track_id", "i", rnd("epoch").alias("epoch"), "fix_type", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("alt", 3).alias("alt"), "h_acc", "v_acc", rnd("vel_e", 4).alias("vel_e"), "speed_acc")


@query("camm_packet_fields", f"{_ENU} {_FIELDS}")
def _(s, d):
    return _fields(s, d, camm.packet_fields(track.velocity(_ticks(s, d), 21_600.0)))


@query("camm_unpack", f"{_ENU} SELECT track_id, i, round(t / 1e6, 6) AS epoch, CASE WHEN ele IS NULL THEN 2 ELSE 3 END AS fix_type, round(lat, 7) + 0e0 AS lat, round(lon, 7) + 0e0 AS lon, 60 AS n_bytes FROM v")
def _(s, d):
    p = camm.packets(camm.packet_fields(track.velocity(_ticks(s, d), 21_600.0)))
    return camm.unpack(p.withColumn("n_bytes", F.length("packet"))).select("track_id", "i", rnd("epoch").alias("epoch"), "fix_type", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), "n_bytes")


# a coarse clock makes ticks collide, so that the strictly increasing rule has work to do
_TICK = f"""WITH {_T}, n AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, ord) - 1 AS i, CAST(round_even((t - {START_US}) / 1e6 / 86400e0, 0) AS BIGINT) AS raw FROM track),
k AS (SELECT track_id, i, i + max(greatest(0, raw) - i) OVER (PARTITION BY track_id ORDER BY i) AS tick FROM n),
q AS (SELECT *, coalesce(lead(tick) OVER w - tick, tick - lag(tick) OVER w, 1) AS duration FROM k WINDOW w AS (PARTITION BY track_id ORDER BY i))"""
_RUN = f"""{_TICK}, c AS (SELECT *, CASE WHEN lag(duration) OVER w = duration THEN 0 ELSE 1 END AS c FROM q WINDOW w AS (PARTITION BY track_id ORDER BY i)),
r AS (SELECT track_id, duration, CAST(sum(c) OVER (PARTITION BY track_id ORDER BY i) - 1 AS BIGINT) AS run FROM c),
rle AS (SELECT track_id, run, count(*) AS cnt, min(duration) AS duration FROM r GROUP BY ALL)"""


def _coarse(s, d) -> DataFrame:
    t = _track(s, d).withColumns({"i": F.row_number().over(track.by_time()).cast("long") - 1, "t_rel": (F.col("t") - START_US) / 1e6 / DAY_S})
    return camm.durations(camm.ticks(t, timescale=1), timescale=1)


@query("camm_ticks", f"{_TICK} SELECT track_id, CAST(i AS BIGINT) AS i, CAST(tick AS BIGINT) AS tick FROM k")
def _(s, d):
    return _coarse(s, d).select("track_id", "i", "tick")


@query("camm_durations", f"{_TICK} SELECT track_id, CAST(i AS BIGINT) AS i, CAST(duration AS BIGINT) AS duration FROM q")
def _(s, d):
    return _coarse(s, d).select("track_id", "i", "duration")


@query("camm_runs", f"{_RUN} SELECT track_id, run, cnt, CAST(duration AS BIGINT) AS duration FROM rle")
def _(s, d):
    return camm.runs(_coarse(s, d))


@query("pts_from_runs", f"{_TICK} SELECT track_id, CAST(i AS BIGINT) AS sample, CAST(sum(duration) OVER (PARTITION BY track_id ORDER BY i) - duration AS BIGINT) AS pts FROM q")
def _(s, d):
    return camm.pts(camm.runs(_coarse(s, d)))


# orientations

_N4 = "sqrt(a*a + b*b + c*c + d*d)"
_Q = f"""raw AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
q AS (SELECT vec_id, label, a / {_N4} AS w, b / {_N4} AS x, c / {_N4} AS y, d / {_N4} AS z FROM raw)"""
_QN = f"{_Q}, nx AS (SELECT *, lead(w) OVER o AS w2, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(z) OVER o AS z2 FROM q WINDOW o AS (PARTITION BY label ORDER BY vec_id))"


def _quats(s, d) -> DataFrame:
    e = table(s, d, "embeddings")
    q = [F.col("embedding")[i].cast("double") for i in range(4)]
    return e.select("vec_id", "label", R.pack_quat(R.normalize(q)).alias("q"))


def _pairs(s, d) -> DataFrame:
    return _quats(s, d).withColumn("p", F.lead("q").over(Window.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")


def _four(q: list, n: int = 6) -> list[Column]:
    return [rnd(c, n).alias(k) for c, k in zip(q, "wxyz", strict=True)]


_R4 = "round({0}, 6) + 0e0 AS w, round({1}, 6) + 0e0 AS x, round({2}, 6) + 0e0 AS y, round({3}, 6) + 0e0 AS z"


@query("quat_normalize", f"WITH {_Q} SELECT vec_id, {_R4.format('w', 'x', 'y', 'z')} FROM q")
def _(s, d):
    return _quats(s, d).select("vec_id", *_four(R.quat("q")))


@query("quat_dot", f"WITH {_QN} SELECT vec_id, round(w*w2 + x*x2 + y*y2 + z*z2, 6) + 0e0 AS dot FROM nx WHERE w2 IS NOT NULL")
def _(s, d):
    return _pairs(s, d).select("vec_id", rnd(R.dot(R.quat("q"), R.quat("p"))).alias("dot"))


@query("quat_mul", f"WITH {_QN} SELECT vec_id, {_R4.format('w*w2 - x*x2 - y*y2 - z*z2', 'w*x2 + x*w2 + y*z2 - z*y2', 'w*y2 - x*z2 + y*w2 + z*x2', 'w*z2 + x*y2 - y*x2 + z*w2')} FROM nx WHERE w2 IS NOT NULL")
def _(s, d):
    return _pairs(s, d).select("vec_id", *_four(R.multiply(R.quat("q"), R.quat("p"))))


@query("quat_conj", f"WITH {_Q} SELECT vec_id, {_R4.format('w', '-x', '-y', '-z')} FROM q")
def _(s, d):
    return _quats(s, d).select("vec_id", *_four(R.conjugate(R.quat("q"))))


_M = ["1 - 2*(y*y + z*z)", "2*(x*y - w*z)", "2*(x*z + w*y)", "2*(x*y + w*z)", "1 - 2*(x*x + z*z)", "2*(y*z - w*x)", "2*(x*z - w*y)", "2*(y*z + w*x)", "1 - 2*(x*x + y*y)"]
_MAT = "m AS (SELECT vec_id, label, " + ", ".join(f"{e} AS m{i // 3}{i % 3}" for i, e in enumerate(_M)) + " FROM q)"


@query("quat_matrix", f"WITH {_Q}, {_MAT} SELECT vec_id, " + ", ".join(f"round(m{i // 3}{i % 3}, 6) + 0e0 AS m{i // 3}{i % 3}" for i in range(9)) + " FROM m")
def _(s, d):
    m = R.to_matrix(R.quat("q"))
    return _quats(s, d).select("vec_id", *(rnd(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def _euler_sql(src: str, m: Callable[[int, int], str] = lambda i, j: f"m{i}{j}") -> str:
    p = f"asin(greatest(-1e0, least(1e0, {m(1, 2)})))"
    free = f"abs(cos({p})) > 1e-6"
    return (f"round(degrees(CASE WHEN {free} THEN atan2({m(0, 2)}, {m(2, 2)}) ELSE atan2(-{m(2, 0)}, {m(0, 0)}) END), 5) + 0e0 AS yaw, round(-degrees({p}), 5) + 0e0 AS pitch, "
            f"round(degrees(CASE WHEN {free} THEN atan2({m(1, 0)}, {m(1, 1)}) ELSE 0e0 END), 5) + 0e0 AS roll FROM {src}")


def _angles(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(rnd(c, 5).alias(c) for c in ("yaw", "pitch", "roll")))


@query("euler_from_quat", f"WITH {_Q}, {_MAT} SELECT vec_id, {_euler_sql('m')}")
def _(s, d):
    got = _quats(s, d).select("vec_id", R.pack_matrix(R.to_matrix(R.quat("q"))).alias("m"))
    return _angles(got.select("vec_id", *(c.alias(n) for c, n in zip(R.euler(R.matrix("m")), ("yaw", "pitch", "roll"), strict=True))), "vec_id")


@query("quat_slerp", f"""WITH {_QN}, dt AS (SELECT *, w*w2 + x*x2 + y*y2 + z*z2 AS d0 FROM nx WHERE w2 IS NOT NULL),
k AS (SELECT *, CASE WHEN d0 < 0 THEN -1e0 ELSE 1e0 END AS sg, least(abs(d0), 1e0) AS dd, acos(least(abs(d0), 1e0)) AS an FROM dt),
f AS (SELECT *, CASE WHEN dd > 0.9995e0 THEN 0.7e0 ELSE sin(0.7e0 * an) / sin(an) END AS fa, sg * CASE WHEN dd > 0.9995e0 THEN 0.3e0 ELSE sin(0.3e0 * an) / sin(an) END AS fb FROM k),
g AS (SELECT vec_id, w*fa + w2*fb AS a, x*fa + x2*fb AS b, y*fa + y2*fb AS c, z*fa + z2*fb AS d FROM f)
SELECT vec_id, {_R4.format(f'a / {_N4}', f'b / {_N4}', f'c / {_N4}', f'd / {_N4}')} FROM g""")
def _(s, d):
    return _pairs(s, d).select("vec_id", *_four(R.slerp(R.quat("q"), R.quat("p"), F.lit(0.3))))


_SIGN = f"""{_Q}, pv AS (SELECT *, w*lag(w) OVER o + x*lag(x) OVER o + y*lag(y) OVER o + z*lag(z) OVER o AS pd FROM q WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
sg AS (SELECT *, sum(CASE WHEN pd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS seg FROM pv),
fl AS (SELECT *, CASE WHEN sum(CASE WHEN pd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label, seg ORDER BY vec_id) % 2 = 1 THEN -1e0 ELSE 1e0 END AS s FROM sg)"""


def _series(s, d) -> DataFrame:
    return _quats(s, d).select(F.col("label").alias("clip"), F.col("vec_id").alias("ord"), "q")


@query("quat_sign_continuity", f"WITH {_SIGN} SELECT vec_id, {_R4.format('s*w', 's*x', 's*y', 's*z')} FROM fl")
def _(s, d):
    return imu.continuous(_series(s, d)).select(F.col("ord").alias("vec_id"), *_four(R.quat("q")))


# orientation i of a clip is at i seconds; frames run at 0.8 a second, so that most fall between two
_IMU = f"""WITH {_SIGN}, src AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, s*w AS w, s*x AS x, s*y AS y, s*z AS z FROM fl),
sg2 AS (SELECT *, lag(t) OVER o AS t0, lag(w) OVER o AS w0, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lag(z) OVER o AS z0, max(t) OVER (PARTITION BY clip) AS tl FROM src WINDOW o AS (PARTITION BY clip ORDER BY t)),
fr AS (SELECT clip, CAST(k AS BIGINT) AS frame, k / 0.8e0 AS tt FROM (SELECT clip, CAST(floor(max(t) * 0.8e0) AS BIGINT) AS kl FROM src GROUP BY clip), unnest(range(0, kl + 1)) AS r(k)),
hit AS (SELECT fr.clip, frame, tt, b.* EXCLUDE (clip), ls.w AS wl, ls.x AS xl, ls.y AS yl, ls.z AS zl FROM fr ASOF LEFT JOIN sg2 AS b ON fr.clip = b.clip AND fr.tt <= b.t JOIN (SELECT * FROM sg2 WHERE t = tl) AS ls ON ls.clip = fr.clip),
dt AS (SELECT clip, frame, CASE WHEN t IS NULL OR t0 IS NULL THEN 1e0 ELSE (tt - t0) / (t - t0) END AS f, coalesce(w0, w, wl) AS w0, coalesce(x0, x, xl) AS x0, coalesce(y0, y, yl) AS y0, coalesce(z0, z, zl) AS z0, coalesce(w, wl) AS w, coalesce(x, xl) AS x, coalesce(y, yl) AS y, coalesce(z, zl) AS z FROM hit),
k AS (SELECT *, CASE WHEN w*w0 + x*x0 + y*y0 + z*z0 < 0 THEN -1e0 ELSE 1e0 END AS sn, least(abs(w*w0 + x*x0 + y*y0 + z*z0), 1e0) AS dd FROM dt),
fc AS (SELECT *, CASE WHEN dd > 0.9995e0 THEN 1 - f ELSE sin((1 - f) * acos(dd)) / sin(acos(dd)) END AS fa, sn * CASE WHEN dd > 0.9995e0 THEN f ELSE sin(f * acos(dd)) / sin(acos(dd)) END AS fb FROM k),
g AS (SELECT clip, frame, w0*fa + w*fb AS a, x0*fa + x*fb AS b, y0*fa + y*fb AS c, z0*fa + z*fb AS d FROM fc)"""


def _clips(s, d) -> tuple[DataFrame, DataFrame]:
    series = imu.continuous(_series(s, d))
    series = series.withColumn("t", (F.row_number().over(Window.partitionBy("clip").orderBy("ord")) - 1).cast("double"))
    fps = F.lit(0.8)
    return series, series.groupBy("clip").agg(F.max("t").alias("last")).select("clip", fps.alias("fps"), (F.floor(F.col("last") * fps) + 1).alias("n_frames"))


@query("imu_resample", f"{_IMU} SELECT clip, frame, {_R4.format(f'a / {_N4}', f'b / {_N4}', f'c / {_N4}', f'd / {_N4}')} FROM g")
def _(s, d):
    return imu.resample(*_clips(s, d)).select("clip", "frame", *_four(R.quat("q")))


QUERIES["imu_resample_all"], SQL["imu_resample_all"] = QUERIES["imu_resample"], SQL["imu_resample"]


# a conversation is a clip, two turns share a frame
@query("imu_clock", """WITH c AS (SELECT conv_id AS clip, turn // 2 AS frame, turn % 2 AS subidx FROM conversations)
SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY frame, subidx) - 1 AS BIGINT) AS ord, round(frame + subidx / count(*) OVER (PARTITION BY clip, frame), 6) + 0e0 AS t, 'frame' AS unit FROM c""")
def _(s, d):
    return _clock(s, d, F.floor(F.col("turn") / 2).alias("frame"), (F.col("turn") % 2).alias("subidx"))


# every third conversation has a clock that stands still, and so the row's number; the others have one of 40,001 us a turn
@query("imu_clock_timestamps", """WITH c AS (SELECT conv_id AS clip, turn, CASE WHEN conv_id % 3 = 0 THEN 7 ELSE 1000 + turn * 40001 END AS us FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY turn) - 1 AS ord, min(us) OVER (PARTITION BY clip) AS a, max(us) OVER (PARTITION BY clip) AS b FROM c)
SELECT clip, CAST(ord AS BIGINT) AS ord, round(CASE WHEN b > a THEN (us - a) * 1e-6 ELSE CAST(ord AS DOUBLE) END, 6) + 0e0 AS t, CASE WHEN b > a THEN 's' ELSE 'frame' END AS unit FROM w""")
def _(s, d):
    return _clock(s, d, F.when(F.col("conv_id") % 3 == 0, F.lit(7)).otherwise(F.col("turn") * 40001 + 1000).alias("timestamp"))


def _clock(s, d, *clock) -> DataFrame:
    """Rows with a missing or unusable quaternion go, so every turn gets two of these besides its own."""
    c = table(s, d, "conversations").select(F.col("conv_id").alias("clip"), *clock, F.explode(F.array(F.lit("1.0"), F.lit("x"), F.lit("NaN"))).alias("qw"), *(F.lit(0.0).alias(f"q{k}") for k in "xyz"))
    return imu.samples(c).select("clip", F.col("ord").cast("long").alias("ord"), rnd("t").alias("t"), "unit")


def _frames(s, d) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return _quats(s, d).select(F.col("label").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "q")


_FR = f"WITH {_Q}, {_MAT}, fr AS (SELECT label AS clip, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, m.* EXCLUDE (label, vec_id) FROM m)"
# down in the panorama: rows of body-to-equirect times the third row of the matrix
_HOR = f"""{_FR}, g AS (SELECT clip, frame, -m22 AS gx, -m20 AS gy, m21 AS gz FROM fr),
u AS (SELECT clip, frame, gx / sqrt(gx*gx + gy*gy + gz*gz) AS gx, gy / sqrt(gx*gx + gy*gy + gz*gz) AS gy, gz / sqrt(gx*gx + gy*gy + gz*gz) AS gz FROM g),
v AS (SELECT clip, frame, gz AS v0, 0e0 AS v1, -gx AS v2, -gy AS c, sqrt(gx*gx + gz*gz) AS s FROM u),
c AS (SELECT clip, frame, """ + ", ".join(
    f"CASE WHEN s >= 1e-9 THEN {1 if i == j else 0}e0 + {[['0e0', '-v2', 'v1'], ['v2', '0e0', '-v0'], ['-v1', 'v0', '0e0']][i][j]} + (v{i}*v{j} - {'s*s' if i == j else '0e0'}) / (1 + c) WHEN c > 0 THEN {1 if i == j else 0}e0 ELSE {[1, -1, -1][i] if i == j else 0}e0 END AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM v)"


@query("stab_horizon", f"{_HOR} SELECT clip, frame, {_euler_sql('c')}")
def _(s, d):
    return _angles(stabilize.corrections(_frames(s, d), "horizon"), "clip", "frame")


_ATT = f"""{_HOR}, an AS (SELECT *, acos(greatest(-1e0, least(1e0, (m00 + m11 + m22 - 1) / 2))) AS ang, m21 - m12 AS x, m02 - m20 AS y, m10 - m01 AS z FROM c),
ax AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM an), un AS (SELECT * EXCLUDE (x, y, z), x / n AS x, y / n AS y, z / n AS z, sin(ang * 0.4e0) AS sn, cos(ang * 0.4e0) AS cs FROM ax),
t AS (SELECT clip, frame, """ + ", ".join(
    f"CASE WHEN ang < 1e-6 THEN {1 if i == j else 0}e0 WHEN n < 1e-9 THEN m{i}{j} ELSE {1 if i == j else 0}e0 + sn * {[['0e0', '-z', 'y'], ['z', '0e0', '-x'], ['-y', 'x', '0e0']][i][j]} + (1 - cs) * ({'xyz'[i]}*{'xyz'[j]} - {1 if i == j else 0}e0) END AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM un)"


@query("stab_strength_attenuation", f"{_ATT} SELECT clip, frame, {_euler_sql('t')}")
def _(s, d):
    return _angles(stabilize.corrections(_frames(s, d), "horizon", 0.4), "clip", "frame")


# D = Rref' R; M D M' with M = [[0,0,-1],[-1,0,0],[0,1,0]] permutes and signs its entries
_PERM = [(2, -1), (0, -1), (1, 1)]
_REL = [[f"(r0{i}*m0{j} + r1{i}*m1{j} + r2{i}*m2{j})" for j in range(3)] for i in range(3)]
_LOCK = f"""{_FR}, rf AS (SELECT clip, """ + ", ".join(f"m{i}{j} AS r{i}{j}" for i in range(3) for j in range(3)) + """ FROM fr WHERE frame = 2),
lk AS (SELECT fr.clip, frame, """ + ", ".join(f"{_PERM[i][1] * _PERM[j][1]} * {_REL[_PERM[i][0]][_PERM[j][0]]} AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM fr JOIN rf ON fr.clip = rf.clip)"


@query("stab_lock", f"{_LOCK} SELECT clip, frame, {_euler_sql('lk')}")
def _(s, d):
    return _angles(stabilize.corrections(_frames(s, d), "lock", ref_frame=2), "clip", "frame")


@query("stab_smooth")
def _(s, d):
    return _angles(stabilize.corrections(_frames(s, d), "smooth", 0.1), "clip", "frame")


_DELTA = f"""{_HOR}, p AS (SELECT clip, frame, row_number() OVER w AS n, """ + ", ".join(f"m{i}{j}, coalesce(lag(m{i}{j}) OVER w, {1 if i == j else 0}e0) AS p{i}{j}" for i in range(3) for j in range(3)) + """ FROM c WINDOW w AS (PARTITION BY clip ORDER BY frame)),
dl AS (SELECT clip, frame, n, """ + ", ".join(f"p0{i}*m0{j} + p1{i}*m1{j} + p2{i}*m2{j} AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM p)"


@query("stab_deltas", f"{_DELTA} SELECT clip, frame, round(greatest(0e0, (n - 1.5e0) / 25e0), 6) AS t, " + _euler_sql("dl").replace("5) + 0e0", "3) + 0e0"))
def _(s, d):
    got = stabilize.deltas(stabilize.corrections(_frames(s, d), "horizon"))
    return got.select("clip", "frame", rnd("t").alias("t"), *(rnd(f"d{c}", 3).alias(c) for c in ("yaw", "pitch", "roll")))


@query("stab_commands")
def _(s, d):
    return stabilize.commands(stabilize.deltas(stabilize.corrections(_frames(s, d), "horizon")))


# lenses and views

_LENS = "1048.43787e0 AS fx, 0.0747085e0 AS k1, -0.0219875e0 AS k2, 0.017445e0 AS k3, -0.00898825e0 AS k4"
_DIST = [0.0747085, -0.0219875, 0.017445, -0.00898825]
_POLY = "(t + k1*pow(t, 3) + k2*pow(t, 5) + k3*pow(t, 7) + k4*pow(t, 9))"
_T0 = "radians(85e0)"
_TAN = f"({_POLY.replace('t', _T0, 1).replace('pow(t,', f'pow({_T0},')} + (1 + 3*k1*pow({_T0}, 2) + 5*k2*pow({_T0}, 4) + 7*k3*pow({_T0}, 6) + 9*k4*pow({_T0}, 8)) * (t - {_T0}))"


# fourteen table points around (100 + lens, 200), the first of which is a header
@query("lens_lut_scale", f"WITH p AS (SELECT p_partkey, p_partkey % 8 AS lens, k FROM part, unnest(range(1, 14)) AS r(k)), m AS (SELECT p_partkey, avg(sqrt(pow(1800e0 * cos(k / 3e0) + lens, 2) + pow(1800e0 * sin(k / 3e0), 2))) AS mean FROM p GROUP BY p_partkey), a AS (SELECT p_partkey, mean, {_LENS}, radians(90e0) AS t FROM m) SELECT p_partkey, round(mean / (fx * {_TAN}), 6) AS scale FROM a")
def _(s, d):
    return _lut_scales(table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("lens")), "p_partkey")


@query("lens_lut_scale_all")
def _(s, d):
    """lens_lut_scale with the lens number."""
    return _lut_scales(table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("lens")), "p_partkey", "lens")


def _lut_scales(p: DataFrame, *keep: str) -> DataFrame:
    k = F.sequence(F.lit(0), F.lit(13))
    x = F.transform(k, lambda i: F.lit(100.0) + F.col("lens") + F.lit(1800.0) * F.cos(i / 3.0))
    y = F.transform(k, lambda i: F.lit(200.0) + F.lit(1800.0) * F.sin(i / 3.0))
    return p.select(*keep, rnd(lens.lut_scale(F.lit(1048.43787), F.lit(100.0), F.lit(200.0), [F.lit(v) for v in _DIST], x, y)).alias("scale"))


# scalars


@query("ratio_validate", """WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '16:9' WHEN 1 THEN p_size || ':' || (p_partkey % 11) WHEN 2 THEN 'x:1' WHEN 3 THEN 'NaN:1' WHEN 4 THEN '1:2:3' ELSE CAST(p_size AS VARCHAR) END AS ratio FROM part),
s AS (SELECT p_partkey, ratio, string_split(ratio, ':') AS p FROM r), t AS (SELECT p_partkey, ratio, len(p) AS n, TRY_CAST(p[1] AS DOUBLE) AS a, TRY_CAST(p[2] AS DOUBLE) AS b FROM s),
v AS (SELECT *, coalesce(n = 2 AND NOT isnan(a) AND NOT isnan(b) AND a > 0 AND b > 0 AND a / b >= 0.2e0 AND a / b <= 8e0, false) AS ok FROM t)
SELECT p_partkey, ratio, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b FROM v""")
def _(s, d):
    k = F.col("p_partkey") % 6
    r = F.when(k == 0, "16:9").when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(":"), (F.col("p_partkey") % 11).cast("string"))).when(k == 2, "x:1").when(k == 3, "NaN:1").when(k == 4, "1:2:3").otherwise(F.col("p_size").cast("string"))
    a, b = media.ratio_parts(F.col("ratio"))
    return table(s, d, "part").select("p_partkey", r.alias("ratio")).select("p_partkey", "ratio", a.alias("a"), b.alias("b"))


_EVEN = "(CAST(round_even({0}, 0) AS BIGINT) + CAST(round_even({0}, 0) AS BIGINT) % 2)"


@query("flat_dims_vfov", f"""WITH a AS (SELECT p_partkey, 1000e0 + p_size * 37.5e0 AS w, CAST(p_size AS DOUBLE) * 4 AS fov FROM part), b AS (SELECT p_partkey, {_EVEN.format('w')} AS w, least(140e0, greatest(30e0, fov)) AS fov FROM a),
c AS (SELECT p_partkey, w, {_EVEN.format('(w * 9e0 / 16e0)')} AS h, fov FROM b) SELECT p_partkey, w, h, round(degrees(2 * atan(tan(radians(fov) / 2) * h / w)), 5) AS v_fov FROM c""")
def _(s, d):
    w, h, v = media.flat_size(F.lit(1000.0) + F.col("p_size") * 37.5, F.lit(16.0), F.lit(9.0), F.col("p_size") * 4.0)
    return table(s, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), rnd(v, 5).alias("v_fov"))


_N180 = "((({0}) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0"


@query("viewer_angles", f"WITH a AS (SELECT p_partkey, p_retailprice - 1200e0 AS yaw, p_size * 7e0 - 180e0 AS pitch, p_size * 11e0 AS roll FROM part) SELECT p_partkey, round({_N180.format('yaw + 180e0')}, 5) + 0e0 AS yaw, round({_N180.format('pitch')}, 5) + 0e0 AS pitch, round({_N180.format('-roll')}, 5) + 0e0 AS roll FROM a")
def _(s, d):
    y, p, r = media.viewer_angles(F.col("p_retailprice") - 1200.0, F.col("p_size") * 7.0 - 180.0, F.col("p_size") * 11.0)
    return table(s, d, "part").select("p_partkey", rnd(y, 5).alias("yaw"), rnd(p, 5).alias("pitch"), rnd(r, 5).alias("roll"))


@query("norm180", f"SELECT l_orderkey, l_linenumber, round({_N180.format('l_extendedprice / 10e0 - 2000e0')}, 4) + 0e0 AS a FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(media.norm180(F.col("l_extendedprice") / 10.0 - 2000.0), 4).alias("a"))


@query("even_and_quality", f"SELECT p_partkey, {_EVEN.format('p_retailprice')} AS even, least(31, greatest(2, CAST(round_even((100 - p_size * 2) * 31e0 / 100, 0) AS INTEGER))) AS q, p_size <> 0 AND abs(p_retailprice / p_size / 10e0 - 2) <= 0.04e0 AS equirect FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", media.even(F.col("p_retailprice")).alias("even"), media.jpeg_q(F.col("p_size") * 2).alias("q"), media.is_equirect(F.col("p_retailprice") / F.nullif("p_size", F.lit(0)), F.lit(10.0)).alias("equirect"))


@query("view_algebra", """SELECT p_partkey, least(100e0, greatest(30e0, p_size * 3e0)) AS fov, least(85e0, greatest(-85e0, p_size * 5e0 - 125)) AS lat,
 round(CASE WHEN p_retailprice % 360e0 > 180 THEN p_retailprice % 360e0 - 360 ELSE p_retailprice % 360e0 END, 5) + 0e0 AS yaw, round(degrees(2 * atan(tan(radians(40e0 + p_size) / 2) * 16 / 9e0)), 5) AS h_fov,
 round(tan(radians(40e0 + p_size) / 2) / tan(radians(90e0) / 2), 6) AS fraction, round(degrees(2 * atan(p_size / 50e0 * tan(radians(90e0) / 2))), 5) AS fov_back FROM part""")
def _(s, d):
    n = F.col("p_size").cast("double")
    return table(s, d, "part").select("p_partkey", media.view_fov(n * 3).alias("fov"), media.view_latitude(n * 5 - 125).alias("lat"), rnd(media.view_yaw(F.col("p_retailprice")), 5).alias("yaw"), rnd(media.other_fov(n + 40, F.lit(16 / 9)), 5).alias("h_fov"),
                                      rnd(media.frame_fraction(n + 40, F.lit(90.0))).alias("fraction"), rnd(media.fov_of_fraction(n / 50, F.lit(90.0)), 5).alias("fov_back"))


# containers, catalog, jobs

_CHUNK = """ch AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS chunk, o_orderkey * 1000 AS off FROM orders),
sz AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sample, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("stsc_expand", f"""WITH {_CHUNK}, ex AS (SELECT clip, chunk, off, k, row_number() OVER (PARTITION BY clip ORDER BY chunk, k) - 1 AS sample FROM ch, unnest(range(1, CASE WHEN chunk < 3 THEN 2 ELSE 3 END + 1)) AS r(k)),
j AS (SELECT ex.clip, chunk, off, k, ex.sample, size FROM ex JOIN sz ON ex.clip = sz.clip AND ex.sample = sz.sample)
SELECT clip, CAST(sample AS BIGINT) AS sample, CAST(chunk AS BIGINT) AS chunk, CAST(off + sum(size) OVER (PARTITION BY clip, chunk ORDER BY k) - size AS BIGINT) AS off, size, CAST(sample * 40 AS BIGINT) AS pts FROM j""")
def _(s, d):
    return _expanded(s, d, table(s, d, "orders"))


QUERIES["stsc_expand_all"], SQL["stsc_expand_all"] = QUERIES["stsc_expand"], SQL["stsc_expand"]


def _expanded(s, d, orders: DataFrame) -> DataFrame:
    from ..sources.mp4 import expand_samples

    o = orders.select(F.col("o_custkey").alias("clip"), "o_orderkey")
    chunks = o.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x * 1000).alias("chunk_offsets"))
    li = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    sizes = li.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x.getField("l_quantity").cast("long")).alias("sizes"))
    stsc = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("spc"), F.lit(1).cast("long").alias("sdi")) for a, b in ((1, 2), (3, 3))))
    tracks = chunks.join(sizes, "clip").select("clip", "chunk_offsets", "sizes", stsc.alias("stsc"), F.array(F.struct(F.size("sizes").cast("long").alias("cnt"), F.lit(40).cast("long").alias("dur"))).alias("stts"))
    return expand_samples(tracks, ["clip"]).select("clip", F.col("sample").cast("long").alias("sample"), F.col("chunk").cast("long").alias("chunk"), "off", "size", "pts")


_TREE = "WITH RECURSIVE box(id, parent, typ) AS (SELECT -1, CAST(NULL AS INT), 'moov' UNION ALL SELECT r_regionkey, -1, r_name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation), walk(id, typ, depth, path) AS (SELECT id, typ, 0, typ FROM box WHERE parent IS NULL UNION ALL SELECT box.id, box.typ, depth + 1, path || '/' || box.typ FROM walk JOIN box ON box.parent = walk.id) SELECT id, typ, depth, path FROM walk"


@query("box_tree_walk", _TREE)
def _(s, d):
    for t in ("region", "nation"):
        table(s, d, t).createOrReplaceTempView(t)
    return s.sql(_TREE)


@query("browse_filter", r"""WITH e AS (SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages), x AS (SELECT page_id, name, lower(regexp_extract(name, '(\.[^./]*)$', 1)) AS ext FROM e)
SELECT page_id, name FROM x WHERE NOT starts_with(name, '.') AND ext IN ('.html', '.htm')""")
def _(s, d):
    e = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("name"), F.lit(False).alias("is_dir"))
    return catalog.browse(e, "html, .HTM").select("page_id", "name")


@query("dedup_first", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def _(s, d):
    return catalog.first_by(table(s, d, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "p_partkey")


@query("path_containment", "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') AS path FROM pages) SELECT page_id, list_bool_or(list_transform(['/www.example.com', '/spam-farm.example.org/en', '/blog'], lambda r: path = r OR starts_with(path, r || '/'))) AS inside FROM p".replace("list_bool_or(", "list_contains(").replace("|| '/')))", "|| '/')), true)"))
def _(s, d):
    roots = F.array(*map(F.lit, ["/www.example.com", "/spam-farm.example.org/en", "/blog"]))
    return table(s, d, "pages").select("page_id", media.inside(F.regexp_replace("url", "^[a-z]+:/", ""), roots).alias("inside"))


@query("byte_range", r"""WITH h AS (SELECT doc_id, n_chars AS size, CASE doc_id % 6 WHEN 0 THEN 'bytes=10-19' WHEN 1 THEN 'bytes=-5' WHEN 2 THEN 'bytes=100-' WHEN 3 THEN 'bytes=-' WHEN 4 THEN 'bytes=900-100' ELSE NULL END AS header FROM documents),
p AS (SELECT *, regexp_extract(header, '^bytes=(\d*)-(\d*)$', 1) AS a, regexp_extract(header, '^bytes=(\d*)-(\d*)$', 2) AS b FROM h),
f AS (SELECT *, CASE WHEN a = '' THEN greatest(0, size - TRY_CAST(b AS BIGINT)) ELSE TRY_CAST(a AS BIGINT) END AS lo, CASE WHEN a = '' OR b = '' THEN size - 1 ELSE TRY_CAST(b AS BIGINT) END AS hi FROM p),
g AS (SELECT *, coalesce((a <> '' OR b <> '') AND lo <= hi AND lo < size, false) AS ok FROM f)
SELECT doc_id, CASE WHEN header IS NULL THEN 200 WHEN ok THEN 206 ELSE 416 END AS status, CASE WHEN header IS NULL THEN 0 WHEN ok THEN lo ELSE -1 END AS first_byte, CASE WHEN header IS NULL THEN size - 1 WHEN ok THEN least(hi, size - 1) ELSE -1 END AS last_byte FROM g""")
def _(s, d):
    k = F.col("doc_id") % 6
    h = F.when(k == 0, "bytes=10-19").when(k == 1, "bytes=-5").when(k == 2, "bytes=100-").when(k == 3, "bytes=-").when(k == 4, "bytes=900-100")
    st, a, b = media.byte_range(F.col("header"), F.col("n_chars"))
    return table(s, d, "documents").select("doc_id", "n_chars", h.alias("header")).select("doc_id", st.alias("status"), F.coalesce(a, F.lit(-1)).alias("first_byte"), F.coalesce(b, F.lit(-1)).alias("last_byte"))


@query("cache_key", "SELECT doc_id, sha1(source || ':' || CAST(n_chars AS VARCHAR) || ':7680') AS key FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", media.cache_key(F.col("source"), F.col("n_chars").cast("string"), F.lit("7680")).alias("key"))


@query("progress_eta", """WITH e AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block, event_id % 3 AS kind, CAST(floor(value * 1e6) AS BIGINT) AS us FROM events),
o AS (SELECT job, block, kind, us / 1e6 AS out FROM e)
SELECT job, CAST(block AS BIGINT) AS block, round(greatest(0e0, least(1e0, out / 300e0)) * 0.95e0, 6) + 0e0 AS progress, CASE WHEN kind = 0 THEN 3.5e0 END AS fps,
  round(CASE WHEN kind <> 2 THEN greatest(0e0, 300e0 - out) / 1.5e0 WHEN out > 0 THEN 60e0 * (greatest(0e0, 300e0 - out) / out) END, 4) + 0e0 AS eta_s FROM o""")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("job"), "event_id", (F.col("event_id") % 3).alias("kind"), F.floor(F.col("value") * 1e6).cast("long").cast("string").alias("us"))
    lines = F.array(F.when(F.col("kind") == 0, "fps=3.5"), F.when(F.col("kind") != 2, "speed= 1.5x"), F.lit("noise"), F.concat(F.when(F.col("kind") == 1, "out_time_ms=").otherwise("out_time_us="), "us"), F.lit("progress=continue"))
    flat = e.select("job", F.posexplode(lines).alias("k", "line"), "event_id").where("line IS NOT NULL").select("job", (F.col("event_id") * 10 + F.col("k")).alias("seq"), "line")
    jobs = e.select("job").distinct().select("job", F.lit(300.0).alias("duration_s"), F.lit(60.0).alias("elapsed_s"))
    got = progress.estimates(progress.blocks(flat), jobs, 0.0, 0.95)
    return got.select("job", F.col("block").cast("long").alias("block"), rnd("progress").alias("progress"), "fps", rnd("eta_s", 4).alias("eta_s"))


@query("job_latest_state", "SELECT user_id AS job, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def _(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return catalog.latest(log).select("job", "status", "seq")


_MODE = "CASE WHEN m = 'auto' THEN CASE WHEN maps THEN 'calibrated' ELSE 'v360' END WHEN m = 'calibrated' AND NOT maps THEN NULL ELSE m END"


@query("media_plan", f"""WITH j AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'calibrated' ELSE 'v360' END AS m, p_size % 2 = 0 AS maps, CASE WHEN p_size % 3 = 0 THEN 'hevc' ELSE 'h264' END AS codec, CASE p_size % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'nvenc' ELSE 'cpu' END AS want, p_partkey % 5 < 2 AS hw FROM part),
k AS (SELECT *, want = 'nvenc' OR want = 'auto' AND hw AS hard FROM j)
SELECT p_partkey, {_MODE} AS mode, CASE WHEN hard THEN codec || '_nvenc' WHEN codec = 'hevc' THEN 'libx265' ELSE 'libx264' END AS encoder, CASE WHEN codec = 'hevc' THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt, CASE WHEN {_MODE} IS NOT NULL THEN 17 + CASE WHEN {_MODE} = 'calibrated' THEN 10 ELSE 0 END + CASE WHEN hard THEN 10 ELSE 6 END + CASE WHEN codec = 'hevc' THEN 2 ELSE 0 END ELSE 0 END AS n_args FROM k""")
def _(s, d):
    c, k = F.col, F.col("p_partkey") % 3
    jobs = table(s, d, "part").select(c("p_partkey").cast("string").alias("input"), F.lit("out.mp4").alias("output"), F.lit(7680).alias("out_w"), F.when(c("p_size") % 3 == 0, "hevc").otherwise("h264").alias("codec"),
                                      F.when(c("p_size") % 4 == 0, "auto").when(c("p_size") % 4 == 1, "nvenc").otherwise("cpu").alias("wanted"), (c("p_partkey") % 5 < 2).alias("has_hardware"), F.lit(20).alias("quality"), F.lit("lanczos").alias("interp"),
                                      F.when(k == 0, "auto").when(k == 1, "calibrated").otherwise("v360").alias("mode"), (c("p_size") % 2 == 0).alias("has_maps"), F.lit(5.0).alias("fps_out"), F.lit(None).cast("string").alias("commands"), F.array(*(F.lit(f"m{i}.pgm") for i in range(5))).alias("maps"))
    got = catalog.conversion_plan(jobs)
    return got.select(c("input").cast("long").alias("p_partkey"), "mode", "encoder", "pix_fmt", F.when(c("argv").isNotNull(), F.size("argv")).otherwise(0).alias("n_args"))


@query("job_plan", "SELECT p_partkey, sha1(CAST(p_partkey AS VARCHAR)) AS id, 'queued' AS status, '5' AS fps_out, '20' AS quality FROM part")
def _(s, d):
    got = catalog.plan_jobs(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path")), {"quality": "20", "fps_out": "25", "nonsense": "1"}, street_view=True)
    return got.select(F.col("input").cast("long").alias("p_partkey"), "id", "status", F.col("options")["fps_out"].alias("fps_out"), F.col("options")["quality"].alias("quality"))


@query("format_sizes", """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024e0 * 10 + 0.5e0) / 10) ELSE printf('%.1f MB', n_chars / 1048576e0) END AS bytes,
 CASE WHEN n_chars >= 3600 THEN printf('%dh%02dm%02ds', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%dm%02ds', n_chars // 60, n_chars % 60) END AS clock FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", media.format_bytes(F.col("n_chars")).alias("bytes"), media.format_duration(F.col("n_chars")).alias("clock"))


# windows that also run on streams


def _events(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    from ..streaming.live import tumbling

    return tumbling(_events(s, d), "ts", ["event_type"], "1 hour", "10 minutes").select(F.unix_micros("start").alias("start_us"), "event_type", "n", rnd("total", 4).alias("total"))


@query("stream_session", """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER w < 21600000000 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT user_id, t, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS k FROM c) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def _(s, d):
    from ..streaming.live import sessions

    return sessions(_events(s, d), "ts", "user_id", "6 hours", "10 minutes").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


from . import catalog_queries, container_queries, file_queries, settings_queries, stream_queries, view_queries  # noqa: E402,F401  (they add their queries to the catalogue)
