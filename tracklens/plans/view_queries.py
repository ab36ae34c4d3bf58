"""Grids, masks, blends and views of every clip of a calibration table. A supplier stands for a clip, its key for the numbers
of its two lenses and of its view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lens as L
from ..operators import remap
from ..scratch import Scratch
from .file_queries import _field, _varint
from .queries import _DIST, _LENS, _POLY, _T0, _TAN, query, rnd, table

W, H = 32, 16
CLIP = ("clip",)
_F = "0.5e0 * 3840 * (3735e0 / 3840) / radians(95e0)"
_PX = f'px AS (SELECT s_suppkey AS clip, CAST(id // {W} AS INTEGER) AS "row", CAST(id % {W} AS INTEGER) AS col FROM supplier, range(0, {W * H}) AS r(id))'
# back lens: R = [[-1,0,0],[0,0,-1],[0,-1,0]]; front lens: R = [[1,0,0],[0,0,-1],[0,1,0]]
_MAP = f"""{_PX}, ray AS (SELECT *, (col + 0.5e0) / {W} * 2 * pi() - pi() + radians(90e0) AS lon, pi() / 2 - ("row" + 0.5e0) / {H} * pi() AS lat FROM px),
dir AS (SELECT clip, "row", col, cos(lat) * sin(lon) AS dx, cos(lat) * cos(lon) AS dy, sin(lat) AS dz FROM ray),
ls AS (SELECT 0 AS lens, -dx AS x, -dz AS y, -dy AS z, clip, "row", col FROM dir UNION ALL SELECT 1, dx, -dz, dy, clip, "row", col FROM dir),
th AS (SELECT *, acos(greatest(-1e0, least(1e0, z))) AS t, greatest(sqrt(x*x + y*y), 1e-12) AS rho, {_LENS.split(', ', 1)[1]}, {_F} * (1 + clip % 10 * 0.004e0) AS fx, 1919.3e0 + clip % 7 * 0.11e0 + lens * 0.05e0 AS cx, 1919.6e0 - clip % 5 * 0.13e0 AS cy FROM ls),
rr AS (SELECT *, CASE WHEN clip % 3 = 0 THEN fx * t ELSE (1 + clip % 4 * 0.01e0) * fx * (CASE WHEN t <= {_T0} THEN {_POLY} ELSE {_TAN} END) END AS r FROM th),
xy AS (SELECT *, round(cx + r * x / rho, 6) AS sx, round(cy + r * y / rho, 6) AS sy FROM rr),
ok AS (SELECT *, degrees(t) < 96e0 AND sx BETWEEN 0 AND 3839 AND sy BETWEEN 0 AND 3839 AS valid FROM xy),
gr AS (SELECT clip, lens, "row", col, CASE WHEN valid THEN CAST(round_even(sx, 0) AS INTEGER) END AS sx, CASE WHEN valid THEN CAST(round_even(sy, 0) AS INTEGER) END AS sy, valid, CASE WHEN valid THEN greatest(0e0, least(1e0, (radians(95e0) - t) / radians(10e0))) ELSE 0e0 END AS weight FROM ok)"""


def calibrations(s, d, clips: DataFrame | None = None) -> DataFrame:
    """clip and the columns of remap.LENS_DDL, two rows a clip (clips: clip; else the suppliers)."""
    ideal = [F.struct(*(F.lit(v).alias(k) for k, v in x.items() if k in ("qw", "qx", "qy", "qz")), F.lit(x["lens"]).alias("lens")) for x in L.ideal_lenses()]
    k, fx = F.col("clip"), L.ideal_lenses()[0]["fx"]
    clips = table(s, d, "supplier").select(F.col("s_suppkey").alias("clip")) if clips is None else clips
    got = clips.select("clip", F.explode(F.array(*ideal)).alias("x"))
    return got.select("clip", F.col("x.lens").alias("lens"), (F.lit(fx) * (1 + k % 10 * 0.004)).alias("fx"), (1919.3 + k % 7 * 0.11 + F.col("x.lens") * 0.05).alias("cx"), (1919.6 - k % 5 * 0.13).alias("cy"),
                      F.array(*map(F.lit, _DIST)).alias("dist"), F.lit(3840.0).alias("width"), F.lit(3840.0).alias("height"), (1 + k % 4 * 0.01).alias("scale"), (k % 3 == 0).alias("linear"), *(f"x.q{c}" for c in "wxyz"))


def _grids(s, d) -> DataFrame:
    return remap.grids(calibrations(s, d), W, H)


@query("remap_grid", f'WITH {_MAP} SELECT clip, lens, "row", col, coalesce(sx, -1) AS sx, coalesce(sy, -1) AS sy, valid, round(weight, 6) + 0e0 AS weight FROM gr')
def _(s, d):
    return _grids(s, d).withColumns({"weight": rnd("weight"), "sx": F.coalesce("sx", F.lit(-1)), "sy": F.coalesce("sy", F.lit(-1))})


@query("remap_valid_ratio", f"WITH {_MAP} SELECT clip, lens, count(*) AS n, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (valid) / count(*), 6) AS ratio FROM gr GROUP BY clip, lens")
def _(s, d):
    return _grids(s, d).groupBy("clip", "lens").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), rnd(F.count_if("valid") / F.count("*")).alias("ratio"))


_MASK = 'mk AS (SELECT clip, "row", col, CAST(round_even(CASE WHEN sum(weight) > 0 THEN sum(CASE WHEN lens = 1 THEN weight ELSE 0e0 END) / sum(weight) ELSE 0.5e0 END * 255, 0) AS INTEGER) AS m FROM gr GROUP BY clip, "row", col)'


@query("blend_mask", f'WITH {_MAP}, {_MASK} SELECT clip, "row", col, m FROM mk')
def _(s, d):
    return remap.mask(_grids(s, d), CLIP)


# a source picture whose every third column is missing
_IMG = 'im AS (SELECT clip, lens, sx, sy, CAST((sx + sy) % 256 AS INTEGER) AS r, CAST((sx + clip) % 256 AS INTEGER) AS g, CAST((sy + lens) % 256 AS INTEGER) AS b FROM (SELECT DISTINCT clip, lens, sx, sy FROM gr WHERE valid AND sx % 3 <> 0))'
_GATHER = 'gt AS (SELECT gr.clip, gr.lens, gr."row", gr.col, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM gr LEFT JOIN im ON gr.clip = im.clip AND gr.lens = im.lens AND gr.sx = im.sx AND gr.sy = im.sy)'


def _images(grids: DataFrame) -> DataFrame:
    p = grids.where("valid AND sx % 3 <> 0").select("clip", "lens", "sx", "sy").distinct()
    return p.select("clip", "lens", "sx", "sy", ((F.col("sx") + F.col("sy")) % 256).alias("r"), ((F.col("sx") + F.col("clip")) % 256).cast("int").alias("g"), ((F.col("sy") + F.col("lens")) % 256).alias("b"))


def _stored(s, d) -> DataFrame:
    """Maps as a table: worked out once, whoever filters or joins them."""
    return Scratch(s, "maps").table(_grids(s, d), "grid")


@query("remap_gather", f'WITH {_MAP}, {_IMG}, {_GATHER} SELECT clip, lens, "row", col, r, g, b FROM gt')
def _(s, d):
    g = _stored(s, d)
    return remap.gather(g, _images(g), CLIP)


@query("blend_merge", f'WITH {_MAP}, {_MASK}, {_IMG}, {_GATHER} SELECT gt.clip, gt."row", gt.col, ' + ", ".join(f"CAST(round_even(sum({c} * CASE WHEN lens = 1 THEN m / 255e0 ELSE (255 - m) / 255e0 END), 0) AS INTEGER) AS {c}" for c in "rgb") + ' FROM gt JOIN mk ON gt.clip = mk.clip AND gt."row" = mk."row" AND gt.col = mk.col GROUP BY 1, 2, 3')
def _(s, d):
    g = _stored(s, d)
    return remap.blend(remap.gather(g, _images(g), CLIP), remap.mask(g, CLIP), CLIP)


@query("lens_radial_model", f"WITH a AS (SELECT p_partkey, radians(p_size * 2.4e0) AS t, {_LENS} FROM part) SELECT p_partkey, round(fx * CASE WHEN t <= {_T0} THEN {_POLY} ELSE {_TAN} END, 6) AS r FROM a")
def _(s, d):
    return table(s, d, "part").select("p_partkey", rnd(F.lit(1048.43787) * L.polynomial(F.radians(F.col("p_size") * 2.4), [F.lit(k) for k in _DIST])).alias("r"))


# views


def _params(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("clip"), (k % 360 - 180.0).alias("yaw_deg"), (k % 61 - 30.0).alias("pitch_deg"), (k % 91 - 45.0).alias("roll_deg"), (k % 150 * 1.0).alias("h_fov_deg"), (k % 170 * 1.0).alias("v_span_deg"))


_UV = f"""{_PX}, uv AS (SELECT clip, "row", col, (col + 0.5e0) / {W} AS u, ("row" + 0.5e0) / {H} AS v, radians(clip % 360 - 180e0) AS yaw, radians(clip % 61 - 30e0) AS pitch, radians(clip % 91 - 45e0) AS roll,
  tan(radians(least(140e0, greatest(30e0, clip % 150))) / 2) AS half, tan(radians(least(150e0, greatest(10e0, clip % 170))) / 2) AS span FROM px)"""


def _lonlat(df: DataFrame) -> DataFrame:
    return df.select("clip", "row", "col", rnd("lon").alias("lon"), rnd("lat").alias("lat"))


def _view_sql(lon: str, lat: str, more: str = "", src: str = "uv") -> str:
    return f'WITH {_UV}{more} SELECT clip, "row", col, round({lon}, 6) + 0e0 AS lon, round({lat}, 6) + 0e0 AS lat FROM {src}'


@query("project_equirect", _view_sql("(u - 0.5e0) * 2 * pi()", "(v - 0.5e0) * pi()"))
def _(s, d):
    return _lonlat(remap.views(_params(s, d), "equirect360", W, H))


@query("project_cylindrical", _view_sql("yaw + (u - 0.5e0) * 2 * pi()", "atan((v - 0.5e0) * 2 * span)"))
def _(s, d):
    return _lonlat(remap.views(_params(s, d), "cylindrical", W, H))


@query("project_littleplanet", _view_sql("atan2(2*v - 1, 2*u - 1) + roll", "2 * atan(sqrt(pow(2*u - 1, 2) + pow(2*v - 1, 2)) * tan(radians(250e0) / 4)) - pi() / 2"))
def _(s, d):
    return _lonlat(remap.views(_params(s, d), "littleplanet", W, H))


_FLAT = f""", rz AS (SELECT *, (2*u - 1) * half AS a, (2*v - 1) * half * {H / W}e0 AS b FROM uv), ro AS (SELECT *, cos(roll) * a - sin(roll) * b AS x0, sin(roll) * a + cos(roll) * b AS y0 FROM rz),
rp AS (SELECT *, cos(pitch) * y0 - sin(pitch) AS y1, sin(pitch) * y0 + cos(pitch) AS z1 FROM ro), tn AS (SELECT *, cos(yaw) * x0 + sin(yaw) * z1 AS x, cos(yaw) * z1 - sin(yaw) * x0 AS z FROM rp)"""


@query("project_flat", _view_sql("atan2(x, z)", "atan2(y1, sqrt(x*x + z*z))", _FLAT, "tn"))
def _(s, d):
    return _lonlat(remap.views(_params(s, d), "flat", W, H))


@query("equirect_sample", f"""WITH {_UV}, a AS (SELECT *, yaw + (u - 0.5e0) * 2 * pi() AS lon, atan((v - 0.5e0) * 2 * span) AS lat FROM uv),
b AS (SELECT clip, "row", col, lon / (2 * pi()) + 0.5e0 AS u, greatest(0e0, least(1e0, lat / pi() + 0.5e0)) AS v FROM a),
c AS (SELECT clip, "row", col, CAST(least(36, floor((u - floor(u)) * 37)) AS INTEGER) AS sc, CAST(least(18, floor(v * 19)) AS INTEGER) AS sr FROM b)
SELECT clip, "row", col, sr AS r, sc AS g, CAST((sr * 40 + sc + clip) % 256 AS INTEGER) AS b FROM c""")
def _(s, d):
    whole = table(s, d, "supplier").select(F.col("s_suppkey").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(18))).alias("row")).repartition("clip", "row").select("clip", "row", F.explode(F.sequence(F.lit(0), F.lit(36))).alias("col"))
    images = whole.select("clip", "row", "col", F.col("row").alias("r"), F.col("col").alias("g"), ((F.col("row") * 40 + F.col("col") + F.col("clip")) % 256).cast("int").alias("b"))
    return remap.sample(remap.views(_params(s, d), "cylindrical", W, H), images, 37, 19, CLIP)


@query("letterbox", f"""WITH {_UV}, w AS (SELECT *, 500e0 + clip * 10 AS sw, 250e0 + clip % 300 AS sh FROM uv), k AS (SELECT *, least({W} / sw, {H} / sh) AS k FROM w),
a AS (SELECT clip, "row", col, ((col + 0.5e0) - ({W} - sw * k) / 2) / (sw * k) AS u, (("row" + 0.5e0) - ({H} - sh * k) / 2) / (sh * k) AS v FROM k)
SELECT clip, "row", col, round(u, 6) + 0e0 AS u, round(v, 6) + 0e0 AS v, u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS inside FROM a""")
def _(s, d):
    px = remap.views(_params(s, d).select("clip"), "equirect360", W, H).select("clip", "row", "col")
    u, v, inside = L.letterbox(F.col("row"), F.col("col"), W, H, 500.0 + F.col("clip") * 10, 250.0 + F.col("clip") % 300)
    return px.select("clip", "row", "col", rnd(u).alias("u"), rnd(v).alias("v"), inside.alias("inside"))


@query("pb_varint", "SELECT p_partkey AS k, (p_partkey * 2654435761) % (CAST(1 AS BIGINT) << CAST(1 + p_partkey % 40 AS BIGINT)) AS v, CAST(1 AS INTEGER) AS field FROM part")
def _(s, d):
    """Varints of one to six bytes, written in the JVM and read back."""
    from ..sources.mp4 import register

    register(s)
    value = (F.col("p_partkey") * 2654435761) % F.expr("shiftleft(1L, CAST(1 + p_partkey % 40 AS INT))")
    m = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.unhex(_field(1, 0, _varint(value))).alias("raw"))
    return s.sql("SELECT k, CAST(varint AS BIGINT) AS v, field FROM {m}, LATERAL pb_fields(raw)", m=m)
