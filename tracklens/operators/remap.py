"""Remap grids, blend masks, pixel gather and reprojection over pixel tables (img, row, col, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lens as L
from ..functions import rotation as R

LENS_DDL = "lens int, fx double, cx double, cy double, dist array<double>, width double, height double, scale double, linear boolean, qw double, qx double, qy double, qz double"


def ideal_lenses(spark: SparkSession, width: float = 3840.0, height: float = 3840.0) -> DataFrame:
    return spark.createDataFrame(L.ideal_lenses(width, height), LENS_DDL)


def calibrated_lenses(calibration: DataFrame) -> DataFrame:
    """The first two lenses of a calibration row, with the scale of their radius tables."""
    got = calibration.select(F.posexplode("lenses").alias("lens", "l")).where("lens < 2").select("lens", "l.*")
    dist = [F.col("dist")[i] for i in range(4)]
    scale = L.lut_scale(F.col("fx"), F.col("cx"), F.col("cy"), dist, F.col("radial_lut_1"), F.col("radial_lut_2"))
    q = [F.col("extrinsic_quat")[i].alias(f"q{c}") for i, c in enumerate("wxyz")]
    return got.select("lens", "fx", "cx", "cy", "dist", "width", "height", scale.alias("scale"), F.lit(False).alias("linear"), *q)


def pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """row, col of every pixel, generated in parallel."""
    return spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))


def grids(lenses: DataFrame, width: int, height: int, by: tuple[str, ...] = ("clip",)) -> DataFrame:
    """by, lens, row, col, sx, sy (null where invalid), valid, weight: the grid of every clip's lenses.

    lenses: by and the columns of LENS_DDL, a row a lens. Pixels are generated beside the lens rows, so a calibration is never
    joined to pixels nor sent to the driver; rows of pixels are dealt out, so one large clip is as parallel as many small ones.
    """
    key = [*by, "lens"]
    unit = R.normalized_step(lenses.withColumn("_raw", R.pack_quat([F.col(f"q{c}") for c in "wxyz"])), "_raw", "_q")
    m = R.to_matrix(R.quat("_q"))
    names = [[f"_m{i}{j}" for j in range(3)] for i in range(3)]
    matrix = [(c if isinstance(c, Column) else F.lit(float(c))).alias(n) for cs, ns in zip(m, names, strict=True) for c, n in zip(cs, ns, strict=True)]
    given = [*key, "fx", "cx", "cy", "width", "height", "scale", "linear"]
    dist = [f"_k{i}" for i in range(4)]
    # what holds for a lens is worked out before its pixels are, and every later step names the columns of the one before
    each = unit.select(*given, *(F.col("dist")[i].alias(n) for i, n in enumerate(dist)), *matrix)
    rows = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).repartition(*key, "row")
    px = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    rays = px.select("*", *(c.alias(n) for c, n in zip(L.pixel_direction(F.col("row"), F.col("col"), width, height), ("dx", "dy", "dz"), strict=True)))
    turn = R.apply([[F.col(n) for n in ns] for ns in names], [F.col("dx"), F.col("dy"), F.col("dz")])
    turned = rays.select(*given, *dist, "row", "col", *(c.alias(n) for c, n in zip(turn, ("dx", "dy", "dz"), strict=True)))
    theta, rho = L.off_axis(F.col("dx"), F.col("dy"), F.col("dz"))
    bent = turned.select("*", theta.alias("theta"), rho.alias("rho"))
    bent = bent.select("*", L.radius(F.col("theta"), F.col("fx"), [F.col(n) for n in dist], F.col("scale"), F.col("linear")).alias("r"))
    x, y = (F.col(c) + F.col("r") * F.col(v) / F.col("rho") for c, v in (("cx", "dx"), ("cy", "dy")))
    seen = bent.select(*key, "row", "col", "width", "height", "theta", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    ok = (F.degrees("theta") < L.HALF_FOV_DEG) & F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    whole = lambda c: F.when(ok, F.rint(c).cast("int"))
    return seen.select(*key, "row", "col", whole("x").alias("sx"), whole("y").alias("sy"), ok.alias("valid"), F.when(ok, L.blend_weight(F.col("theta"))).otherwise(F.lit(0.0)).alias("weight"))


def grid(lenses: DataFrame, width: int, height: int) -> DataFrame:
    """The grid of one pair of lenses."""
    return grids(lenses, width, height, ())


def mask(grid_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, row, col, m: share of the second lens in 0..255, half where neither sees the pixel."""
    w = grid_.groupBy(*by, "row", "col").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("lens") == 1, F.col("weight")).otherwise(0.0)).alias("second"))
    return w.select(*by, "row", "col", F.rint(F.when(F.col("total") > 0, F.col("second") / F.col("total")).otherwise(F.lit(0.5)) * 255).cast("int").alias("m"))


def _shuffled(image: DataFrame) -> DataFrame:
    """An image that a join never broadcasts: Spark takes generated pixels to be as small as the rows they come from."""
    return image.hint("merge")


def gather(grid_: DataFrame, image: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, lens, row, col, r, g, b: nearest source pixels, black where there is none. image: by, lens, sx, sy, r, g, b."""
    hit = grid_.select(*by, "lens", "row", "col", "sx", "sy").join(_shuffled(image), [*by, "lens", "sx", "sy"], "left")
    return hit.select(*by, "lens", "row", "col", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def blend(gathered: DataFrame, mask_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, row, col, r, g, b: both lenses mixed by the mask."""
    share = F.when(F.col("lens") == 1, F.col("m")).otherwise(255 - F.col("m")) / 255.0
    got = gathered.join(mask_, [*by, "row", "col"])
    return got.groupBy(*by, "row", "col").agg(*(F.rint(F.sum(F.col(c) * share)).cast("int").alias(c) for c in "rgb"))


def views(params: DataFrame, projection: str, width: int, height: int) -> DataFrame:
    """The columns of params, row, col, lon, lat seen by each pixel of every view; little planets are mirrored.

    params: a row a view, with those of yaw_deg, pitch_deg, roll_deg, h_fov_deg, v_span_deg that the projection takes.
    """
    px = params.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).repartition("row", *params.columns)
    px = px.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    row, col, given = F.col("row"), F.col("col"), F.col
    if projection == "flat":
        lon, lat = L.flat(row, col, width, height, R.euler_matrix(given("yaw_deg"), given("pitch_deg"), given("roll_deg")), given("h_fov_deg"))
    elif projection == "cylindrical":
        lon, lat = L.cylindrical(row, col, width, height, given("yaw_deg"), given("v_span_deg"))
    elif projection == "equirect360":
        lon, lat = L.equirect(row, col, width, height)
    elif projection == "littleplanet":
        lon, lat = L.little_planet(row, col, width, height, given("roll_deg"))
    else:
        raise ValueError(f"no such projection here: {projection!r}")
    return px.select(*params.columns, "row", "col", lon.alias("lon"), lat.alias("lat"))


def view(spark: SparkSession, projection: str, width: int, height: int, yaw_deg: float = 0.0, pitch_deg: float = 0.0, roll_deg: float = 0.0, h_fov_deg: float = 90.0, v_span_deg: float = 60.0) -> DataFrame:
    """row, col, lon, lat of one view."""
    params = {"yaw_deg": yaw_deg, "pitch_deg": pitch_deg, "roll_deg": roll_deg, "h_fov_deg": h_fov_deg, "v_span_deg": v_span_deg}
    one = spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in params.items()))
    return views(one, projection, width, height).select("row", "col", "lon", "lat")


def sample(view_: DataFrame, image: DataFrame, src_w: int, src_h: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, row, col, r, g, b: nearest pixel of an equirect image (by, row, col, r, g, b) for each view pixel."""
    u, v = L.equirect_uv(F.col("lon"), F.col("lat"))
    at = lambda c, n: F.least(F.lit(n - 1), F.floor(c * n)).cast("int")
    keyed = view_.select(*by, "row", "col", at(u, src_w).alias("_c"), at(v, src_h).alias("_r"))
    src = image.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), "r", "g", "b")
    return keyed.join(_shuffled(src), [*by, "_r", "_c"], "left").select(*by, "row", "col", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))
