"""Fisheye lenses and panoramic projections as column expressions. Angles are radians unless named _deg."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotation import Mat, apply

#: Fixed values of the lens model, in degrees: end of the polynomial, half field of view, half width of the blend, yaw of the panorama.
LINEAR_FROM_DEG, HALF_FOV_DEG, FADE_DEG, YAW_DEG = 85.0, 96.0, 5.0, 90.0
INVALID = 65535
LUT_POINTS = 14


def polynomial(t: Column, dist: list[Column]) -> Column:
    """Odd polynomial t + k1 t^3 + ... up to LINEAR_FROM_DEG, its tangent beyond."""
    t0 = math.radians(LINEAR_FROM_DEG)
    value, slope = F.lit(t0), F.lit(1.0)
    for i, k in enumerate(dist):
        n = 2 * i + 3
        value, slope = value + k * t0**n, slope + n * k * t0 ** (n - 1)
    inner = F.lit(0.0)
    for k in reversed(dist):
        inner = (inner + k) * (t * t)
    return F.when(t <= t0, t * (1 + inner)).otherwise(value + slope * (t - t0))


def lut_scale(fx: Column, cx: Column, cy: Column, dist: list[Column], lut1: Column, lut2: Column) -> Column:
    """Mean radius of the seam circle in the tables over the model's radius at 90 degrees; 1 without full tables."""
    r90 = fx * polynomial(F.lit(math.pi / 2), dist)
    radii = F.zip_with(F.slice(lut1, 2, 10_000), F.slice(lut2, 2, 10_000), lambda x, y: F.hypot(x - cx, y - cy))
    mean = F.aggregate(radii, F.lit(0.0), lambda s, r: s + r) / F.size(radii)
    full = (F.coalesce(F.size(lut1), F.lit(0)) >= LUT_POINTS) & (F.coalesce(F.size(lut2), F.lit(0)) >= LUT_POINTS)
    return F.when(full & (r90 > 0), mean / r90).otherwise(F.lit(1.0))


def ideal_lenses(width: float = 3840.0, height: float = 3840.0) -> list[dict]:
    """Two equidistant lenses back to back: 95 degrees reach 3735/3840 of the half width."""
    f = 0.5 * min(width, height) * (3735.0 / 3840.0) / math.radians(95.0)
    h = math.sqrt(0.5)
    return [
        {"lens": i, "fx": f, "cx": width / 2 - 0.5, "cy": height / 2 - 0.5, "dist": [0.0] * 4, "width": width, "height": height, "scale": 1.0, "linear": True, "qw": q[0], "qx": q[1], "qy": q[2], "qz": q[3]}
        for i, q in enumerate([(0.0, 0.0, -h, h), (h, h, 0.0, 0.0)])
    ]


def pixel_direction(row: Column, col: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    """Body direction (x right, y forward, z up) of an equirect pixel's centre."""
    lon = (col + 0.5) / width * (2 * math.pi) - math.pi + math.radians(YAW_DEG)
    lat = math.pi / 2 - (row + 0.5) / height * math.pi
    return F.cos(lat) * F.sin(lon), F.cos(lat) * F.cos(lon), F.sin(lat)


def off_axis(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, rho) of a direction in the lens's own axes: its angle from the optical axis, its length across it."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))), F.greatest(F.hypot(x, y), F.lit(1e-12))


def radius(theta: Column, fx: Column, dist: list[Column], scale: Column, linear: Column) -> Column:
    """Distance in pixels from the image centre of what is seen at theta."""
    return F.when(linear, fx * theta).otherwise(scale * fx * polynomial(theta, dist))


def blend_weight(theta: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (math.radians(90 + FADE_DEG) - theta) / math.radians(2 * FADE_DEG)))


# projections: longitude and latitude seen by pixel (row, col) of a width x height view


def _uv(row: Column, col: Column, width: int, height: int) -> tuple[Column, Column]:
    return (col + 0.5) / width, (row + 0.5) / height


def equirect(row: Column, col: Column, width: int, height: int) -> tuple[Column, Column]:
    u, v = _uv(row, col, width, height)
    return (u - 0.5) * (2 * math.pi), (v - 0.5) * math.pi


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def cylindrical(row: Column, col: Column, width: int, height: int, yaw_deg: Column, v_span_deg: Column) -> tuple[Column, Column]:
    u, v = _uv(row, col, width, height)
    return F.radians(yaw_deg) + (u - 0.5) * (2 * math.pi), F.atan((v - 0.5) * (2 * F.tan(F.radians(_within(v_span_deg, 10.0, 150.0)) / 2)))


def little_planet(row: Column, col: Column, width: int, height: int, rotation_deg: Column, fov_deg: float = 250.0) -> tuple[Column, Column]:
    u, v = _uv(row, col, width, height)
    x, y = 2 * u - 1, 2 * v - 1
    theta = 2 * F.atan(F.hypot(x, y) * math.tan(math.radians(fov_deg) / 4))
    return F.atan2(y, x) + F.radians(rotation_deg), theta - math.pi / 2


def flat(row: Column, col: Column, width: int, height: int, m: Mat, h_fov_deg: Column) -> tuple[Column, Column]:
    """Pinhole rays turned by m (see rotation.euler_matrix)."""
    u, v = _uv(row, col, width, height)
    half = F.tan(F.radians(_within(h_fov_deg, 30.0, 140.0)) / 2)
    x, y, z = apply(m, [(2 * u - 1) * half, (2 * v - 1) * half * (height / width), F.lit(1.0)])
    return F.atan2(x, z), F.atan2(y, F.hypot(x, z))


def equirect_uv(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Texture coordinates in [0, 1): longitude wraps, latitude is clamped."""
    u = lon / (2 * math.pi) + 0.5
    return u - F.floor(u), F.greatest(F.lit(0.0), F.least(F.lit(1.0), lat / math.pi + 0.5))


def letterbox(row: Column, col: Column, width: int, height: int, src_w: Column, src_h: Column) -> tuple[Column, Column, Column]:
    """(u, v, inside) of a picture shown whole and centred in a view."""
    scale = F.least(width / src_w, height / src_h)
    u = ((col + 0.5) - (width - src_w * scale) / 2) / (src_w * scale)
    v = ((row + 0.5) - (height - src_h * scale) / 2) / (src_h * scale)
    return u, v, u.between(0, 1) & v.between(0, 1)
