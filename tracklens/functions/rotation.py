"""Quaternions [w, x, y, z] and 3x3 matrices as column expressions.

A quaternion is a list of four columns, a matrix a list of three rows of three. pack()/unpack() move them in
and out of a struct column, which keeps expression trees small between steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Quat = list[Column]
Mat = list[list[Column]]

#: Body axes in the equirect frame (rows: its x, y, z).
BODY_TO_EQUIRECT = [[0.0, 0.0, -1.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
WORLD_DOWN, EQUIRECT_DOWN = [0.0, 0.0, 1.0], [0.0, -1.0, 0.0]
BASELINE_YAW_DEG = 90.0


def quat(name: str) -> Quat:
    return [F.col(f"{name}.{c}") for c in "wxyz"]


def pack_quat(q: Quat) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(q, "wxyz", strict=True)))


def matrix(name: str) -> Mat:
    return [[F.col(f"{name}.m{i}{j}") for j in range(3)] for i in range(3)]


def pack_matrix(m: Mat) -> Column:
    return F.struct(*((m[i][j] if isinstance(m[i][j], Column) else F.lit(float(m[i][j]))).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def dot(a: list, b: list):
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalize(q: Quat) -> Quat:
    """Unit quaternion; identity for a norm under 1e-12."""
    n = F.sqrt(dot(q, q))
    return [F.when(n < 1e-12, F.lit(1.0 if i == 0 else 0.0)).otherwise(c / n) for i, c in enumerate(q)]


def conjugate(q: Quat) -> Quat:
    return [q[0], -q[1], -q[2], -q[3]]


def multiply(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def slerp(a: Quat, b: Quat, f: Column) -> Quat:
    """Shortest-path interpolation of unit quaternions; a normalised straight line where they nearly agree (dot > 0.9995)."""
    d0 = dot(a, b)
    sign = F.when(d0 < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = F.least(F.abs(d0), F.lit(1.0))
    angle = F.acos(d)
    s = F.sin(angle)
    near = d > 0.9995
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / s)
    wb = sign * F.when(near, f).otherwise(F.sin(f * angle) / s)
    return normalize([x * wa + y * wb for x, y in zip(a, b, strict=True)])


def slerp_step(df: DataFrame, a: str, b: str, f: str, out: str) -> DataFrame:
    """slerp() of quaternion columns as a column of df. Each step is a column of its own, so that generated code stays small."""
    d = df.withColumn("_dot", dot(quat(a), quat(b)))
    d = d.withColumn("_cos", F.least(F.abs("_dot"), F.lit(1.0)))
    d = d.withColumn("_angle", F.acos("_cos"))
    near, x, angle = F.col("_cos") > 0.9995, F.col(f), F.col("_angle")
    d = d.withColumn("_wa", F.when(near, 1 - x).otherwise(F.sin((1 - x) * angle) / F.sin(angle)))
    d = d.withColumn("_wb", F.when(F.col("_dot") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.when(near, x).otherwise(F.sin(x * angle) / F.sin(angle)))
    d = d.withColumn("_mix", pack_quat([p * F.col("_wa") + q * F.col("_wb") for p, q in zip(quat(a), quat(b), strict=True)]))
    return normalized_step(d, "_mix", out).drop("_dot", "_cos", "_angle", "_wa", "_wb", "_mix")


def normalized_step(df: DataFrame, q: str, out: str) -> DataFrame:
    """normalize() of a quaternion column, its norm computed once."""
    n = F.col("_norm")
    unit = [F.when(n < 1e-12, F.lit(1.0 if i == 0 else 0.0)).otherwise(c / n) for i, c in enumerate(quat(q))]
    return df.withColumn("_norm", F.sqrt(dot(quat(q), quat(q)))).withColumn(out, pack_quat(unit)).drop("_norm")


def to_matrix(q: Quat) -> Mat:
    """Rotation of a unit quaternion: v_world = R v_body."""
    w, x, y, z = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def transpose(m: Mat) -> Mat:
    return [list(r) for r in zip(*m, strict=True)]


def _sum(terms: list):
    """Sum of products with constant zeros left out."""
    out = None
    for a, b in terms:
        if isinstance(a, (int, float)) and a == 0 or isinstance(b, (int, float)) and b == 0:
            continue
        t = b if isinstance(a, (int, float)) and a == 1 else a if isinstance(b, (int, float)) and b == 1 else a * b
        out = t if out is None else out + t
    return 0.0 if out is None else out


def matmul(a: Mat, b: Mat) -> Mat:
    return [[_sum([(a[i][k], b[k][j]) for k in range(3)]) for j in range(3)] for i in range(3)]


def apply(m: Mat, v: list) -> list:
    return [_sum(list(zip(m[i], v, strict=True))) for i in range(3)]


def euler_matrix(yaw: Column, pitch: Column, roll: Column) -> Mat:
    """Ry(yaw) Rx(pitch) Rz(roll), degrees."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(x)) for x in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return [[cy * cr + sy * sp * sr, sy * sp * cr - cy * sr, sy * cp], [cp * sr, cp * cr, -sp], [cy * sp * sr - sy * cr, sy * sr + cy * sp * cr, cy * cp]]


def euler(m: Mat) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) in degrees with euler_matrix(...) = m; at gimbal lock roll is 0 and yaw takes all."""
    c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    p = F.asin(clamp(c(m[1][2]), -1.0, 1.0))
    free = F.abs(F.cos(p)) > 1e-6
    roll = F.when(free, F.atan2(c(m[1][0]), c(m[1][1]))).otherwise(F.lit(0.0))
    yaw = F.when(free, F.atan2(c(m[0][2]), c(m[2][2]))).otherwise(F.atan2(-c(m[2][0]), c(m[0][0])))
    return F.degrees(yaw), -F.degrees(p), F.degrees(roll)


def minimal_rotation(a: list, b: list) -> Mat:
    """Smallest rotation of unit vector a onto unit vector b; opposite vectors turn about x."""
    v = [_sum([(a[1], b[2])]) - _sum([(a[2], b[1])]), _sum([(a[2], b[0])]) - _sum([(a[0], b[2])]), _sum([(a[0], b[1])]) - _sum([(a[1], b[0])])]
    v = [x if isinstance(x, Column) else F.lit(float(x)) for x in v]
    c, s = _sum(list(zip(a, b, strict=True))), F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = 1 / (1 + c)
    cross = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    flip = [1.0, -1.0, -1.0]

    def entry(i: int, j: int) -> Column:
        one = 1.0 if i == j else 0.0
        square = v[i] * v[j] - (s * s if i == j else F.lit(0.0))
        return F.when(s >= 1e-9, F.lit(one) + cross[i][j] + square * k).when(c > 0, F.lit(one)).otherwise(F.lit(flip[i] if i == j else 0.0))

    return [[entry(i, j) for j in range(3)] for i in range(3)]


def attenuate(m: Mat, strength: float) -> Mat:
    """The rotation by `strength` of m's angle about m's axis."""
    eye = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    if strength >= 0.999:
        return m
    if strength <= 0.001:
        return eye
    angle = F.acos(clamp((m[0][0] + m[1][1] + m[2][2] - 1) / 2, -1.0, 1.0))
    axis = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    n = F.sqrt(dot(axis, axis))
    u = [x / n for x in axis]
    part = angle * strength
    sin, cos = F.sin(part), F.cos(part)
    cross = [[F.lit(0.0), -u[2], u[1]], [u[2], F.lit(0.0), -u[0]], [-u[1], u[0], F.lit(0.0)]]

    def entry(i: int, j: int) -> Column:
        square = u[i] * u[j] - (1.0 if i == j else 0.0)
        return F.when(angle < 1e-6, eye[i][j]).when(n < 1e-9, m[i][j]).otherwise(eye[i][j] + sin * cross[i][j] + (1 - cos) * square)

    return [[entry(i, j) for j in range(3)] for i in range(3)]


def unit(v: list) -> list:
    n = F.sqrt(dot(v, v))
    return [x / n for x in v]
