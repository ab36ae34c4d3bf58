"""Per-frame corrections from orientations: horizon, lock, smooth; Euler angles and delta commands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rotation as R
from ..functions.rotation import BODY_TO_EQUIRECT, EQUIRECT_DOWN, WORLD_DOWN, matmul, pack_matrix, quat, to_matrix, transpose

MODES = ("horizon", "lock", "smooth")
#: Frames of a clip that one task smooths.
BLOCK = 1 << 14


def half_window(strength: float, fps: float) -> int:
    """Frames on either side of the smoothing window."""
    return max(1, round((0.1 + 1.4 * strength) * fps * 0.5))


def _slerp(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """rotation.slerp() of rows."""
    d0 = a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2] + a[:, 3] * b[:, 3]
    d = np.minimum(np.abs(d0), 1.0)
    near, angle = d > 0.9995, np.arccos(d)
    s = np.where(near, 1.0, np.sin(angle))
    wa = np.where(near, 1 - f, np.sin((1 - f) * angle) / s)
    wb = np.where(d0 < 0, -1.0, 1.0) * np.where(near, f, np.sin(f * angle) / s)
    q = a * wa[:, None] + b * wb[:, None]
    n = np.sqrt(q[:, 0] * q[:, 0] + q[:, 1] * q[:, 1] + q[:, 2] * q[:, 2] + q[:, 3] * q[:, 3])[:, None]
    return np.where(n < 1e-12, [1.0, 0.0, 0.0, 0.0], q / np.where(n < 1e-12, 1.0, n))


def smooth(frames: DataFrame, half: int, block: int = BLOCK) -> DataFrame:
    """Adds qs: the running slerp mean over the frames from i - half to i + half, in order.

    A clip's frames are dealt to tasks in blocks, each with the frames of its windows from the blocks beside it. A step
    of the fold is taken for all frames of a block at once. Frames without q are passed over.
    """
    n = F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1
    placed = frames.withColumn("_n", n.cast("long"))
    into = F.sequence(F.floor((F.col("_n") - half) / block), F.floor((F.col("_n") + half) / block))
    dealt = placed.withColumn("_block", F.explode(into)).where("_block >= 0")
    schema = T.StructType([*frames.schema.fields, T.StructField("qs", T.StructType([T.StructField(c, T.DoubleType()) for c in "wxyz"]))])

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("_n").combine_chunks()
        q = rows["q"].combine_chunks()
        given = np.asarray(q.is_valid())
        q = np.stack([q.field(c).to_numpy(zero_copy_only=False) for c in "wxyz"], 1).astype(float)
        at = rows["_n"].to_numpy()
        own = np.flatnonzero(at // block == key[1].as_py())
        mean, count = np.zeros((len(own), 4)), np.zeros(len(own), int)
        for step in range(-half, half + 1):
            i = own + step
            hit = np.flatnonzero((i >= 0) & (i < len(at)))
            hit = hit[given[i[hit]]]
            count[hit] += 1
            b = q[i[hit]]
            mean[hit] = np.where((count[hit] == 1)[:, None], b, _slerp(mean[hit], b, 1.0 / count[hit]))
        qs = pa.StructArray.from_arrays([pa.array(mean[:, k]) for k in range(4)], names=list("wxyz"))
        kept = rows.take(pa.array(own)).select([f.name for f in schema.fields[:-1]])
        return kept.append_column("qs", qs)

    return dealt.groupBy("clip", "_block").applyInArrow(run, schema)


def corrections(frames: DataFrame, mode: str = "horizon", strength: float = 1.0, ref_frame: int = 0, fps: float = 25.0, baseline_yaw_deg: float | None = None) -> DataFrame:
    """clip, frame, yaw, pitch, roll of the content rotation. frames: clip, frame, q (unit)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    s = max(0.0, min(1.0, float(strength)))
    if mode == "horizon":
        got = frames.select("clip", "frame", pack_matrix(to_matrix(quat("q"))).alias("b"))
        down = R.apply(BODY_TO_EQUIRECT, R.apply(transpose(R.matrix("b")), WORLD_DOWN))
        got = got.select("clip", "frame", F.array(*R.unit(down)).alias("g"))
        m = R.minimal_rotation([F.col("g")[i] for i in range(3)], EQUIRECT_DOWN)
    else:
        if mode == "lock":
            w = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            last = F.max("frame").over(Window.partitionBy("clip"))
            at = F.greatest(F.lit(0), F.least(F.lit(ref_frame), last))
            frames = frames.withColumn("_at", at)
            ref = F.first(F.when(F.col("frame") == F.col("_at"), F.col("q")), ignorenulls=True).over(w)
        else:
            frames, ref = smooth(frames, half_window(s, fps)), F.col("qs")
        got = frames.select("clip", "frame", "q", ref.alias("r"))
        got = got.select("clip", "frame", pack_matrix(to_matrix(quat("q"))).alias("b"), pack_matrix(to_matrix(quat("r"))).alias("r"))
        got = got.select("clip", "frame", pack_matrix(matmul(transpose(R.matrix("r")), R.matrix("b"))).alias("d"))
        m = matmul(BODY_TO_EQUIRECT, matmul(R.matrix("d"), transpose(BODY_TO_EQUIRECT)))
    got = got.select("clip", "frame", pack_matrix(m).alias("m"))
    if mode != "smooth" and s < 0.999:
        got = got.select("clip", "frame", pack_matrix(R.attenuate(R.matrix("m"), s)).alias("m"))
    if baseline_yaw_deg is not None:
        base = R.euler_matrix(F.lit(float(baseline_yaw_deg)), F.lit(0.0), F.lit(0.0))
        got = got.select("clip", "frame", pack_matrix(matmul(base, R.matrix("m"))).alias("m"))
    yaw, pitch, roll = R.euler(R.matrix("m"))
    return got.select("clip", "frame", yaw.alias("yaw"), pitch.alias("pitch"), roll.alias("roll"))


def deltas(angles: DataFrame, fps: float = 25.0) -> DataFrame:
    """clip, frame, t, dyaw, dpitch, droll: the rotation from the previous frame's target to this one's, half a frame early."""
    w = Window.partitionBy("clip").orderBy("frame")
    got = angles.select("clip", "frame", pack_matrix(R.euler_matrix(F.col("yaw"), F.col("pitch"), F.col("roll"))).alias("m"), F.row_number().over(w).alias("_n"))
    eye = pack_matrix([[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)])
    got = got.withColumn("p", F.coalesce(F.lag("m").over(w), eye))
    got = got.select("clip", "frame", "_n", pack_matrix(matmul(transpose(R.matrix("p")), R.matrix("m"))).alias("c"))
    yaw, pitch, roll = R.euler(R.matrix("c"))
    return got.select("clip", "frame", F.greatest(F.lit(0.0), (F.col("_n") - 1.5) / fps).alias("t"), yaw.alias("dyaw"), pitch.alias("dpitch"), roll.alias("droll"))


def commands(delta: DataFrame) -> DataFrame:
    """clip, frame, line of a command script."""
    return delta.select("clip", "frame", F.format_string("%.6f v360 yaw %.4f, v360 pitch %.4f, v360 roll %.4f;", "t", "dyaw", "dpitch", "droll").alias("line"))
