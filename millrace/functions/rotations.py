"""Rigid transforms as columns: unit quaternions (w, x, y, z) and translations in one struct."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def pose(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for v, n in zip(values, FIELDS, strict=True)])


def _q(p: Column) -> list[Column]:
    return [p[n] for n in FIELDS[:4]]


def _t(p: Column) -> list[Column]:
    return [p[n] for n in FIELDS[4:]]


def _times(a: list[Column], b: list[Column]) -> list[Column]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def _turned(q: list[Column], v: list[Column]) -> list[Column]:
    w, x, y, z = q
    vx, vy, vz = v
    # twice the cross product of the vector part with v, and again
    cx, cy, cz = 2 * (y * vz - z * vy), 2 * (z * vx - x * vz), 2 * (x * vy - y * vx)
    return [vx + w * cx + y * cz - z * cy, vy + w * cy + z * cx - x * cz, vz + w * cz + x * cy - y * cx]


def multiply(a: Column, b: Column) -> Column:
    moved = _turned(_q(a), _t(b))
    return pose(*_times(_q(a), _q(b)), *[s + m for s, m in zip(_t(a), moved, strict=True)])


def inverse(p: Column) -> Column:
    w, x, y, z = _q(p)
    back = [w, -x, -y, -z]
    return pose(*back, *[-c for c in _turned(back, _t(p))])


def angle(p: Column) -> Column:
    """The rotation's angle, 0 to pi."""
    w, x, y, z = _q(p)
    return 2 * F.atan2(F.sqrt(x * x + y * y + z * z), F.abs(w))


def slerp(a: Column, b: Column, share: Column) -> list[Column]:
    """Quaternion components on the shorter arc from a to b."""
    p, q = _q(a), _q(b)
    dot = sum(x * y for x, y in zip(p[1:], q[1:], strict=True)) + p[0] * q[0]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    theta = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.sin(theta) < 1e-9
    u = F.when(near, 1 - share).otherwise(F.sin((1 - share) * theta) / F.when(near, F.lit(1.0)).otherwise(F.sin(theta)))
    v = F.when(near, share).otherwise(F.sin(share * theta) / F.when(near, F.lit(1.0)).otherwise(F.sin(theta))) * sign
    return [u * x + v * y for x, y in zip(p, q, strict=True)]


def interpolate(a: Column, b: Column, share: Column) -> Column:
    """Rotation on the arc, translation on the line."""
    return pose(*slerp(a, b, share), *[x + share * (y - x) for x, y in zip(_t(a), _t(b), strict=True)])


def yaw(p: Column) -> Column:
    w, x, y, z = _q(p)
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def about_z(radians: Column | float, tx=0.0, ty=0.0, tz=0.0) -> Column:
    r = radians if isinstance(radians, Column) else F.lit(float(radians))
    return pose(F.cos(r / 2), 0.0, 0.0, F.sin(r / 2), tx, ty, tz)


HALF_TURN = math.pi


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quaternions (rows of w, x, y, z) times quaternions."""
    w = a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(axis=1, keepdims=True)
    return np.concatenate([w, a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])], axis=1)


def _rotated(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    c = 2 * np.cross(q[:, 1:], v)
    return v + q[:, :1] * c + np.cross(q[:, 1:], c)


def _screw(q: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The motions (q, t) gone on for e: the angle and the translation along the axis are multiplied, across the axis it is an arc."""
    q = np.where(q[:, :1] < 0, -q, q)  # the shorter way
    norm = np.linalg.norm(q[:, 1:], axis=1, keepdims=True)
    turns = norm > 1e-12
    axis = np.where(turns, q[:, 1:] / np.where(turns, norm, 1.0), 0.0)
    half = np.arctan2(norm, q[:, :1])
    along = (axis * t).sum(axis=1, keepdims=True)
    back = half * (e - 1)
    moved = _rotated(np.concatenate([np.cos(back / 2), np.sin(back / 2) * axis], axis=1), t - along * axis)
    arc = np.sin(half * e) / np.where(turns, np.sin(half), 1.0)
    return np.concatenate([np.cos(half * e), np.sin(half * e) * axis], axis=1), np.where(turns, e * along * axis + arc * moved, e * t)


def slerp_pose(a: Column, b: Column, share: Column) -> Column:
    """On the screw motion from a to b: a times (inverse of a times b) to the power of ``share``. Arrow batches; a null pose gives no numbers."""

    @F.pandas_udf(", ".join(f"{n} double" for n in FIELDS))
    def run(first: pd.DataFrame, second: pd.DataFrame, e: pd.Series) -> pd.DataFrame:
        x, y = (p[list(FIELDS)].to_numpy(dtype=float) for p in (first, second))
        back = x[:, :4] * [1.0, -1.0, -1.0, -1.0]
        q, t = _screw(_products(back, y[:, :4]), _rotated(back, y[:, 4:] - x[:, 4:]), e.to_numpy(dtype=float)[:, None])
        return pd.DataFrame(np.concatenate([_products(x[:, :4], q), x[:, 4:] + _rotated(x[:, :4], t)], axis=1), columns=list(FIELDS))

    return run(a, b, share.cast("double"))


def power(p: Column, exponent: Column | float) -> Column:
    """The screw motion of ``p`` gone on for ``exponent``."""
    return slerp_pose(pose(1, 0, 0, 0, 0, 0, 0), p, exponent if isinstance(exponent, Column) else F.lit(float(exponent)))


def from_euler(roll: Column, pitch: Column, yaw_: Column, tx: Column | float = 0.0, ty: Column | float = 0.0, tz: Column | float = 0.0) -> Column:
    """The turn about x by ``roll``, times that about y by ``pitch``, times that about z by ``yaw_``."""
    zero = F.lit(0.0)
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw_))
    return pose(*_times(_times([cr, sr, zero, zero], [cp, zero, sp, zero]), [cy, zero, zero, sy]), tx, ty, tz)


def euler(p: Column) -> Column:
    """struct(roll, pitch, yaw) of :func:`from_euler`; the roll is within a quarter turn either way."""
    w, x, y, z = _q(p)
    roll = F.atan2(2 * (w * x - y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (x * z + w * y))))
    turn = F.atan2(2 * (w * z - x * y), 1 - 2 * (y * y + z * z))
    far = F.abs(roll) > math.pi / 2
    other = F.when(turn > 0, turn - math.pi).otherwise(turn + math.pi)
    return F.struct(F.when(far, roll - F.signum(roll) * math.pi).otherwise(roll).alias("roll"), F.when(far, math.pi - pitch).otherwise(pitch).alias("pitch"), F.when(far, other).otherwise(turn).alias("yaw"))


def flat(p: Column) -> Column:
    """struct(angle, x, y): the pose in the plane, its turn about z and its translation along x and y."""
    return F.struct(yaw(p).alias("angle"), p["tx"].alias("x"), p["ty"].alias("y"))


def from_flat(p: Column) -> Column:
    """The pose of struct(angle, x, y) in the plane z = 0."""
    return about_z(p["angle"], p["x"], p["y"], 0.0)
