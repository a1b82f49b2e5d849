"""Angles, boxes and rigid transforms as column expressions. Rotations are arrays of 9 doubles, rigid transforms of 16, row by row."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PI = math.pi


def wrap(angle: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def yaw_error(a: Column, b: Column) -> Column:
    return F.abs(wrap(a - b))


def heading_degrees(a: Column, b: Column) -> Column:
    return F.degrees(yaw_error(a, b))


def axis_degrees(a: Column, b: Column) -> Column:
    """Difference of directions that don't tell front from back, in degrees."""
    return F.degrees(F.abs(F.pmod(a - b + PI / 2, F.lit(PI)) - PI / 2))


def is_flip(a: Column, b: Column) -> Column:
    return heading_degrees(a, b) > 90


def corners(cx: Column, cy: Column, length: Column, width: Column, yaw: Column) -> Column:
    """Four corners of an oriented footprint, counter-clockwise."""
    out = []
    for sx, sy in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5)):
        dx, dy = length * sx, width * sy
        out.append(F.struct((cx + dx * F.cos(yaw) - dy * F.sin(yaw)).alias("x"), (cy + dx * F.sin(yaw) + dy * F.cos(yaw)).alias("y")))
    return F.array(*out)


def box_corners(cx: Column, cy: Column, cz: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """Eight corners: the footprint at the bottom, then at the top."""
    flat = corners(cx, cy, length, width, yaw)

    def lifted(z: Column) -> Column:
        return F.transform(flat, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))

    return F.concat(lifted(cz - height / 2), lifted(cz + height / 2))


def aligned_iou(ax: Column, ay: Column, al: Column, aw: Column, bx: Column, by: Column, bl: Column, bw: Column) -> Column:
    """Intersection over union of two footprints of equal direction."""
    ox = F.greatest(F.lit(0.0), F.least(ax + al / 2, bx + bl / 2) - F.greatest(ax - al / 2, bx - bl / 2))
    oy = F.greatest(F.lit(0.0), F.least(ay + aw / 2, by + bw / 2) - F.greatest(ay - aw / 2, by - bw / 2))
    both = ox * oy
    return F.coalesce(F.try_divide(both, al * aw + bl * bw - both), F.lit(0.0))


def clipped_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas of the intersections of convex polygons (n, 4, 2), both counter-clockwise: vertices inside the other and edge crossings, ordered by angle.

    Some thousand pairs at a time, and each of the 24 possible vertices as a row of all of these: numpy is slow over short inner axes and beyond the cache.
    """
    out = np.zeros(len(p))
    for k in range(0, len(p), 4096):
        out[k : k + 4096] = clipped_part(p[k : k + 4096], q[k : k + 4096])
    return out


def clipped_part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    (px, py), (qx, qy) = (np.ascontiguousarray(v.transpose(2, 1, 0)) for v in (p, q))
    (pu, pv), (qu, qv) = ((np.roll(x, -1, axis=0) - x, np.roll(y, -1, axis=0) - y) for x, y in ((px, py), (qx, qy)))
    x, y, ok = np.empty((24, len(p))), np.empty((24, len(p))), np.empty((24, len(p)), bool)
    for at, (ax, ay, bx, by, bu, bv) in ((0, (px, py, qx, qy, qu, qv)), (4, (qx, qy, px, py, pu, pv))):
        x[at : at + 4], y[at : at + 4] = ax, ay
        ok[at : at + 4] = np.logical_and.reduce([bu[m] * (ay - by[m]) - bv[m] * (ax - bx[m]) >= -1e-12 for m in range(4)])
    for k in range(4):
        at = slice(8 + 4 * k, 12 + 4 * k)
        cross = pu[k] * qv - pv[k] * qu
        rx, ry = qx - px[k], qy - py[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (rx * qv - ry * qu) / cross, (rx * pv[k] - ry * pu[k]) / cross
        ok[at] = (np.abs(cross) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        t = np.where(ok[at], t, 0)
        x[at], y[at] = px[k] + t * pu[k], py[k] + t * pv[k]
    count = ok.sum(axis=0)
    # One row after the other, as numpy's own sum takes another order where there is one pair only.
    x, y = (v - sum(np.where(ok, v, 0)[1:], np.where(ok[0], v[0], 0)) / np.maximum(count, 1) for v in (x, y))
    angle = np.full(x.shape, np.inf)
    angle[ok] = np.arctan2(y[ok], x[ok])
    order = np.argsort(np.ascontiguousarray(angle.T), axis=1)
    out = np.zeros(len(p))
    for width, rows in ((8, np.flatnonzero((count >= 3) & (count <= 8))), (24, np.flatnonzero(count > 8))):
        # Used vertices come first; unused places repeat the first one, and add nothing.
        place = np.where(np.arange(width)[:, None] < count[rows], order[rows, :width].T, order[rows, 0])
        rx, ry = (v[place, rows] for v in (x, y))
        cross = rx * np.roll(ry, -1, axis=0) - ry * np.roll(rx, -1, axis=0)
        c = cross if width == 8 else (cross[:8] + cross[8:16]) + cross[16:]
        out[rows] = np.abs(((c[0] + c[1]) + (c[2] + c[3])) + ((c[4] + c[5]) + (c[6] + c[7]))) / 2
    return out


def box_array(b: pd.DataFrame) -> np.ndarray:
    """Rows of centre, length, width and direction."""
    return b[["cx", "cy", "len", "wid", "yaw"]].to_numpy(float)


def footprint_corners(b: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2), counter-clockwise, of rows of centre, length, width and direction."""
    c, s = np.cos(b[:, 4])[:, None], np.sin(b[:, 4])[:, None]
    dx, dy = b[:, 2, None] * np.array([0.5, -0.5, -0.5, 0.5]), b[:, 3, None] * np.array([0.5, 0.5, -0.5, -0.5])
    return np.stack((b[:, 0, None] + dx * c - dy * s, b[:, 1, None] + dx * s + dy * c), axis=2)


def aligned_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """aligned_iou of rows of centre, length and width."""
    side = [np.maximum(0.0, np.minimum(a[:, k] + a[:, k + 2] / 2, b[:, k] + b[:, k + 2] / 2) - np.maximum(a[:, k] - a[:, k + 2] / 2, b[:, k] - b[:, k + 2] / 2)) for k in (0, 1)]
    both = side[0] * side[1]
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both
    return np.where(union != 0, both / np.where(union != 0, union, 1), 0.0)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than the intersection over union: by each box's bounding box in the direction of the other. Below 0 where a line parallel to a side parts them."""
    turn = b[:, 4] - a[:, 4]
    c, s = np.abs(np.cos(turn)), np.abs(np.sin(turn))
    dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
    least, parted = None, np.zeros(len(a), bool)
    for own, other in ((a, b), (b, a)):
        u, v = np.abs(dx * np.cos(own[:, 4]) + dy * np.sin(own[:, 4])), np.abs(dy * np.cos(own[:, 4]) - dx * np.sin(own[:, 4]))
        x = np.minimum(np.minimum(own[:, 2], 2 * (h := other[:, 2] / 2 * c + other[:, 3] / 2 * s)), own[:, 2] / 2 + h - u)
        y = np.minimum(np.minimum(own[:, 3], 2 * (h := other[:, 2] / 2 * s + other[:, 3] / 2 * c)), own[:, 3] / 2 + h - v)
        parted |= (x < -1e-9) | (y < -1e-9)
        both = np.maximum(x, 0) * np.maximum(y, 0)
        least = both if least is None else np.minimum(least, both)
    union = np.maximum(a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - least, 1e-300)
    return np.where(parted, -1.0, least / union + 1e-9)


def oriented_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """oriented_iou of rows of centre, length, width and direction."""
    if not len(a):
        return np.zeros(0)
    both = clipped_area(footprint_corners(a), footprint_corners(b))
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both
    return np.clip(np.where(union > 0, both / np.where(union > 0, union, 1), 0), 0, 1)


def polygon_areas(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Areas of polygons (n, k, 2), of which the first `count` corners are theirs; 0 with fewer than three."""
    rel = x - x[:, :1]
    rel = np.where(np.arange(x.shape[1])[None, :, None] < count[:, None, None], rel, 0.0)
    after = np.roll(rel, -1, axis=1)
    return np.where(count < 3, 0.0, np.abs((rel[..., 0] * after[..., 1] - rel[..., 1] * after[..., 0]).sum(axis=1)) / 2)


def clipped_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """clipped_iou of rows of centre, length, width and direction: the steps of `clipped`, all rows together."""
    if not len(a):
        return np.zeros(0)
    p, q = footprint_corners(a), footprint_corners(b)
    x, count = p, np.full(len(p), 4)
    for k in range(4):
        start, edge = q[:, k, None, :], (q[:, (k + 1) % 4] - q[:, k])[:, None, :]
        used = np.arange(x.shape[1])[None, :] < count[:, None]
        before = np.roll(x, 1, axis=1)
        before[:, 0] = x[np.arange(len(x)), np.maximum(count - 1, 0)]
        side, ahead = ((edge[..., 0] * (v[..., 1] - start[..., 1]) - edge[..., 1] * (v[..., 0] - start[..., 0])) >= -1e-12 for v in (x, before))
        slope = (x[..., 0] - before[..., 0]) * edge[..., 1] - (x[..., 1] - before[..., 1]) * edge[..., 0]
        flat = np.abs(slope) <= 1e-15
        t = ((start[..., 0] - before[..., 0]) * edge[..., 1] - (start[..., 1] - before[..., 1]) * edge[..., 0]) / np.where(flat, 1.0, slope)
        cut = np.where(flat[..., None], x, before + t[..., None] * (x - before))
        made = np.stack((cut, x), axis=2).reshape(len(x), -1, 2)
        kept = np.stack((used & (side != ahead), used & side), axis=2).reshape(len(x), -1)
        count = kept.sum(axis=1)
        # Eight corners at the end, whatever the other rows have, so that a row's sum doesn't depend on them.
        order = np.argsort(~kept, axis=1, kind="stable")[:, : max(5 + k, count.max())]
        x = np.take_along_axis(made, order[..., None], axis=1)
    both = polygon_areas(x, count)
    union = polygon_areas(p, np.full(len(p), 4)) + polygon_areas(q, np.full(len(q), 4)) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1.0), 0.0)


def screened(measure: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float = 0.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same measure where the bound lets it reach `least`, 0 elsewhere."""

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, near = np.zeros(len(a)), overlap_bound(a, b) >= least
        out[near] = measure(a[near], b[near])
        return out

    return of


@F.pandas_udf(T.DoubleType())
def oriented_iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Intersection over union of oriented footprints struct<cx,cy,len,wid,yaw>, clamped to [0, 1]."""
    return pd.Series(oriented_overlap(box_array(a), box_array(b)))


def clipped(polygon: Column, other: Column) -> Column:
    """The part of a convex polygon (array of struct x, y) inside another, both counter-clockwise: cut along each of the other's edges in turn. A point on an edge
    is inside, within 1e-12; the result has corners in order, some of them perhaps twice, or none."""

    def inside(p: Column, a: Column, b: Column) -> Column:
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) >= -1e-12

    def crossing(p: Column, q: Column, a: Column, b: Column) -> Column:
        slope = (q["x"] - p["x"]) * (b["y"] - a["y"]) - (q["y"] - p["y"]) * (b["x"] - a["x"])
        t = ((a["x"] - p["x"]) * (b["y"] - a["y"]) - (a["y"] - p["y"]) * (b["x"] - a["x"])) / slope
        at = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.when(F.abs(slope) <= 1e-15, F.struct(q["x"].alias("x"), q["y"].alias("y"))).otherwise(at)

    def cut(left: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        # Each side of the polygon, from the corner before: what of it is inside adds its crossing, its end, both or nothing.
        sides = F.zip_with(F.concat(F.slice(left, -1, 1), F.slice(left, F.lit(1), F.size(left) - 1)), left, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def kept(side: Column) -> Column:
            p, q = side["p"], side["q"]
            here, there = inside(q, a, b), inside(p, a, b)
            own = F.array(F.struct(q["x"].alias("x"), q["y"].alias("y")))
            return F.when(here & there, own).when(here, F.concat(F.array(crossing(p, q, a, b)), own)).when(there, F.array(crossing(p, q, a, b))).otherwise(F.slice(own, 1, 0))

        return F.when(F.size(left) == 0, left).otherwise(F.flatten(F.transform(sides, kept)))

    edges = F.zip_with(other, F.concat(F.slice(other, F.lit(2), F.size(other) - 1), F.slice(other, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, polygon, cut)


def polygon_area(polygon: Column) -> Column:
    """Area of a polygon (array of struct x, y) by its corners' cross products, seen from the first corner; 0 with fewer than three."""

    def area(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        following = F.concat(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 1, 1))
        terms = F.zip_with(own, following, lambda a, b: (a["x"] - first["x"]) * (b["y"] - first["y"]) - (a["y"] - first["y"]) * (b["x"] - first["x"]))
        return F.when(F.size(own) < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2)

    # As a parameter, the polygon is worked out once, not at each of its uses.
    return F.get(F.transform(F.array(polygon), area), F.lit(0))


@F.pandas_udf(T.DoubleType())
def clipped_iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Intersection over union of oriented footprints struct<cx,cy,len,wid,yaw> as evaluation takes it: by clipping, with areas of polygons, and not clamped."""
    return pd.Series(clipped_overlap(box_array(a), box_array(b)))


@F.pandas_udf(T.LongType())
def ulp_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of floats between two floats."""

    def ordered(x: pd.Series) -> np.ndarray:
        bits = x.to_numpy(np.float32).view(np.int32).astype(np.int64)
        return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)

    return pd.Series(np.abs(ordered(a) - ordered(b)))


def axes_overlap(ax: Column, ay: Column, al: Column, aw: Column, yaw: Column, bx: Column, by: Column, half: float) -> Column:
    """Separating-axis test of an oriented footprint against a square cell of half side `half`; touching counts."""
    c, s = F.cos(yaw), F.sin(yaw)
    dx, dy = bx - ax, by - ay
    grid = (F.abs(dx) <= half + al / 2 * F.abs(c) + aw / 2 * F.abs(s)) & (F.abs(dy) <= half + al / 2 * F.abs(s) + aw / 2 * F.abs(c))
    own = (F.abs(dx * c + dy * s) <= al / 2 + half * (F.abs(c) + F.abs(s))) & (F.abs(dy * c - dx * s) <= aw / 2 + half * (F.abs(c) + F.abs(s)))
    return grid & own


def regions(x: Column, y: Column) -> Column:
    """12 sectors of 30 degrees, 4 quadrants and 3 radial bins of a place in the sensor's frame."""
    r = F.hypot(x, y)
    return F.struct(
        F.floor(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)) / 30).cast("int").alias("sector"),
        (F.when(x < 0, 2).otherwise(0) + F.when(y < 0, 1).otherwise(0)).alias("quadrant"),
        F.when(r < 20, 0).when(r < 35, 1).otherwise(2).alias("radial"),
    )


def yaw_quaternion(yaw: Column) -> Column:
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(yaw / 2).alias("z"), F.cos(yaw / 2).alias("w"))


def rotation(axis: str, angle: Column) -> Column:
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    rows = {"x": (o, z, z, z, c, -s, z, s, c), "y": (c, z, s, z, o, z, -s, z, c), "z": (c, -s, z, s, c, z, z, z, o)}
    return F.array(*rows[axis])


def rigid(r: Column | list[Column], t: list[Column]) -> Column:
    return F.array(*(x for k in range(3) for x in (r[3 * k], r[3 * k + 1], r[3 * k + 2], t[k])), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def compose(a: Column | list[Column], b: Column | list[Column]) -> Column:
    """The product of two 4x4 transforms, each an array or its 16 entries; entries keep the expression small where one is itself computed."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def inverse_entries(m: Column) -> list[Column]:
    """The 16 entries of a rigid transform's inverse: the transposed rotation, and the translation seen through it."""
    t = [-(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11]) for i in range(3)]
    return [*(x for i in range(3) for x in (m[i], m[4 + i], m[8 + i], t[i])), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def inverse(m: Column) -> Column:
    return F.array(*inverse_entries(m))


def is_rigid(m: Column, tolerance: float = 1e-6) -> Column:
    out = (m[12] == 0) & (m[13] == 0) & (m[14] == 0) & (m[15] == 1)
    for i in range(3):
        for j in range(i, 3):
            out = out & (F.abs(sum((m[4 * i + k] * m[4 * j + k] for k in range(1, 3)), m[4 * i] * m[4 * j]) - float(i == j)) <= tolerance)
    det = m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])
    return out & (F.abs(det - 1) <= tolerance)


def apply(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [m[4 * k] * x + m[4 * k + 1] * y + m[4 * k + 2] * z + m[4 * k + 3] for k in range(3)]


def rotation_angle(m: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[5] + m[10] - 1) / 2)))


def quaternion_entries(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The 9 entries of a quaternion's rotation, scaled by its squared norm."""
    n = w * w + x * x + y * y + z * z
    s = F.lit(2.0) / n
    return [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.array(*quaternion_entries(w, x, y, z))


def storage_transform(w: Column, x: Column, y: Column, z: Column, t: list[Column], tolerance: float = 1e-6) -> Column:
    """The single-precision pair (a, b) = (transposed rotation, -transposed rotation times t) with which row vectors move as p a - b; null unless the
    quaternion's squared norm is within tolerance of 1."""
    r = quaternion_entries(w, x, y, z)
    turned = [r[k] * t[0] + r[3 + k] * t[1] + r[6 + k] * t[2] for k in range(3)]
    pair = F.struct(F.array(*(r[3 * j + i].cast("float") for i in range(3) for j in range(3))).alias("a"), F.array(*((-v).cast("float") for v in turned)).alias("b"))
    return F.when(F.abs(w * w + x * x + y * y + z * z - 1) <= tolerance, pair)


def model_rotation() -> Column:
    """4x4: native axes (x ahead, y left) to model axes (x right, y ahead)."""
    return F.array(*(F.lit(float(v)) for v in (0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)))


def native_corners(model: Column) -> Column:
    """Corners in model axes back in native ones."""
    return F.transform(model, lambda c: F.struct(c["y"].alias("x"), (-c["x"]).alias("y"), c["z"].alias("z")))


def calibration_chains(imu_to_velo: Column, velo_to_camera: Column, rectification: Column) -> dict[str, Column]:
    """Chains of a drive's calibration: sensor to IMU, rectified camera from IMU, and the virtual model-axis sensor to IMU."""
    velo_to_imu = inverse(imu_to_velo)
    return {"velo_to_imu": velo_to_imu, "camera_from_imu": compose(rectification, compose(velo_to_camera, imu_to_velo)), "model_to_imu": compose(inverse_entries(imu_to_velo), inverse_entries(model_rotation()))}


def slerp(p: list[Column], q: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions the short way round; linear and normalised where they are nearly equal."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.lit(1.0), F.abs(dot))
    theta = F.acos(d)
    near = d > 0.9995
    a = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), F.sin(theta)))
    b = F.when(near, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta))) * sign
    mixed = [a * x + b * y for x, y in zip(p, q, strict=True)]
    norm = F.sqrt(sum((m * m for m in mixed[1:]), mixed[0] * mixed[0]))
    return [m / norm for m in mixed]


def rotation_quaternion(m: Column, row: int = 4) -> list[Column]:
    """w, x, y, z of the rotation in an array of rows of that length (4: a rigid transform, 3: a rotation), of unit length.

    By the trace where it is positive, otherwise by the largest of the diagonal, the first of equals, so that no small number is divided by.
    """
    r = [[m[row * i + j] for j in range(3)] for i in range(3)]
    skew = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
    pair = {(0, 1): r[0][1] + r[1][0], (0, 2): r[0][2] + r[2][0], (1, 2): r[1][2] + r[2][1]}
    trace = r[0][0] + r[1][1] + r[2][2]
    # Each branch, times the square root that all its parts are divided by in the end.
    branches = [[trace + 1, *skew]]
    for k in range(3):
        i, j = (n for n in range(3) if n != k)
        parts = {k: r[k][k] - r[i][i] - r[j][j] + 1, i: pair[min(k, i), max(k, i)], j: pair[min(k, j), max(k, j)]}
        branches.append([skew[k], *(parts[n] for n in range(3))])
    diagonal = [r[k][k] for k in range(3)]
    which = F.when(trace > 0, 0).when((diagonal[0] >= diagonal[1]) & (diagonal[0] >= diagonal[2]), 1).when(diagonal[1] >= diagonal[2], 2).otherwise(3)
    q = [F.when(which == 0, branches[0][n]).when(which == 1, branches[1][n]).when(which == 2, branches[2][n]).otherwise(branches[3][n]) for n in range(4)]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [v / norm for v in q]


def rotation_distance(p: list[Column], q: list[Column]) -> Column:
    """The angle between two rotations by their unit quaternions, 0 to pi: both signs of a quaternion are one rotation. By the arc tangent of the quotient's
    two parts, so angles too small for an arc cosine keep their digits."""
    (a, b, c, d), (w, x, y, z) = p, q
    scalar = a * w + b * x + c * y + d * z
    vector = [a * x - b * w - c * z + d * y, a * y + b * z - c * w - d * x, a * z - b * y + c * x - d * w]
    return 2 * F.atan2(F.sqrt(vector[0] * vector[0] + vector[1] * vector[1] + vector[2] * vector[2]), F.abs(scalar))
