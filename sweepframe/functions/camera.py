"""Visibility of boxes in a reference camera."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corner pairs of a box's edges: around the footprint below (corners 0 to 3), around the one above (4 to 7), and upright.
EDGES = [pair for k in range(4) for pair in ((k, (k + 1) % 4), (4 + k, 4 + (k + 1) % 4), (k, 4 + k))]


def with_visibility(df: DataFrame, corners: str, camera: dict) -> DataFrame:
    """df with `visible`: whether the projection of the part of a box in front of the near plane meets the half-open image. Places whose projected depth
    isn't positive are left out.

    camera: 4x4 extrinsic e and 3x4 projection p (row by row), width, height, near. Each step is a parameter of the next, so it is
    worked out once even where a filter on `visible` is pushed down to the corners; columns of their own would be put into each other there.
    """
    e, p, near = camera["e"], camera["p"], camera["near"]

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def ends(seen: Column) -> Column:
        return F.array(*(F.struct(F.get(seen, F.lit(i)).alias("a"), F.get(seen, F.lit(j)).alias("b")) for i, j in EDGES))

    def crossing(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        return bound(F.try_divide(F.lit(near) - a["z"], b["z"] - a["z"]), lambda t: F.struct(*((a[n] + t * (b[n] - a[n])).alias(n) for n in "xyz")))

    def project(c: Column) -> Column:
        u, v, w = (c["x"] * p[4 * k] + c["y"] * p[4 * k + 1] + c["z"] * p[4 * k + 2] + p[4 * k + 3] for k in range(3))
        return F.struct(F.try_divide(u, w).alias("u"), F.try_divide(v, w).alias("v"), w.alias("w"))

    def places(seen: Column) -> Column:
        cut = F.filter(ends(seen), lambda x: (x["a"]["z"] >= near) != (x["b"]["z"] >= near))
        return F.concat(F.filter(seen, lambda c: c["z"] >= near), F.transform(cut, crossing))

    def inside(flat: Column) -> Column:
        u, v = F.transform(flat, lambda c: c["u"]), F.transform(flat, lambda c: c["v"])
        return (F.size(flat) > 0) & (F.array_max(u) >= 0) & (F.array_min(u) < camera["width"]) & (F.array_max(v) >= 0) & (F.array_min(v) < camera["height"])

    seen = F.transform(corners, lambda c: F.struct(*((c["x"] * e[4 * k] + c["y"] * e[4 * k + 1] + c["z"] * e[4 * k + 2] + e[4 * k + 3]).alias(n) for k, n in enumerate("xyz"))))
    visible = bound(bound(seen, places), lambda x: bound(F.filter(F.transform(x, project), lambda c: c["w"] > 0), inside))
    return df.withColumn("visible", F.coalesce(visible, F.lit(False)))
