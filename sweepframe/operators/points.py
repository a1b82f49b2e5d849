"""Projections, filters, labels, grids and audits of point tables (one row per point, keyed by frame and row_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions.numeric import cell, f32, fraction, is_finite

FRAME = ["drive_id", "frame_index"]
XYZ = ["x", "y", "z"]
#: Shared class of each tile label.
TILE_CLASSES = {1: 0, 2: 1, 3: 2, 4: 3, 6: 4, 7: 5, 8: 6}
#: Half side of the detection range and its height.
SIDE, BOTTOM, TOP = 50.0, -5.0, 3.0


def min_xyz(points: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Points moved by their frame's smallest coordinates, in single precision. The minima are pre-aggregated and joined back, so no frame is sorted."""
    low = points.groupBy(*keys).agg(*(F.min(c).alias(f"{c}0") for c in XYZ))
    return points.join(low, keys).select(*(F.col(c) if c not in XYZ else f32(F.col(c) - F.col(f"{c}0")).alias(c) for c in points.columns), *(F.col(f"{c}0") for c in XYZ))


def in_crop(x: Column, y: Column, z: Column, side: float = SIDE, bottom: float = BOTTOM, top: float = TOP) -> Column:
    """Strictly inside on all faces."""
    return (x > -side) & (x < side) & (y > -side) & (y < side) & (z > bottom) & (z < top)


def in_range(x: Column, y: Column, z: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    """Half-open on each axis."""
    out = F.lit(True)
    for c, a, b in zip((x, y, z), low, high, strict=True):
        out = out & (c >= a) & (c < b)
    return out


def too_close(x: Column, y: Column, radius: float) -> Column:
    return (F.abs(x) < radius) & (F.abs(y) < radius)


def even_subsample(points: DataFrame, most: int, keys: list[str] = FRAME, order: str = "row_idx") -> DataFrame:
    """At most `most` rows of each frame, evenly spread in order: places floor(k * (n - 1) / (most - 1)), the last included."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    rows = points.withColumn("_n", n).withColumn("_i", i)
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    k = F.ceil(F.col("_i") / step).cast("long")
    near = F.array(k - 1, k, k + 1)
    hit = F.exists(near, lambda j: (j >= 0) & (j < most - 1) & (F.floor(j * step) == F.col("_i")))
    return rows.where((F.col("_n") <= most) | hit | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i")


def rigid_rows(x: Column, y: Column, z: Column, a: list[Column], b: list[Column]) -> list[Column]:
    """Row-vector transform with two roundings: float(p * A), then float(that - b)."""
    return [f32(f32(x * a[k] + y * a[3 + k] + z * a[6 + k]).cast("double") - b[k]) for k in range(3)]


def time_lag(current_us: Column, source_us: Column) -> Column:
    return f32(current_us / F.lit(1e6) - source_us / F.lit(1e6))


def face_distances(x: Column, y: Column, z: Column) -> Column:
    """Distance to each of the six crop faces; not positive means outside."""
    faces = {"x_min": x + SIDE, "x_max": SIDE - x, "y_min": y + SIDE, "y_max": SIDE - y, "z_min": z - BOTTOM, "z_max": TOP - z}
    return F.array(*(F.struct(F.lit(k).alias("face"), v.cast("double").alias("distance")) for k, v in faces.items()))


def failed_faces(distances: Column) -> Column:
    return F.transform(F.filter(distances, lambda f: f["distance"] <= 0), lambda f: f["face"])


def map_labels(points: DataFrame, classes: dict[int, int], ignore: int = -1) -> DataFrame:
    """points with shared_label: the class of each label, `ignore` for unknown ones."""
    known = points.sparkSession.createDataFrame(sorted(classes.items()), "label int, shared_label int")
    return points.join(F.broadcast(known), "label", "left").withColumn("shared_label", F.coalesce("shared_label", F.lit(ignore)))


def coordinate_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    good = is_finite(*XYZ)
    return points.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.count_if(~good).alias("n_non_finite"),
        *(f(F.when(good, F.col(c))).cast("double").alias(f"{name}_{c}") for c in XYZ for name, f in (("min", F.min), ("max", F.max))),
    )


def count_statistics(counts: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    return counts.groupBy(*(keys or [])).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.median(column).alias("median"))


def label_histogram(points: DataFrame, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(keys or []), label).agg(F.count("*").alias("n"))


def mapping_coverage(mapped: DataFrame, keys: list[str] | None = None, ignore: int = -1) -> DataFrame:
    out = mapped.groupBy(*(keys or [])).agg(F.count("*").alias("total"), F.count_if(F.col("shared_label") == ignore).alias("ignored"))
    return out.withColumn("ignored_fraction", fraction(F.col("ignored"), F.col("total"), 0.0))


def grid_cells(points: DataFrame, size: float, keys: list[str] = FRAME) -> DataFrame:
    """points with patch_row and patch_col: floor((y - y0) / size) and floor((x - x0) / size) from the smallest coordinates, in double precision."""
    low = points.groupBy(*keys).agg(F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"))
    out = points.join(low, keys)
    return out.select(points["*"], F.floor((F.col("y").cast("double") - F.col("y0")) / size).cast("int").alias("patch_row"), F.floor((F.col("x").cast("double") - F.col("x0")) / size).cast("int").alias("patch_col"))


def grid_partition(points: DataFrame, size: float, keys: list[str] = FRAME) -> DataFrame:
    """Per tile: rows, columns, occupied and empty patches, points and the smallest and largest patch."""
    patches = grid_cells(points, size, keys).groupBy(*keys, "patch_row", "patch_col").agg(F.count("*").alias("n"))
    out = patches.groupBy(*keys).agg((F.max("patch_row") + 1).alias("rows"), (F.max("patch_col") + 1).alias("cols"), F.count("*").alias("occupied"), F.sum("n").alias("n_points"), F.min("n").alias("min_points"), F.max("n").alias("max_points"))
    return out.withColumn("empty", (F.col("rows") * F.col("cols") - F.col("occupied")).cast("long"))


def digests(points: DataFrame, columns: list[str], keys: list[str] = FRAME) -> DataFrame:
    """An order-insensitive digest per frame: the sum of row hashes, so that repeated rows don't cancel out, and the count."""
    return points.groupBy(*keys).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"))


def pillars_of(x: Column, y: Column, size: float, side: float = SIDE) -> tuple[Column, Column]:
    return cell(x, -side, size), cell(y, -side, size)
