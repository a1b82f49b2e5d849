"""Pillars and voxels with first-touch order and capacities. A total order of a frame's rows is (history_rank, row_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions.numeric import cell

FRAME = ["drive_id", "frame_index"]


def order_of(rank: str = "history_rank", row: str = "row_idx") -> Column:
    return F.struct(F.col(rank), F.col(row))


def with_pillars(points: DataFrame, size: float = 0.25, side: float = 50.0) -> DataFrame:
    """Points inside the grid with their cells cx, cy."""
    n = int(round(2 * side / size))
    out = points.withColumn("cx", cell(F.col("x"), -side, size)).withColumn("cy", cell(F.col("y"), -side, size))
    return out.where((F.col("cx") >= 0) & (F.col("cx") < n) & (F.col("cy") >= 0) & (F.col("cy") < n))


def first_touch(points: DataFrame, capacity: int, size: float = 0.25, keys: list[str] = FRAME) -> DataFrame:
    """One row per pillar: points, first row, sweep of first touch, rank of first touch and whether the capacity keeps it.

    The first row of a cell is a pre-aggregated minimum, so only one row per cell is ranked within its frame.
    """
    cells = with_pillars(points, size).groupBy(*keys, "cx", "cy").agg(F.min(order_of()).alias("first"), F.count("*").alias("n_points"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    out = cells.withColumn("touch_rank", rank - 1)
    return out.select(*keys, "cx", "cy", "n_points", F.col("first.row_idx").alias("first_row"), F.col("first.history_rank").alias("first_sweep"), "touch_rank", (F.col("touch_rank") < capacity).alias("retained"))


def pillar_summary(pillars: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    kept = F.col("retained")
    out = pillars.groupBy(*keys).agg(F.sum("n_points").alias("in_range_points"), F.count("*").alias("candidates"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("discarded"))
    return out.withColumn("overflow_fraction", F.col("discarded") / F.col("candidates"))


def first_touch_histogram(pillars: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    return pillars.groupBy(*keys, "first_sweep").agg(F.count("*").alias("candidates"), F.count_if(F.col("retained")).alias("retained"), F.count_if(~F.col("retained")).alias("discarded"))


def hard_voxels(points: DataFrame, size: tuple[float, float, float], max_points: int, max_voxels: int, low: tuple[float, float, float] = (-50, -50, -5), high: tuple[float, float, float] = (50, 50, 3), keys: list[str] = FRAME) -> DataFrame:
    """The kept rows of each kept voxel: cz, cy, cx, voxel_rank (by first row), slot (row order), num_points (clamped).

    Slots are ranked within a voxel; voxels are ranked from one pre-aggregated row each and joined back.
    """
    inside = points
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside.where((F.col(c) >= a) & (F.col(c) < b))
    placed = inside.withColumns({f"c{c}": cell(F.col(c), a, s) for c, a, s in zip("xyz", low, size, strict=True)})
    where = [*keys, "cz", "cy", "cx"]
    slots = placed.withColumn("slot", F.row_number().over(Window.partitionBy(*where).orderBy(order_of())) - 1).where(F.col("slot") < max_points)
    voxels = placed.groupBy(*where).agg(F.min(order_of()).alias("first"), F.count("*").alias("n"))
    voxels = voxels.withColumn("voxel_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).where(F.col("voxel_rank") < max_voxels)
    return slots.join(voxels.select(*where, "voxel_rank", F.least("n", F.lit(max_points)).alias("num_points"), F.col("n").alias("all_points")), where)


def sweep_indices(points: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Number of each distinct time lag of a frame by its first appearance."""
    first = points.groupBy(*keys, "time_lag").agg(F.min(order_of()).alias("first"))
    return first.withColumn("sweep_index", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).drop("first")


def centre(index: Column, size: float, side: float = 50.0) -> Column:
    return (index + 0.5) * size - side


def homogeneity(counts: DataFrame, keys: list[str], candidates: str = "candidates", discarded: str = "discarded", critical: float = 24.72497, least: float = 5.0) -> DataFrame:
    """Pearson statistic of discarded counts against shares of candidates; null where an expected count is too small."""
    totals = counts.groupBy(*keys).agg(F.sum(candidates).alias("_c"), F.sum(discarded).alias("_d"))
    e = F.col("_d") * F.col(candidates) / F.col("_c")
    out = counts.join(totals, keys).withColumn("_e", e).groupBy(*keys).agg(F.min("_e").alias("min_expected"), F.sum(F.try_divide((F.col(discarded) - F.col("_e")) * (F.col(discarded) - F.col("_e")), F.col("_e"))).alias("_s"))
    adequate = F.col("min_expected") >= least
    return out.select(*keys, adequate.alias("adequate"), F.when(adequate, F.col("_s")).alias("statistic"), F.when(adequate, F.col("_s") > critical).alias("reject"))
