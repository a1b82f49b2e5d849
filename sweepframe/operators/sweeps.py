"""Current-plus-history sweeps, transforms between poses and model-ready points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.numeric import f32
from sweepframe.operators.points import in_crop, rigid_rows, time_lag, too_close


def history_index(frames: DataFrame, depth: int) -> DataFrame:
    """(drive_id, frame_index, history_rank, source_index): each frame with itself and up to `depth` frames before it, nearest first.

    Ranks are exploded and joined by equality, so no range join is needed.
    """
    asked = frames.select("drive_id", "frame_index", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("history_rank")).withColumn("source_index", F.col("frame_index") - F.col("history_rank"))
    there = frames.select("drive_id", F.col("frame_index").alias("source_index"))
    return asked.join(there, ["drive_id", "source_index"]).select("drive_id", "frame_index", "history_rank", "source_index")


def sweep_transforms(index: DataFrame, poses: DataFrame) -> DataFrame:
    """index with a (row-vector rotation, 9 floats) and b (3 floats) that bring source points into the current frame, for planar poses tx, ty, tz, yaw.

    A point p of the source lies at R(yaw_s) p + t_s in the world, so at R(yaw_c)^T (R(yaw_s) p + t_s - t_c) now; as row vectors p A - b.
    """
    cur = poses.select("drive_id", "frame_index", *(F.col(c).alias(f"c_{c}") for c in ("tx", "ty", "tz", "yaw")))
    src = poses.select("drive_id", F.col("frame_index").alias("source_index"), *(F.col(c).alias(f"s_{c}") for c in ("tx", "ty", "tz", "yaw")))
    both = index.join(cur, ["drive_id", "frame_index"]).join(src, ["drive_id", "source_index"])
    turn, dx, dy, dz = F.col("s_yaw") - F.col("c_yaw"), F.col("s_tx") - F.col("c_tx"), F.col("s_ty") - F.col("c_ty"), F.col("s_tz") - F.col("c_tz")
    c, s, z = F.cos(turn), F.sin(turn), F.lit(0.0)
    a = [c, s, z, -s, c, z, z, z, F.lit(1.0)]
    back = [F.cos("c_yaw") * dx + F.sin("c_yaw") * dy, F.cos("c_yaw") * dy - F.sin("c_yaw") * dx, dz]
    return both.select("drive_id", "frame_index", "history_rank", "source_index", F.array(*(f32(x) for x in a)).alias("a"), F.array(*(f32(-x) for x in back)).alias("b"))


def moves(transforms: DataFrame, stamps: DataFrame) -> DataFrame:
    """transforms with the times of both sweeps, cur_us and src_us. stamps: (drive_id, frame_index, ts_us)."""
    cur = stamps.select("drive_id", "frame_index", F.col("ts_us").alias("cur_us"))
    src = stamps.select("drive_id", F.col("frame_index").alias("source_index"), F.col("ts_us").alias("src_us"))
    return transforms.join(cur, ["drive_id", "frame_index"]).join(src, ["drive_id", "source_index"])


def model_points(points: DataFrame, transforms: DataFrame, stamps: DataFrame, radius: float = 1.0) -> DataFrame:
    """(drive_id, frame_index, history_rank, src_row_idx, x, y, z, time_lag): current and transformed history points inside the crop.

    History rows near the sensor are dropped before they are moved; the current sweep keeps its own. stamps: (drive_id, frame_index, ts_us).
    One join serves any smaller depth: keep history_rank <= n.
    """
    return moved_points(points, moves(transforms, stamps), radius)


def moved_points(points: DataFrame, index: DataFrame, radius: float = 1.0) -> DataFrame:
    """model_points of an index from `moves`.

    What is the same for all points of a sweep is worked out before the join, and a moved point once, as the only row of a generator: a filter on it stays
    above, and doesn't put the whole transform into the join's condition, whose code then is too long for the JVM to compile.
    """
    parts = [F.col(c)[i].cast("double").alias(f"{c}{i}") for c, n in (("a", 9), ("b", 3)) for i in range(n)]
    flat = index.select("drive_id", "frame_index", "history_rank", "source_index", time_lag(F.col("cur_us"), F.col("src_us")).alias("time_lag"), *parts)
    rows = points.withColumnRenamed("frame_index", "source_index").join(flat, ["drive_id", "source_index"])
    rows = rows.where((F.col("history_rank") == 0) | ~too_close(F.col("x"), F.col("y"), radius))
    moved = rigid_rows(*(F.col(k).cast("double") for k in "xyz"), [F.col(f"a{i}") for i in range(9)], [F.col(f"b{i}") for i in range(3)])
    here = F.col("history_rank") == 0
    place = F.struct(*(F.when(here, F.col(k)).otherwise(m).alias(k) for k, m in zip("xyz", moved, strict=True)))
    out = rows.select("drive_id", "frame_index", "history_rank", F.col("row_idx").alias("src_row_idx"), F.inline(F.array(place)), "time_lag")
    return out.where(in_crop(F.col("x"), F.col("y"), F.col("z")))


def membership_difference(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Per keys: rows that only one of two versions keeps."""
    both = a.select(*on).withColumn("_a", F.lit(1)).join(b.select(*on).withColumn("_b", F.lit(1)), on, "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def input_ledger(points: DataFrame) -> DataFrame:
    """Per frame what a ledger records of its model points: how many, how many lags, the source frames, and a digest that doesn't depend on order."""
    content = F.xxhash64("history_rank", "src_row_idx", "x", "y", "z", "time_lag").cast("decimal(38,0)")
    own = points.groupBy("drive_id", "frame_index").agg(F.count("*").alias("points"), F.countDistinct("time_lag").alias("lags"), F.sort_array(F.collect_set(F.col("frame_index") - F.col("history_rank"))).alias("sources"), F.sum(content).alias("digest"))
    return own.withColumn("digest", F.col("digest").cast("decimal(38,0)"))


def ledger_mismatches(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """(drive_id, frame_index, reason) of frames that differ from the record; none means that the inputs are verified."""
    names = ["points", "lags", "sources", "digest"]
    a, r = (df.select("drive_id", "frame_index", F.struct(*names).alias(n)) for df, n in ((actual, "a"), (recorded, "r")))
    both = a.join(r, ["drive_id", "frame_index"], "full")
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"r.{n}")), F.lit(n)) for n in names))), ",")
    reason = F.when(F.col("r").isNull(), "unrecorded").when(F.col("a").isNull(), "absent").otherwise(differs)
    return both.select("drive_id", "frame_index", reason.alias("reason")).where("reason <> ''")
