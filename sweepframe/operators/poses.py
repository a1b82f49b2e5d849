"""As-of joins on timestamps, interpolation and pose errors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G


def bracket(targets: DataFrame, records: DataFrame, keys: list[str], ts: str, values: list[str], bucket_us: int | None = None) -> DataFrame:
    """targets with prev_* (strictly earlier) and next_* (at or after) of records: ts and values, and nearest_ts (a tie goes to the earlier).

    Both sides are put into one order and carried forward, and into the reverse order and carried again, without a range join; either frame grows row by
    row, so the work is linear. With bucket_us (in units of ts) the order is cut into time buckets, and the last and first record of each bucket are carried
    over from one row per bucket, so that a long stream is no single task.
    """
    side = [F.col(c) for c in [*keys, ts]]
    kept = [c for c in targets.columns if c not in (*keys, ts)]
    record = F.struct(F.col(ts).alias("ts"), *values)
    t = targets.select(*side, F.lit(0).alias("_kind"), F.struct(*kept).alias("_row"), F.lit(None).cast(records.select(record).schema[0].dataType).alias("_rec"))
    r = records.select(*side, F.lit(1).alias("_kind"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"), record.alias("_rec"))
    both = t.unionByName(r)
    part = list(keys)
    if bucket_us:
        both = both.withColumn("_bucket", F.floor(F.col(ts) / bucket_us))
        part.append("_bucket")
    # Targets stand before records of the same time: those are "at or after".
    before = Window.partitionBy(*part).orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*part).orderBy(F.desc(ts), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_prev", F.last("_rec", ignorenulls=True).over(before)).withColumn("_next", F.last("_rec", ignorenulls=True).over(after))
    out = both.where("_kind = 0")
    if bucket_us:
        edges = both.where("_kind = 1").groupBy(*keys, "_bucket").agg(F.max("_rec").alias("_last"), F.min("_rec").alias("_first"))
        every = both.select(*keys, "_bucket").distinct().join(edges, [*keys, "_bucket"], "left")
        b = Window.partitionBy(*keys).orderBy("_bucket")
        every = every.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(b.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
        out = out.join(every, [*keys, "_bucket"]).withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    near = F.when(F.col("_next").isNull() | (F.col(ts) - F.col("_prev.ts") <= F.col("_next.ts") - F.col(ts)), F.col("_prev.ts")).otherwise(F.col("_next.ts"))
    return out.select(*keys, ts, "_row.*", *(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in ("prev", "next") for c in ("ts", *values)), near.alias("nearest_ts"))


def interpolated(ts: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear between two records; null outside the coverage."""
    share = F.try_divide((ts - t0).cast("double"), (t1 - t0).cast("double"))
    return v0 + share * (v1 - v0)


PLACE, TURN = ["tx", "ty", "tz"], ["qw", "qx", "qy", "qz"]


def pose_of(place: list[Column], turn: list[Column]) -> Column:
    """The 4x4 transform of a translation and a quaternion (w, x, y, z)."""
    return G.rigid(G.quaternion_entries(*turn), place)


def pose_variants(targets: DataFrame, records: DataFrame, keys: list[str], ts: str, bucket: int) -> DataFrame:
    """targets with their pose by records (keys, ts, tx, ty, tz, qw, qx, qy, qz) in four ways, each a 4x4 transform or null: synchronised (a record of that
    time), previous, nearest (a tie goes to the earlier) and interpolated (translation linear, rotation spherical; null outside the records' time)."""
    out = bracket(targets, records, keys, ts, PLACE + TURN, bucket)
    sides = {k: ([F.col(f"{k}_{c}") for c in PLACE], [F.col(f"{k}_{c}") for c in TURN]) for k in ("prev", "next")}
    share = F.try_divide((F.col(ts) - F.col("prev_ts")).cast("double"), (F.col("next_ts") - F.col("prev_ts")).cast("double"))
    out = out.withColumn("_share", share).withColumn("_turn", F.array(*G.slerp(sides["prev"][1], sides["next"][1], F.col("_share"))))
    between = pose_of([a + F.col("_share") * (b - a) for a, b in zip(sides["prev"][0], sides["next"][0], strict=True)], [F.col("_turn")[k] for k in range(4)])
    before, after, hit = (F.when(F.col(f"{k}_ts").isNotNull(), pose_of(*sides[k])) for k in ("prev", "next", "next"))
    same = F.col("next_ts") == F.col(ts)
    kept = targets.columns
    out = out.select(*kept, F.when(same, hit).alias("synchronised"), before.alias("previous"), F.when(F.col("nearest_ts") == F.col("next_ts"), after).otherwise(before).alias("nearest"), between.alias("_between"))
    return out.select(*kept, "synchronised", "previous", "nearest", F.when(F.col("synchronised").isNotNull(), F.col("synchronised")).when(F.col("_between")[0].isNotNull(), F.col("_between")).alias("interpolated"))


def looked_up(targets: DataFrame, edges: list[DataFrame], keys: list[str], ts: str, bucket: int) -> DataFrame:
    """targets with `pose`: the product of all edges' interpolated transforms at ts, from the fixed frame outwards; null where one isn't known then."""
    out = targets
    for k, edge in enumerate(edges):
        found = pose_variants(out, edge, keys, ts, bucket).drop("synchronised", "previous", "nearest").withColumnRenamed("interpolated", "_edge")
        both = F.when(F.col("pose").isNotNull() & F.col("_edge").isNotNull(), G.compose(F.col("pose"), F.col("_edge"))) if k else F.col("_edge")
        out = found.withColumn("pose", both).drop("_edge")
    return out


def history_transforms(index: DataFrame, stamps: DataFrame, edges: list[DataFrame], bucket: int) -> DataFrame:
    """index (drive_id, frame_index, history_rank, source_index) with `relative`, which brings points of the source at its time into the current frame at the
    current time through the fixed frame, and `accepted`: false for all rows of a frame of which any transform is missing. Nothing else is put in its place.

    stamps has (drive_id, frame_index, ts_ns). Poses are looked up once per frame, not per pair.
    """
    poses = looked_up(stamps, edges, ["drive_id"], "ts_ns", bucket).select("drive_id", "frame_index", "pose")
    cur = poses.withColumnRenamed("pose", "_cur")
    src = poses.select("drive_id", F.col("frame_index").alias("source_index"), F.col("pose").alias("_src"))
    both = index.join(cur, ["drive_id", "frame_index"]).join(src, ["drive_id", "source_index"])
    both = both.withColumn("relative", F.when(F.col("_cur").isNotNull() & F.col("_src").isNotNull(), G.compose(G.inverse_entries(F.col("_cur")), F.col("_src"))))
    whole = Window.partitionBy("drive_id", "frame_index")
    return both.withColumn("accepted", F.bool_and(F.col("relative").isNotNull()).over(whole)).drop("_cur", "_src")


def pose_errors(df: DataFrame, candidate: str, oracle: str) -> DataFrame:
    """df with ex, ey, ez, norm (of the translation), angle (of the rotation between) and largest (absolute difference of matrix elements)."""
    a, b = F.col(candidate), F.col(oracle)
    e = {n: a[k] - b[k] for n, k in (("ex", 3), ("ey", 7), ("ez", 11))}
    df = df.withColumn("_between", G.compose(G.inverse_entries(b), a)).withColumns(e | {"angle": G.rotation_angle(F.col("_between")), "largest": F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))})
    return df.drop("_between").withColumn("norm", F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2 + F.col("ez") ** 2))


def relative_poses(df: DataFrame, keys: list[str], index: str, columns: list[str], deltas: list[int]) -> DataFrame:
    """df per delta with each 4x4 column as seen from the pose `delta` indices before; rows without such a pose are left out. One window serves all deltas."""
    w = Window.partitionBy(*keys).orderBy(index)
    before = F.array(*(F.struct(F.lit(k).alias("delta"), F.lag(index, k).over(w).alias("at"), *(F.lag(c, k).over(w).alias(c) for c in columns)) for k in deltas))
    out = df.withColumn("_all", before).withColumn("_before", F.explode("_all")).where((F.col(index) - F.col("_before.at") == F.col("_before.delta")) & F.col(f"_before.{columns[0]}").isNotNull())
    return out.select(*(c for c in df.columns if c not in columns), "_before.delta", *(G.compose(G.inverse_entries(F.col(f"_before.{c}")), F.col(c)).alias(c) for c in columns))


def mercator(lat: Column, lon: Column, scale: Column) -> tuple[Column, Column]:
    """Metres east and north of a place, for a scale that is the cosine of the first latitude."""
    radius = F.lit(6378137.0)
    return scale * radius * F.radians(lon), scale * radius * F.log(F.tan(F.radians(F.lit(90.0) + lat) / 2))


def normalised_poses(records: DataFrame) -> DataFrame:
    """records (drive_id, frame_index, lat, lon, alt, yaw) with x, y, z seen from the drive's first frame."""
    first = records.groupBy("drive_id").agg(F.min_by(F.struct("lat", "lon", "alt", "yaw"), "frame_index").alias("f"))
    out = records.join(first, "drive_id").withColumn("_scale", F.cos(F.radians("f.lat")))
    x, y = mercator(F.col("lat"), F.col("lon"), F.col("_scale"))
    x0, y0 = mercator(F.col("f.lat"), F.col("f.lon"), F.col("_scale"))
    dx, dy, c, s = x - x0, y - y0, F.cos("f.yaw"), F.sin("f.yaw")
    return out.select(*records.columns, (c * dx + s * dy).alias("x"), (c * dy - s * dx).alias("y"), (F.col("alt") - F.col("f.alt")).alias("z"))


def previous_walk(spark: SparkSession, records: DataFrame, depth: int) -> DataFrame:
    """(id, rank, previous): up to `depth` records before each, nearest first, by following the pointer `prev` of records (id, prev).

    A recursive query of so many joins at most. A walk ends at a record without a pointer, at one that isn't there, and before one that it has met.
    """
    # The default bound on a recursion's rows is for runaway ones; here the depth is bounded.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    view = f"records_{uuid.uuid4().hex}"
    records.select("id", "prev").createOrReplaceTempView(view)
    return spark.sql(f"""WITH RECURSIVE walk(id, rank, previous, next, met) MAX RECURSION LEVEL {depth + 1} AS (
      SELECT a.id, 1, b.id, b.prev, array(a.id, b.id) FROM {view} a JOIN {view} b ON a.prev = b.id WHERE a.id <> b.id
      UNION ALL SELECT w.id, rank + 1, b.id, b.prev, array_append(met, b.id) FROM walk w JOIN {view} b ON w.next = b.id WHERE rank < {depth} AND NOT array_contains(met, b.id))
    SELECT id, rank, previous FROM walk""")
