"""Text and XML sources: timestamps, GPS/IMU rows, calibration, odometry, tracklets and telemetry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions.numeric import decimal_seconds_ns, parse_timestamp_ns

#: The first fields of a GPS/IMU row.
OXTS = ["lat", "lon", "alt", "roll", "pitch", "yaw"]
#: The fields of a telemetry row.
TELEMETRY = ["name", "driver_version", "pstate", "temperature", "power_draw", "power_limit", "clocks_sm", "clocks_mem", "utilization", "memory_used"]
TRACKLETS = """count INT, item ARRAY<STRUCT<objectType STRING, h DOUBLE, w DOUBLE, l DOUBLE, first_frame INT,
  poses STRUCT<count INT, item ARRAY<STRUCT<tx DOUBLE, ty DOUBLE, tz DOUBLE, rx DOUBLE, ry DOUBLE, rz DOUBLE, state INT, occlusion INT, truncation INT>>>>>"""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, lines numbered from 0 within each file (a file of a drive is small)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r?\n$", "").alias("value"))
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def timestamps(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("path", F.col("line").alias("frame_index"), parse_timestamp_ns(F.trim("value")).alias("ts_ns"))


def increasing(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_ok", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("increasing"))


def oxts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: six named values and all of them; fewer than six or a non-finite one fails the job."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), lambda x: x.cast("double")).alias("v"))
    good = (F.size("v") >= 6) & F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("v", F.when(good, F.col("v")).otherwise(F.raise_error(F.lit("a GPS/IMU row needs six finite values"))))
    return rows.select("path", *(F.col("v")[k].alias(n) for k, n in enumerate(OXTS)), F.col("v").alias("source_values"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(path, values map<string, array<double>>) of `key: floats` files, without the time line."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''").select("path", F.split("value", ":", 2).alias("kv")).where("kv[0] <> 'calib_time'")
    entry = F.struct(F.trim(F.col("kv")[0]).alias("key"), F.transform(F.split(F.trim(F.col("kv")[1]), r"\s+"), lambda x: x.try_cast("double")).alias("value"))
    return lines.groupBy("path").agg(F.map_from_entries(F.collect_list(entry)).alias("values"))


def odometry_poses(spark: SparkSession, path: str) -> DataFrame:
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = numbered_lines(spark, path).select("path", F.col("line").alias("frame_index"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.size("v") == 12, F.col("v")).otherwise(F.raise_error(F.lit("a pose needs twelve numbers"))))
    return rows.select("path", "frame_index", F.concat("v", F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))).alias("pose"))


def odometry_times(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("path", F.col("line").alias("frame_index"), decimal_seconds_ns(F.trim("value")).alias("ts_ns"))


def tracklets(spark: SparkSession, path: str) -> DataFrame:
    """One row per pose of each track; declared counts must fit."""
    root = spark.read.format("xml").option("rowTag", "tracklets").schema(TRACKLETS).load(path)
    tracks = root.where(F.when(F.col("count") == F.size("item"), True).otherwise(F.raise_error(F.lit("the tracklet count doesn't fit")))).select(F.posexplode("item").alias("track_id", "t"))
    fits = F.when(F.col("t.poses.count") == F.size("t.poses.item"), True).otherwise(F.raise_error(F.lit("a pose count doesn't fit")))
    poses = tracks.where(fits).select("track_id", "t", F.posexplode("t.poses.item").alias("k", "p"))
    return poses.select("track_id", F.col("t.objectType").alias("object_type"), "t.h", "t.w", "t.l", (F.col("t.first_frame") + F.col("k")).alias("frame_index"), "p.*")


def telemetry_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Unit-free comma-separated rows; N/A becomes null, another number of fields makes the row invalid."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    rows = lines.select(*lines.columns, parts.alias("_p"))
    cell = {n: F.when(F.size("_p") == len(TELEMETRY), F.nullif(F.get("_p", F.lit(k)), F.lit("N/A"))) for k, n in enumerate(TELEMETRY)}
    typed = {n: c if n in TELEMETRY[:3] else c.try_cast("double") for n, c in cell.items()}
    return rows.select(*lines.columns, (F.size("_p") == len(TELEMETRY)).alias("valid"), *(c.alias(n) for n, c in typed.items()))
