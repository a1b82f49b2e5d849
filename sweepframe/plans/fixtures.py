"""LiDAR-shaped views over the star-schema tables, in Spark and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FRAME = ["drive_id", "frame_index"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """One row per point: drive_id, frame_index, row_idx, x, y, z, label."""
    li = table(spark, d, "lineitem")
    drive, frame = F.col("l_suppkey") % 4, F.col("l_orderkey") % 60
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return li.select(
        F.concat(F.lit("d"), drive.cast("string")).alias("drive_id"),
        frame.alias("frame_index"),
        (F.row_number().over(Window.partitionBy(drive, frame).orderBy(*order)) - 1).cast("long").alias("row_idx"),
        ((F.col("l_quantity") - 25.5) * 2.1 + F.col("l_discount") * 10.0).cast("float").alias("x"),
        (F.col("l_extendedprice") / 1000.0 - 51.0).cast("float").alias("y"),
        (F.round(F.col("l_tax") * 100.0, 0) - 5.0).cast("float").alias("z"),
        F.col("l_linenumber").cast("int").alias("label"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 4).cast("string")).alias("drive_id"), (F.col("l_orderkey") % 60).alias("frame_index")).distinct()
    return out.withColumn("ts_ns", F.lit(1700000000000000000) + F.col("frame_index") * 100000000 + (F.col("frame_index") % 7) * 1234567)


def poses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("frame_index").cast("double")
    return frames(spark, d).select(
        "*", (i * 0.8).alias("tx"), (i * 0.05 * i / 60.0).alias("ty"), (i * 0.01).alias("tz"), (i * 0.02).alias("yaw"),
        (F.lit(49.0) + i * 1e-5).alias("lat"), (F.lit(8.4) + i * 2e-5).alias("lon"), (F.lit(110.0) + i * 0.01).alias("alt"),
    )


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Car").when(F.col("c_mktsegment") == "AUTOMOBILE", "Pedestrian").when(F.col("c_mktsegment") == "MACHINERY", "Van").when(F.col("c_mktsegment") == "HOUSEHOLD", "Person (sitting)").otherwise("Truck")
    return table(spark, d, "customer").select(
        k.alias("track_id"), F.concat(F.lit("d"), (F.col("c_nationkey") % 4).cast("string")).alias("drive_id"), (k % 60).alias("frame_index"), kind.alias("object_type"),
        ((k * 7) % 41 - 20).cast("double").alias("cx"), ((k * 11) % 43).cast("double").alias("cy"), F.lit(4.0).alias("len"), F.lit(2.0).alias("wid"),
        (k % 4).cast("int").alias("occlusion"), (k % 3).cast("int").alias("truncation"), (1 + k % 2).cast("int").alias("state"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    g = ground_truth(spark, d).select("track_id", *FRAME, "object_type", "cx", "cy", "len", "wid")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(g, o["o_custkey"] == g["track_id"]).select(
        F.col("o_orderkey").alias("det_id"), *FRAME, "track_id", "object_type", (F.col("cx") + (F.col("o_orderkey") % 5) * 0.5).alias("cx"), (F.col("cy") + (F.col("o_orderkey") % 3) * 0.25).alias("cy"),
        "len", "wid", (F.col("o_totalprice") / 500000.0).alias("score"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Detections of a second backend: slightly moved, every 50th by a metre."""
    out = detections(spark, d)
    return out.withColumn("cx", F.col("cx") + F.when(F.col("det_id") % 50 == 0, 1.0).otherwise(0.01)).withColumn("score", F.col("score") - 0.002)


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select((F.col("user_id") % 8).alias("sensor"), F.col("event_id").alias("arrival_seq"), (us - F.when(F.col("event_id") % 37 == 0, F.lit(7200000000)).otherwise(F.lit(0))).alias("stamp_us"), us.alias("ts_us"), "event_type", "value", "user_id")


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("block"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("pstate"),
        (k * 10 + 1500).cast("double").alias("clocks_sm"), F.col("value").alias("power_draw"), (k % 10 != 0).alias("available"),
    )


def logits(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("anchor"), F.slice(e, 1, 10).alias("reference"), F.slice(e, 11, 10).alias("candidate"), F.slice(e, 21, 2).alias("dir_a"), F.slice(e, 23, 2).alias("dir_b"))


LOGIT_ROW = T.ArrayType(T.DoubleType())

POINTS = """points AS (SELECT 'd' || (l_suppkey % 4) AS drive_id, l_orderkey % 60 AS frame_index,
  row_number() OVER (PARTITION BY l_suppkey % 4, l_orderkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS row_idx,
  CAST((l_quantity - 25.5::DOUBLE) * 2.1::DOUBLE + l_discount * 10::DOUBLE AS FLOAT) AS x, CAST(l_extendedprice / 1000::DOUBLE - 51::DOUBLE AS FLOAT) AS y,
  CAST(round(l_tax * 100::DOUBLE, 0) - 5::DOUBLE AS FLOAT) AS z, CAST(l_linenumber AS INT) AS label FROM lineitem)"""
FRAMES = """frames AS (SELECT *, 1700000000000000000 + frame_index * 100000000 + (frame_index % 7) * 1234567 AS ts_ns
  FROM (SELECT DISTINCT 'd' || (l_suppkey % 4) AS drive_id, l_orderkey % 60 AS frame_index FROM lineitem))"""
POSES = f"""{FRAMES}, poses AS (SELECT *, i * 0.8::DOUBLE AS tx, i * 0.05::DOUBLE * i / 60::DOUBLE AS ty, i * 0.01::DOUBLE AS tz, i * 0.02::DOUBLE AS yaw,
  49::DOUBLE + i * 1e-5::DOUBLE AS lat, 8.4::DOUBLE + i * 2e-5::DOUBLE AS lon, 110::DOUBLE + i * 0.01::DOUBLE AS alt FROM (SELECT *, frame_index::DOUBLE AS i FROM frames))"""
GT = """gt AS (SELECT c_custkey AS track_id, 'd' || (c_nationkey % 4) AS drive_id, c_custkey % 60 AS frame_index,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Car' WHEN 'AUTOMOBILE' THEN 'Pedestrian' WHEN 'MACHINERY' THEN 'Van' WHEN 'HOUSEHOLD' THEN 'Person (sitting)' ELSE 'Truck' END AS object_type,
  CAST((c_custkey * 7) % 41 - 20 AS DOUBLE) AS cx, CAST((c_custkey * 11) % 43 AS DOUBLE) AS cy, 4::DOUBLE AS len, 2::DOUBLE AS wid,
  CAST(c_custkey % 4 AS INT) AS occlusion, CAST(c_custkey % 3 AS INT) AS truncation, CAST(1 + c_custkey % 2 AS INT) AS state FROM customer)"""
DET = f"""{GT}, det AS (SELECT o_orderkey AS det_id, drive_id, frame_index, track_id, object_type, cx + (o_orderkey % 5) * 0.5::DOUBLE AS cx, cy + (o_orderkey % 3) * 0.25::DOUBLE AS cy, len, wid,
  o_totalprice / 500000::DOUBLE AS score FROM orders JOIN gt ON o_custkey = track_id)"""
CAND = f"""{DET}, cand AS (SELECT * REPLACE (cx + CASE WHEN det_id % 50 = 0 THEN 1::DOUBLE ELSE 0.01::DOUBLE END AS cx, score - 0.002::DOUBLE AS score) FROM det)"""
MESSAGES = """msg AS (SELECT user_id % 8 AS sensor, event_id AS arrival_seq, epoch_us(ts) - CASE WHEN event_id % 37 = 0 THEN 7200000000 ELSE 0 END AS stamp_us, epoch_us(ts) AS ts_us, event_type, value, user_id FROM events)"""
TELEMETRY = """tel AS (SELECT event_id, epoch_us(ts) AS ts_us, event_type AS block, 'P' || (k % 3) AS pstate, CAST(k * 10 + 1500 AS DOUBLE) AS clocks_sm, value AS power_draw, k % 10 <> 0 AS available
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
LOGITS = """logits AS (SELECT vec_id AS anchor, CAST(embedding[1:10] AS DOUBLE[]) AS reference, CAST(embedding[11:20] AS DOUBLE[]) AS candidate, CAST(embedding[21:22] AS DOUBLE[]) AS dir_a, CAST(embedding[23:24] AS DOUBLE[]) AS dir_b FROM embeddings)"""
