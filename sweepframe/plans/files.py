"""Queries on sources and sinks: the given tables are written as scans, tiles, messages, text and XML below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe.operators import points as PT
from sweepframe.plans.fixtures import FRAME, GT, MESSAGES, POINTS, POSES, ground_truth, messages, points, poses
from sweepframe.plans.sensors import GAP, TWIN
from sweepframe.registry import query
from sweepframe.sources import binary, manifests, ranges, sinks, text
from sweepframe.sources.scratch import scratch_folder
from sweepframe.streaming import history as H

FR = "drive_id, frame_index"


def keyed(df):
    """drive_id and frame_index of files named <drive_id>/<frame_index>.<suffix>."""
    return df.withColumns({"drive_id": F.regexp_extract("path", r"/(d\d+)/\d+\.\w+$", 1), "frame_index": F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long")})


def scans(s, d):
    path = scratch_folder(s, "scans")
    sinks.write_scans(points(s, d).withColumn("remission", F.col("label").cast("float")), path)
    return path


@query("src_1_scan_files", f"WITH {POINTS} SELECT {FR}, count(*) AS n, min(x)::DOUBLE AS min_x, max(y)::DOUBLE AS max_y, CAST(sum(row_idx * label) AS BIGINT) AS ordered FROM points GROUP BY ALL")
def src_1(s, d):
    p = keyed(binary.read_points(s, scans(s, d)))
    return p.groupBy(*FRAME).agg(F.count("*").alias("n"), F.min("x").cast("double").alias("min_x"), F.max("y").cast("double").alias("max_y"), F.sum((F.col("row_idx") * F.col("remission")).cast("long")).alias("ordered"))


@query("src_2_strict_scans", f"WITH {POINTS} SELECT drive_id, count(DISTINCT frame_index) AS files, count(*) AS n, max(z)::DOUBLE AS max_z FROM points GROUP BY ALL")
def src_2(s, d):
    return keyed(binary.read_points(s, scans(s, d), strict=True)).groupBy("drive_id").agg(F.countDistinct("frame_index").alias("files"), F.count("*").alias("n"), F.max("z").cast("double").alias("max_z"))


@query("src_3_scan_fields", f"WITH {POINTS} SELECT {FR}, count(*) AS n, max(x)::DOUBLE AS a, CAST(max(label) AS INT) AS b FROM points GROUP BY ALL")
def src_3(s, d):
    path = scratch_folder(s, "fields")
    sinks.write_scans(points(s, d).withColumn("kind", F.col("label").cast("float")), path, ("kind", "x"))
    return keyed(binary.read_points(s, path, ("kind", "x"))).groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("x").cast("double").alias("a"), F.max("kind").cast("int").alias("b"))


@query("src_5_las_tiles", f"WITH {POINTS} SELECT {FR}, count(*) AS n, round(sum(round(x::DOUBLE, 3)), 2) AS x, round(min(round(y::DOUBLE, 3)), 3) AS y, CAST(sum(label) AS BIGINT) AS classes FROM points GROUP BY ALL")
def src_5(s, d):
    path = scratch_folder(s, "tiles")
    sinks.write_tiles(points(s, d), path)
    return keyed(binary.read_las(s, path)).groupBy(*FRAME).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"), F.round(F.min("y"), 3).alias("y"), F.sum("classification").alias("classes"))


@query("src_8_tile_discovery", f"WITH {POINTS} SELECT row_number() OVER (ORDER BY frame_index) AS place, 'd1/' || lpad(frame_index::VARCHAR, 10, '0') || '.las' AS rel_path, true AS readable FROM (SELECT DISTINCT frame_index FROM points WHERE drive_id = 'd1')")
def src_8(s, d):
    path = scratch_folder(s, "tiles")
    sinks.write_tiles(points(s, d), path)
    return manifests.tiles(s, path, "d1").select("place", "rel_path", "readable")


def texts(s, rows, name, suffix):
    """rows (drive_id, frame_index, value) as text files."""
    path = scratch_folder(s, name)
    sinks.write_files(rows.withColumn("data", F.col("value").cast("binary")), path, suffix)
    return f"{path}/*/*{suffix}"


@query("src_11_gps_rows", f"WITH {POSES} SELECT {FR}, lat, lon, alt, 0::DOUBLE AS roll, yaw, 8 AS fields FROM poses")
def src_11(s, d):
    value = F.concat_ws(" ", "lat", "lon", "alt", F.lit("0 0"), "yaw", F.lit("7 8.5"))
    rows = text.oxts(s, texts(s, poses(s, d).select(*FRAME, value.alias("value")), "oxts", ".txt"))
    return keyed(rows).select(*FRAME, "lat", "lon", "alt", "roll", "yaw", F.size("source_values").alias("fields"))


@query("src_12_calibration_files", f"WITH {POSES} SELECT drive_id, max(tx) AS t0, max(ty) AS t1, max(yaw) AS r0, 2 AS keys FROM poses GROUP BY drive_id")
def src_12(s, d):
    p = poses(s, d).groupBy("drive_id").agg(F.max("tx").alias("tx"), F.max("ty").alias("ty"), F.max("yaw").alias("yaw"))
    value = F.concat(F.lit("calib_time: 09-Jan-2012 13:57:47\nR: "), F.concat_ws(" ", "yaw", F.lit("0 0")), F.lit("\nT: "), F.concat_ws(" ", "tx", "ty", F.lit("1.5")), F.lit("\n"))
    rows = keyed(text.calibration(s, texts(s, p.select("drive_id", F.lit(0).cast("long").alias("frame_index"), value.alias("value")), "calibration", ".txt")))
    return rows.select("drive_id", F.col("values")["T"][0].alias("t0"), F.col("values")["T"][1].alias("t1"), F.col("values")["R"][0].alias("r0"), F.size("values").alias("keys"))


@query("src_13_odometry_files", f"WITH {POSES} SELECT drive_id, row_number() OVER (PARTITION BY drive_id ORDER BY frame_index) - 1 AS line, tx AS x, ty AS y, tz AS z, 1::DOUBLE AS corner FROM poses")
def src_13(s, d):
    line = F.concat_ws(" ", F.lit("1 0 0"), "tx", F.lit("0 1 0"), "ty", F.lit("0 0 1"), "tz")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", line.alias("v")))), lambda r: r["v"]), "\n")
    rows = poses(s, d).groupBy("drive_id").agg(lines.alias("value")).withColumn("frame_index", F.lit(0).cast("long"))
    out = text.odometry_poses(s, texts(s, rows, "odometry", ".txt"))
    out = out.withColumn("drive_id", F.regexp_extract("path", r"/(d\d+)/\d+\.\w+$", 1))
    return out.select("drive_id", F.col("frame_index").cast("long").alias("line"), F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"), F.col("pose")[11].alias("z"), F.col("pose")[15].alias("corner"))


@query("src_15_tracklet_files", f"WITH {GT} SELECT frame_index, object_type, state, occlusion, count(*) AS n, round(sum(cx), 6) AS x, max(len) AS l FROM gt GROUP BY ALL")
def src_15(s, d):
    tags = [("tx", "cx"), ("ty", "cy"), ("tz", None), ("rx", None), ("ry", None), ("rz", None), ("state", "state"), ("occlusion", "occlusion"), ("truncation", "truncation")]

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    pose = tag("item", F.concat(*(tag(n, F.col(c).cast("string") if c else F.lit("0")) for n, c in tags)))
    item = tag("item", F.concat(tag("objectType", F.col("object_type")), tag("h", F.lit("1.5")), tag("w", F.col("wid").cast("string")), tag("l", F.col("len").cast("string")), tag("first_frame", F.col("frame_index").cast("string")), tag("poses", F.concat(tag("count", F.lit("1")), pose))))
    rows = ground_truth(s, d).groupBy("drive_id").agg(F.count("*").cast("string").alias("n"), F.array_join(F.collect_list(item), "").alias("items"))
    value = tag("root", tag("tracklets", F.concat(tag("count", F.col("n")), F.col("items"))))
    out = text.tracklets(s, texts(s, rows.select("drive_id", F.lit(0).cast("long").alias("frame_index"), value.alias("value")), "tracklets", ".xml"))
    return out.groupBy(F.col("frame_index").cast("long").alias("frame_index"), "object_type", "state", "occlusion").agg(F.count("*").alias("n"), F.round(F.sum("tx"), 6).alias("x"), F.max("l").alias("l"))


def clouds(s, d, broken):
    p = points(s, d).withColumn("time_lag", F.lit(0.0).cast("float"))
    p = p.withColumn("x", F.when(F.col("row_idx") % 50 == 3, F.lit(float("nan"))).otherwise(F.col("x")).cast("float")) if broken else p
    return sinks.payloads(p, FRAME)


@query("src_16_message_points", f"WITH {POINTS} SELECT {FR}, count(*) AS received, count(*) FILTER (row_idx % 50 <> 3) AS valid, max(y) FILTER (row_idx % 50 <> 3)::DOUBLE AS y FROM points GROUP BY ALL")
def src_16(s, d):
    m = clouds(s, d, True)
    valid = binary.decode_messages(m, FRAME).groupBy(*FRAME).agg(F.count("*").alias("valid"), F.max("y").cast("double").alias("y"))
    return m.select(*FRAME, F.col("width").cast("long").alias("received")).join(valid, FRAME, "left")


@query("src_17_strict_messages", f"WITH {POINTS} SELECT {FR}, count(*) AS n, min(z)::DOUBLE AS z FROM points GROUP BY ALL")
def src_17(s, d):
    return binary.decode_messages(clouds(s, d, False), FRAME, on_non_finite="raise").groupBy(*FRAME).agg(F.count("*").alias("n"), F.min("z").cast("double").alias("z"))


@query("snk_2_payloads", f"WITH {POINTS} SELECT {FR}, 1 AS height, CAST(count(*) AS INT) AS width, 16 AS point_step, CAST(16 * count(*) AS INT) AS row_step, CAST(16 * count(*) AS INT) AS n_bytes, CAST(NULL AS VARCHAR) AS problem FROM points GROUP BY ALL")
def snk_2(s, d):
    return binary.layout_problem(clouds(s, d, False)).select(*FRAME, "height", "width", "point_step", "row_step", F.octet_length("data").alias("n_bytes"), "problem")


@query("snk_1_scan_writer", f"WITH {POINTS} SELECT {FR}, 16 * count(*) AS length FROM points GROUP BY ALL")
def snk_1(s, d):
    return keyed(manifests.listing(s, scans(s, d), "*.bin")).select(*FRAME, "length")


@query("src_20_replayed_history", f"WITH {TWIN} SELECT sensor, arrival_seq, reset, depth FROM twin")
def src_20(s, d):
    """The stored messages replayed as a stream of four files, oldest first, through the stateful history."""
    path = scratch_folder(s, "replay")
    m = messages(s, d).select("sensor", "arrival_seq", "stamp_us")
    m.repartitionByRange(4, "arrival_seq").sortWithinPartitions("arrival_seq").write.parquet(f"{path}/in")
    stream = H.stream_history(H.replay(s, f"{path}/in", m.schema, 64), 10, GAP)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return s.read.parquet(f"{path}/out").select("sensor", "arrival_seq", "reset", "depth")


@query("stm_1_history_members", f"WITH {TWIN}, k AS (SELECT t.*, (SELECT list(h.arrival_seq ORDER BY h.arrival_seq DESC) FROM (SELECT arrival_seq, row_number() OVER (PARTITION BY sensor ORDER BY arrival_seq) AS r, sensor FROM msg) h WHERE h.sensor = t.sensor AND h.r BETWEEN t.r - t.depth AND t.r - 1) AS kept FROM (SELECT twin.*, row_number() OVER (PARTITION BY sensor ORDER BY arrival_seq) AS r FROM twin) t) SELECT sensor, arrival_seq, coalesce(array_to_string(kept, ','), '') AS history FROM k")
def stm_1_members(s, d):
    """The kept sweeps of each arriving one, nearest first."""
    return H.batch_members(messages(s, d), 10, GAP).select("sensor", "arrival_seq", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("stm_4_6_counters", f"""WITH {MESSAGES}, v AS (SELECT *, event_type = 'error' AND arrival_seq % 3 = 0 AS invalid, arrival_seq % 11 = 5 AS lost FROM msg), r AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY arrival_seq) AS k FROM v WHERE NOT invalid),
x AS (SELECT *, CASE WHEN stamp_us <= p THEN 'time_regression' WHEN stamp_us - p > {GAP} THEN 'gap' END AS reset FROM (SELECT *, lag(stamp_us) OVER (PARTITION BY sensor ORDER BY arrival_seq) AS p FROM r)),
g AS (SELECT *, count(reset) OVER (PARTITION BY sensor ORDER BY arrival_seq) AS session FROM x), y AS (SELECT *, least(10, row_number() OVER (PARTITION BY sensor, session ORDER BY arrival_seq) - 1) AS depth FROM g),
a AS (SELECT sensor, count(*) AS received, count(*) FILTER (invalid) AS rejected_invalid, CAST(sum(CASE WHEN invalid THEN 0 ELSE arrival_seq % 7 END) AS BIGINT) AS filtered_points FROM v GROUP BY sensor),
b AS (SELECT sensor, count(*) FILTER (lost) AS transform_failures, count(*) FILTER (NOT lost) AS published, count(reset) AS resets, CAST(arg_max(depth, arrival_seq) AS INT) AS depth FROM y GROUP BY sensor) SELECT * FROM a JOIN b USING (sensor)""")
def stm_4(s, d):
    """Messages without a valid point are rejected before they enter the history; a missing transform rejects the output only, and the sweep stays."""
    m = messages(s, d).withColumns({"n_points": F.when((F.col("event_type") == "error") & (F.col("arrival_seq") % 3 == 0), 0).otherwise(100), "n_filtered": F.col("arrival_seq") % 7, "transform": F.col("arrival_seq") % 11 != 5})
    return H.counters(m, 10, GAP)


@query("snk_5_audit_report", f"WITH {POINTS} SELECT drive_id, count(*) AS n_points, max(x)::DOUBLE AS max_x, count(*) FILTER (label = 5) AS ignored FROM points GROUP BY drive_id")
def snk_5(s, d):
    """The audit's JSON lines, written and read back."""
    return audited(s, d)


@query("snk_7_audit_command", f"WITH {POINTS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY drive_id ORDER BY frame_index) AS k FROM points WHERE label < 6) SELECT drive_id, count(*) AS n_points, max(x)::DOUBLE AS max_x, count(*) FILTER (label = 5) AS ignored FROM k WHERE k <= 30 GROUP BY drive_id")
def snk_7(s, d):
    """The command's split and bound on samples, which are its features."""
    return audited(s, d, "--split", "train", "--max-samples", "30")


def audited(s, d, *more):
    from sweepframe.jobs import audit

    path = scratch_folder(s, "audit")
    points(s, d).withColumn("split", F.when(F.col("label") < 6, "train").otherwise("test")).write.parquet(f"{path}/points")
    audit.main(["--points", f"{path}/points", "--out", f"{path}/report", *more])
    lines = s.read.text(f"{path}/report")
    return lines.select(F.from_json("value", "drive_id string, n_points long, max_x double, ignored long").alias("r")).select("r.*")


@query("src_6_tile_attributes", f"WITH {POINTS} SELECT {FR}, CAST(label AS INT) AS classification, count(*) AS n, 0::DOUBLE AS gps_time, CAST(sum(row_idx) AS BIGINT) AS rows FROM points GROUP BY ALL")
def src_6(s, d):
    path = scratch_folder(s, "tiles")
    sinks.write_tiles(points(s, d), path)
    p = keyed(binary.read_las(s, path, fields=("classification", "gps_time")))
    return p.groupBy(*FRAME, "classification").agg(F.count("*").alias("n"), F.max("gps_time").alias("gps_time"), F.sum("row_idx").alias("rows"))


@query("src_6_tile_ranges", f"WITH {POINTS} SELECT {FR}, CAST(label AS INT) AS classification, count(*) AS n, 0::DOUBLE AS gps_time, CAST(sum(row_idx) AS BIGINT) AS rows FROM points GROUP BY ALL")
def src_6_ranges(s, d):
    """Tiles in ranges of 2 KB, so that each gives several tasks; only two fields are decoded."""
    path = scratch_folder(s, "tiles")
    sinks.write_tiles(points(s, d), path)
    p = ranges.read_ranges(s, path, ("classification", "gps_time"), range_bytes=2 << 10)
    return p.groupBy(*FRAME, "classification").agg(F.count("*").alias("n"), F.max("gps_time").alias("gps_time"), F.sum("row_idx").alias("rows"))


@query("src_7_pruned_scans", f"WITH {POINTS} SELECT {FR}, count(*) AS n, min(x)::DOUBLE AS min_x, CAST(sum(row_idx * label) AS BIGINT) AS ordered FROM points WHERE drive_id = 'd1' AND frame_index >= 20 AND frame_index < 40 GROUP BY ALL")
def src_7_pruned(s, d):
    """The scans of one split of one drive: both predicates decide which files are opened."""
    p = ranges.read_ranges(s, scans(s, d), ("x", "y", "z", "remission"), "float").where("drive_id = 'd1' and frame_index >= 20 and frame_index < 40")
    return p.groupBy(*FRAME).agg(F.count("*").alias("n"), F.min("x").cast("double").alias("min_x"), F.sum((F.col("row_idx") * F.col("remission")).cast("long")).alias("ordered"))
