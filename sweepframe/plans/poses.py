"""Queries on timestamps, as-of joins and poses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G
from sweepframe.functions.numeric import acquisition_id, decimal_seconds_ns, ns_to_us, parse_timestamp_ns, stamp_ns
from sweepframe.operators.poses import bracket, normalised_poses, previous_walk
from sweepframe.operators.selection import reconstruction_frames
from sweepframe.plans.fixtures import FRAME, FRAMES, MESSAGES, POSES, frames, messages, poses
from sweepframe.registry import query

FR = "drive_id, frame_index"
SIDES = f"""{MESSAGES}, fast AS (SELECT user_id % 4 AS key, ts_us, value FROM msg WHERE event_type IN ('view', 'click', 'error')), target AS (SELECT user_id % 4 AS key, ts_us, arrival_seq FROM msg WHERE event_type = 'purchase')"""
ASOF = f"""{SIDES}, p AS (SELECT t.key, t.ts_us, t.arrival_seq, f.ts_us AS prev_ts, f.value AS prev_value FROM target t ASOF LEFT JOIN fast f ON t.key = f.key AND t.ts_us > f.ts_us),
b AS (SELECT p.*, f.ts_us AS next_ts, f.value AS next_value FROM p ASOF LEFT JOIN fast f ON p.key = f.key AND p.ts_us <= f.ts_us)"""


def sides(s, d):
    m = messages(s, d).withColumn("key", F.col("user_id") % 4)
    return m.where("event_type = 'purchase'").select("key", "ts_us", "arrival_seq"), m.where("event_type in ('view', 'click', 'error')").select("key", "ts_us", "value")


def bracketed(s, d, bucket_us=6 * 3_600_000_000):
    return bracket(*sides(s, d), ["key"], "ts_us", ["value"], bucket_us)


@query("jn_7_bracketing_as_of", f"WITH {ASOF} SELECT arrival_seq, prev_ts, next_ts, CASE WHEN next_ts IS NULL OR ts_us - prev_ts <= next_ts - ts_us THEN prev_ts ELSE next_ts END AS nearest_ts FROM b")
def jn_7(s, d):
    return bracketed(s, d).select("arrival_seq", "prev_ts", "next_ts", "nearest_ts")


@query("jn_7_unbucketed_as_of", f"WITH {ASOF} SELECT arrival_seq, prev_ts, next_ts FROM b")
def jn_7b(s, d):
    return bracketed(s, d, None).select("arrival_seq", "prev_ts", "next_ts")


@query("jn_9_exact_lookup", f"WITH {SIDES} SELECT arrival_seq, f.ts_us IS NOT NULL AS found FROM target t LEFT JOIN (SELECT DISTINCT key, ts_us FROM fast) f USING (key, ts_us)")
def jn_9(s, d):
    t, f = sides(s, d)
    return t.join(f.select("key", "ts_us").distinct().withColumn("f", F.lit(True)), ["key", "ts_us"], "left").select("arrival_seq", F.coalesce("f", F.lit(False)).alias("found"))


@query("jn_10_offset_ledger", f"WITH {FRAMES}, st AS (SELECT {FR}, ts_ns + k * 1000003 + frame_index % 5 AS ts_ns, 's' || k AS stream FROM frames, range(0, 3) r(k)) SELECT a.stream, count(*) AS n, min(a.ts_ns - m.ts_ns) AS min_ns, max(a.ts_ns - m.ts_ns) AS max_ns, avg(a.ts_ns - m.ts_ns) AS mean_ns FROM st a JOIN st m ON a.drive_id = m.drive_id AND a.frame_index = m.frame_index AND m.stream = 's0' GROUP BY a.stream")
def jn_10(s, d):
    f = frames(s, d)
    st = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(*FRAME, (F.col("ts_ns") + F.col("k") * 1000003 + F.col("frame_index") % 5).alias("ts_ns"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("stream"))
    master = st.where("stream = 's0'").select(*FRAME, F.col("ts_ns").alias("m"))
    off = F.col("ts_ns") - F.col("m")
    return st.join(master, FRAME).groupBy("stream").agg(F.count("*").alias("n"), F.min(off).alias("min_ns"), F.max(off).alias("max_ns"), F.avg(off).alias("mean_ns"))


@query("src_10_timestamps", "SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) * 1000 + event_id * 7919 % 1000000000 AS ts_ns FROM events")
def src_10(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") * 7919 % 1000000000).cast("string"), 9, "0"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", parse_timestamp_ns(text).alias("ts_ns"))


@query("src_14_odometry_times", "SELECT event_id, CAST(event_id * 103456789 AS BIGINT) AS ts_ns FROM events")
def src_14(s, d):
    n = F.col("event_id") * 103456789
    text = F.concat(F.floor(n / 1000000000).cast("string"), F.lit("."), F.lpad((n % 1000000000).cast("string"), 9, "0"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", decimal_seconds_ns(text).alias("ts_ns"))


@query("dt_1_stamps", "SELECT event_id, (event_id - 5000) * 1000000000 + event_id * 31 AS ns, CAST(floor(((event_id - 5000) * 1000000000 + event_id * 31) / 1000) AS BIGINT) AS us FROM events")
def dt_1(s, d):
    ns = stamp_ns(F.col("event_id") - 5000, F.col("event_id") * 31)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", ns.alias("ns"), ns_to_us(ns).alias("us"))


@query("str_1_acquisition_id", "SELECT event_id, 'lidar@' || event_id || '.' || lpad(CAST(event_id * 17 AS VARCHAR), 9, '0') AS id FROM events")
def str_1(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", acquisition_id(F.lit(" lidar "), F.col("event_id"), F.col("event_id") * 17).alias("id"))


@query("src_19_previous_walk", f"WITH {FRAMES}, c AS (SELECT {FR}, lag(frame_index, k) OVER (PARTITION BY drive_id ORDER BY frame_index) AS prev, k FROM frames, (VALUES (1), (2), (3)) r(k)) SELECT {FR}, list_sort(list(prev), 'DESC') AS previous FROM (SELECT f.drive_id, f.frame_index, p.frame_index AS prev FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY frame_index) AS n FROM frames) f JOIN (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY frame_index) AS n FROM frames) p ON f.drive_id = p.drive_id AND p.n BETWEEN f.n - 3 AND f.n - 1) GROUP BY ALL")
def src_19(s, d):
    w = Window.partitionBy("drive_id").orderBy("frame_index")
    return frames(s, d).select(*FRAME, F.array_compact(F.array(*(F.lag("frame_index", k).over(w) for k in (1, 2, 3)))).alias("previous")).where("size(previous) > 0")


@query("src_19_pointer_walk", f"WITH {FRAMES}, r AS (SELECT *, drive_id || ':' || frame_index AS id, row_number() OVER (PARTITION BY drive_id ORDER BY frame_index) AS n FROM frames) SELECT f.id, string_agg(p.id, ',' ORDER BY p.n DESC) AS previous FROM r f JOIN r p ON f.drive_id = p.drive_id AND p.n BETWEEN f.n - 3 AND f.n - 1 GROUP BY f.id")
def src_19_pointers(s, d):
    """The same of records that know the record before them alone, without a time: a recursive walk of at most three steps."""
    w = Window.partitionBy("drive_id").orderBy("frame_index")
    name = F.concat_ws(":", "drive_id", "frame_index")
    records = frames(s, d).select(name.alias("id"), F.lag(name).over(w).alias("prev"))
    walk = previous_walk(s, records, 3)
    return walk.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "previous"))), lambda x: x["previous"]), ",").alias("previous"))


@query("win_11_mercator_poses", f"WITH {POSES}, f AS (SELECT drive_id, arg_min(lat, frame_index) AS lat0, arg_min(lon, frame_index) AS lon0, arg_min(alt, frame_index) AS alt0, arg_min(yaw, frame_index) AS yaw0 FROM poses GROUP BY drive_id), m AS (SELECT *, cos(radians(lat0)) * 6378137 * (radians(lon) - radians(lon0)) AS dx, cos(radians(lat0)) * 6378137 * (ln(tan(radians(90 + lat) / 2)) - ln(tan(radians(90 + lat0) / 2))) AS dy FROM poses JOIN f USING (drive_id)) SELECT {FR}, round(cos(yaw0) * dx + sin(yaw0) * dy, 4) + 0 AS x, round(cos(yaw0) * dy - sin(yaw0) * dx, 4) + 0 AS y, round(alt - alt0, 4) + 0 AS z FROM m")
def win_11(s, d):
    out = normalised_poses(poses(s, d).select(*FRAME, "lat", "lon", "alt", "yaw"))
    return out.select(*FRAME, *((F.round(c, 4) + 0.0).alias(c) for c in "xyz"))


ERRORS = f"""{POSES}, e AS (SELECT {FR}, 0.01::DOUBLE * (frame_index % 7) - 0.02::DOUBLE AS ex, 0.02::DOUBLE * (frame_index % 5) AS ey, (frame_index % 3) * 0.001::DOUBLE AS ez FROM poses)"""


def errors(s, d):
    i = F.col("frame_index")
    return poses(s, d).select(*FRAME, ((i % 7) * 0.01 - 0.02).alias("ex"), ((i % 5) * 0.02).alias("ey"), ((i % 3) * 0.001).alias("ez"))


@query("win_10_sign_changes", f"WITH {ERRORS} SELECT drive_id, CAST(sum(CASE WHEN (ex < 0) <> (p < 0) THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT *, lag(ex) OVER (PARTITION BY drive_id ORDER BY frame_index) AS p FROM e) GROUP BY drive_id")
def win_10(s, d):
    before = F.lag("ex").over(Window.partitionBy("drive_id").orderBy("frame_index"))
    return errors(s, d).withColumn("p", before).groupBy("drive_id").agg(F.count_if((F.col("ex") < 0) != (F.col("p") < 0)).alias("changes"))


@query("win_13_increasing", f"WITH {FRAMES} SELECT drive_id, bool_and(coalesce(ts_ns > p, true)) AS increasing FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY drive_id ORDER BY frame_index) AS p FROM frames) GROUP BY drive_id")
def win_13(s, d):
    from sweepframe.sources.text import increasing

    return increasing(frames(s, d), ["drive_id"], "frame_index", "ts_ns")


#: Motion of each frame from the eleventh on: distance and turn since the frame before, of planar poses.
MOTION = f"""{POSES}, step AS (SELECT drive_id, frame_index, sqrt((tx - lag(tx) OVER w) ** 2 + (ty - lag(ty) OVER w) ** 2 + (tz - lag(tz) OVER w) ** 2) + abs(yaw - lag(yaw) OVER w) AS moved FROM poses WINDOW w AS (PARTITION BY drive_id ORDER BY frame_index)),
score AS (SELECT drive_id, frame_index, round(moved, 9) AS motion FROM step WHERE frame_index >= 11), last AS (SELECT drive_id, max(frame_index) AS last FROM frames GROUP BY drive_id),
pick0 AS (SELECT DISTINCT drive_id, k AS frame_index FROM (SELECT drive_id, unnest([0, 1, 2, 5, 10]) AS k FROM last UNION ALL SELECT drive_id, 11 + r * (last - 11) // 15 FROM last, range(0, 16) t(r))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY motion, frame_index) - 1 AS k, count(*) OVER (PARTITION BY drive_id) AS n FROM score),
pick1 AS (SELECT drive_id, frame_index FROM pick0 UNION ALL SELECT drive_id, arg_min(frame_index, k) FROM ranked ANTI JOIN pick0 USING (drive_id, frame_index) GROUP BY drive_id),
pick2 AS (SELECT drive_id, frame_index FROM pick1 UNION ALL SELECT drive_id, arg_min(frame_index, {{'d': abs(2 * k - (n - 1)), 'i': frame_index}}) FROM ranked ANTI JOIN pick1 USING (drive_id, frame_index) GROUP BY drive_id),
pick3 AS (SELECT drive_id, frame_index FROM pick2 UNION ALL SELECT drive_id, arg_max(frame_index, k) FROM ranked ANTI JOIN pick2 USING (drive_id, frame_index) GROUP BY drive_id)"""


@query("sel_4_reconstruction_frames", f"WITH {MOTION} SELECT * FROM pick3")
def sel_4(s, d):
    """24 frames a drive: structural and systematic ones, then the unused ones of lowest, median and highest motion."""
    w = Window.partitionBy("drive_id").orderBy("frame_index")
    moved = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("tx", "ty", "tz"))) + F.abs(F.col("yaw") - F.lag("yaw").over(w))
    motion = poses(s, d).select(*FRAME, F.round(moved, 9).alias("motion"))
    return reconstruction_frames(motion)


@query("geo_16_slerp", f"WITH {POSES} SELECT {FR}, round(sin(yaw / 4), 6) AS z, round(cos(yaw / 4), 6) AS w FROM poses")
def geo_16(s, d):
    z = F.lit(0.0)
    q = G.slerp([F.lit(1.0), z, z, z], [F.cos(F.col("yaw") / 2), z, z, F.sin(F.col("yaw") / 2)], F.lit(0.5))
    return poses(s, d).select(*FRAME, F.round(q[3], 6).alias("z"), F.round(q[0], 6).alias("w"))


TURNED = f"{POSES}, t AS (SELECT *, (yaw * 5 + pi()) % (2 * pi()) - pi() AS turn FROM poses), q AS (SELECT *, cos(turn / 2) AS w, sin(turn / 2) AS z FROM t)"


@query("geo_16_rotation_quaternions", f"WITH {TURNED} SELECT {FR}, round(CASE WHEN 1 + 2 * cos(turn) <= 0 AND z < 0 THEN -w ELSE w END, 6) + 0 AS w, round(CASE WHEN 1 + 2 * cos(turn) <= 0 AND z < 0 THEN -z ELSE z END, 6) + 0 AS z FROM q")
def geo_16_quaternions(s, d):
    """Of the matrices of turns all round, by the trace and, beyond a third of a turn, by the diagonal."""
    m = poses(s, d).select(*FRAME, G.rotation("z", F.col("yaw") * 5).alias("m"))
    q = G.rotation_quaternion(F.col("m"), 3)
    return m.select(*FRAME, (F.round(q[0], 6) + 0.0).alias("w"), (F.round(q[3], 6) + 0.0).alias("z"))


@query("geo_16_geodesic_distance", f"WITH {TURNED}, p AS (SELECT *, first(turn) OVER (PARTITION BY drive_id ORDER BY frame_index) AS first FROM q) SELECT {FR}, round(abs((turn - first + 3 * pi()) % (2 * pi()) - pi()), 6) + 0 AS from_first, 1e-9::DOUBLE * frame_index AS tiny FROM p")
def geo_16_distance(s, d):
    """From the first rotation of the drive, and of a turn by some billionths."""
    w = Window.partitionBy("drive_id").orderBy("frame_index")
    m = poses(s, d).select(*FRAME, G.rotation("z", F.col("yaw") * 5).alias("m")).withColumn("first", F.first("m").over(w))
    a, b = (G.rotation_quaternion(F.col(c), 3) for c in ("m", "first"))
    i, zero = F.col("frame_index") * 1e-9, F.lit(0.0)
    tiny = G.rotation_distance([F.lit(1.0), zero, zero, zero], [-F.cos(i / 2), zero, zero, -F.sin(i / 2)])
    return m.select(*FRAME, (F.round(G.rotation_distance(a, b), 6) + 0.0).alias("from_first"), F.round(tiny, 15).alias("tiny"))


@query("sql_functions", "SELECT c_custkey AS id, round((a + pi()) % (2 * pi()) - pi(), 6) + 0 AS wrapped, round(degrees(abs((a - b + 3 * pi()) % (2 * pi()) - pi())), 6) + 0 AS heading, CAST(floor((c_acctbal / 100 + 50) / 0.25) AS INT) AS cell FROM (SELECT *, (c_custkey % 37) * 0.4::DOUBLE AS a, (c_custkey % 11) * 0.7::DOUBLE AS b FROM customer)")
def sql_functions(s, d):
    """The functions that SQL users get: wrap_angle, heading_difference, cell_index."""
    from sweepframe.functions.sql import register

    register(s)
    s.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("_customers")
    return s.sql("SELECT c_custkey AS id, round(wrap_angle(a), 6) + 0.0D AS wrapped, round(heading_difference(a, b), 6) + 0.0D AS heading, cell_index(c_acctbal / 100, -50.0D, 0.25D) AS cell FROM (SELECT *, (c_custkey % 37) * 0.4D AS a, (c_custkey % 11) * 0.7D AS b FROM _customers)")
