"""Queries that run as streams over the given tables, replayed in order of arrival, each beside the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe.plans import files  # noqa: F401  its SQL is used here
from sweepframe.plans.fixtures import FRAME, frames, messages, points, poses, telemetry
from sweepframe.plans.sensors import GAP
from sweepframe.plans.sweeps import DEPTH, MOVED
from sweepframe.plans.transforms import FR, LOOKUP, mount, records, seen
from sweepframe.registry import ORACLE, query
from sweepframe.sources import sinks
from sweepframe.sources.scratch import scratch_folder
from sweepframe.streaming import counters as C
from sweepframe.streaming import history as H
from sweepframe.streaming import live as L
from sweepframe.streaming import pipeline as P


def arrival(ts_ns):
    return F.timestamp_micros(F.floor(ts_ns / 1000).cast("long"))


#: Row groups of few messages: their size is looked at after each row, as a row may be a whole sweep.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
#: Bytes of payloads of a slice, roughly; more of them give more slices.
SLICE = 256 << 20
#: Bytes of a point in a payload of x, y, z and time_lag.
PAYLOAD = 16


def sliced(rows, arrivals, store, path, slices):
    """rows with `arrived` as one file in path for each of so many equal spans of `arrivals`, written one after the other. rows take work, so all are stored by
    their slice first: each is worked out once, and read once by the task that copies its slice."""
    s, at = rows.sparkSession, F.unix_micros("arrived")
    low, high = arrivals.agg(F.coalesce(F.min(at), F.lit(0)), F.coalesce(F.max(at), F.lit(0))).first()
    place = F.floor((at - low) / (high - low + 1) * slices).cast("int")
    rows.withColumn("slice", F.least(place, F.lit(slices - 1))).write.partitionBy("slice").options(**ROW_GROUPS).parquet(store)
    stored = s.read.schema(rows.schema.add("slice", "integer")).parquet(store)
    for k in range(slices):
        stored.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").options(**ROW_GROUPS).parquet(path)


def replayed(s, tables, path, slices=4):
    """Tables with `arrived` as streams of so many files each, cut at the same times and written one after the other, so that they are read in order of arrival.

    A file is written by one task that only copies, so a table that takes work is stored before, and slices are as many as keep one small.
    """
    low, high = tables[0].agg(F.min(F.unix_micros("arrived")), F.max(F.unix_micros("arrived"))).first()
    cuts = [low + (high - low) * k // slices for k in range(1, slices)]
    for k in range(slices):
        for i, rows in enumerate(tables):
            at = F.unix_micros("arrived")
            part = rows.where(F.lit(True) if k == 0 else at >= cuts[k - 1]).where(F.lit(True) if k == slices - 1 else at < cuts[k])
            part.coalesce(1).write.mode("append").options(**ROW_GROUPS).parquet(f"{path}/{i}")
    return [H.replay(s, f"{path}/{i}", rows.schema, 1) for i, rows in enumerate(tables)]


def live_transforms(s, d):
    """Each drive's sweeps and the records of its two edges; a last message of each drive, 20 seconds later, only moves the time on."""
    path = scratch_folder(s, "live")
    f = frames(s, d).select(F.col("drive_id").alias("sensor"), "frame_index", "ts_ns", arrival(F.col("ts_ns")).alias("arrived"))
    end = f.groupBy("sensor").agg(F.lit(None).cast("long").alias("frame_index"), F.max("ts_ns").alias("ts_ns"), (F.max("arrived") + F.expr("interval 20 seconds")).alias("arrived"))
    r = records(s, d).withColumn("edge", F.lit(0)).unionByName(mount(s, d).withColumn("edge", F.lit(1))).withColumnRenamed("drive_id", "sensor").withColumn("arrived", arrival(F.col("ts_ns")))
    return L.run_to_end(L.sweep_transforms(*replayed(s, [f.unionByName(end), r], path), 2, 3), path).withColumnRenamed("sensor", "drive_id")


@query("stm_5_live_rejections", f"WITH {LOOKUP} SELECT {FR}, max(history_rank) AS depth, bool_and(accepted) AS published, count(*) FILTER (dx IS NULL) AS missing FROM ok GROUP BY ALL")
def stm_5_live(s, d):
    """The twin of stm_5_transform_rejections: sweeps and transforms as two streams that meet in a keyed state."""
    return live_transforms(s, d).groupBy(*FRAME).agg(F.max("history_rank").alias("depth"), F.bool_and("accepted").alias("published"), F.count_if(F.col("relative").isNull()).alias("missing"))


@query("stm_1_live_transforms", f"WITH {LOOKUP} SELECT {FR}, history_rank, round(cos(ct) * dx + sin(ct) * dy, 6) + 0 AS x, round(cos(ct) * dy - sin(ct) * dx, 6) + 0 AS y, round(dz, 6) + 0 AS z, round(cos(st - ct), 6) + 0 AS c, round(sin(st - ct), 6) + 0 AS s FROM ok WHERE accepted")
def stm_1_live(s, d):
    """The relative transforms of published sweeps, the twin of jn_11_transform_lookup."""
    return live_transforms(s, d).where("accepted").select(*FRAME, "history_rank", *seen("relative"))


def live_points(s, d, before_commit=None, folder=None):
    """Each frame's points as a message, decoded and moved as they arrive; folder: one of an earlier run, which goes on where it was cut short."""
    path = folder or scratch_folder(s, "live")
    if folder is None:
        # Poses come from all points, so they are stored, not worked out again by each micro-batch.
        poses(s, d).write.parquet(f"{path}/poses")
    known = s.read.parquet(f"{path}/poses")
    sink = P.ModelPointSink(known, path, DEPTH, 1.0, before_commit)
    if folder is None:
        cloud = sinks.payloads(points(s, d).withColumn("time_lag", F.lit(0.0).cast("float")), FRAME).join(known.select(*FRAME, "ts_ns"), FRAME)
        slices = max(4, -(-points(s, d).count() * PAYLOAD // SLICE))
        sliced(cloud.withColumn("arrived", arrival(F.col("ts_ns"))), known.select(arrival(F.col("ts_ns")).alias("arrived")), f"{path}/cloud", f"{path}/in/0", slices)
    return P.run(H.replay(s, f"{path}/in/0", s.read.parquet(f"{path}/in/0").schema, 1), sink)


@query("stm_4_live_model_points", f"WITH {MOVED} SELECT {FR}, history_rank, count(*) AS n, min(time_lag) AS time_lag, round(min(x)::DOUBLE, 2) AS x, round(max(y)::DOUBLE, 2) AS y FROM model GROUP BY ALL")
def stm_4_live(s, d):
    """The twin of jn_4_model_points: messages are decoded, kept by micro-batch and joined with their history and static poses as they arrive."""
    return live_points(s, d).groupBy(*FRAME, "history_rank").agg(F.count("*").alias("n"), F.min("time_lag").alias("time_lag"), F.round(F.min("x").cast("double"), 2).alias("x"), F.round(F.max("y").cast("double"), 2).alias("y"))


@query("stm_6_live_counters", ORACLE["stm_4_6_counters"])
def stm_6_live(s, d):
    """The twin of stm_4_6_counters: what a listener gathers from a running stream of messages and their history."""
    path, sensors = scratch_folder(s, "live"), list(range(8))
    m = messages(s, d).withColumns({"n_points": F.when((F.col("event_type") == "error") & (F.col("arrival_seq") % 3 == 0), 0).otherwise(100), "n_filtered": F.col("arrival_seq") % 7, "transform": F.col("arrival_seq") % 11 != 5})
    m.select("sensor", "arrival_seq", "stamp_us", "n_points", "n_filtered", "transform").repartitionByRange(4, "arrival_seq").sortWithinPartitions("arrival_seq").write.parquet(f"{path}/in")
    stream = H.replay(s, f"{path}/in", s.read.parquet(f"{path}/in").schema, 64)
    good = F.col("n_points") > 0
    came = {"received": F.lit(1), "rejected_invalid": ~good, "filtered_points": F.when(good, F.col("n_filtered")).otherwise(0), "transform_failures": good & ~F.col("transform"), "published": good & F.col("transform")}
    valid = stream.observe("came", *C.per_key("came", "sensor", sensors, came)).where(good)
    kept = H.stream_history(valid, 10, GAP).observe("kept", *C.per_key("kept", "sensor", sensors, {"resets": F.col("reset").isNotNull()}), *C.latest("kept", "sensor", sensors, "depth", "arrival_seq"))
    counters = C.Counters(path)
    C.counted_run(kept, counters, path)
    counters.table(s).write.parquet(f"{path}/counters")
    t = C.totals(s.read.parquet(f"{path}/counters")).groupBy(F.col("key").cast("long").alias("sensor")).pivot("counter", [*came, "resets", "depth"]).agg(F.first("value"))
    return t.withColumn("depth", F.col("depth").cast("int"))


@query("stm_8_live_block_samples", ORACLE["stm_8_block_samples"])
def stm_8_live(s, d):
    """The twin of stm_8_block_samples: samples and blocks, day by day, as two streams."""
    day, path, at = 86_400_000_000, scratch_folder(s, "live"), F.timestamp_micros(F.col("ts_us"))
    t = telemetry(s, d)
    samples = t.select("power_draw", F.floor(F.col("ts_us") / day).alias("slot"), at.alias("ts"), at.alias("arrived"))
    spans = t.groupBy("block").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")).withColumn("slot", F.explode(F.sequence(F.floor(F.col("t0") / day), F.floor(F.col("t1") / day))))
    start, end = F.timestamp_micros(F.greatest("t0", F.col("slot") * day)), F.timestamp_micros(F.least("t1", (F.col("slot") + 1) * day - 1))
    blocks = spans.select("block", "slot", start.alias("started"), end.alias("ended"), start.alias("arrived"))
    a, b = replayed(s, [samples, blocks], f"{path}/in")
    rows = L.run_to_end(C.block_samples(a.drop("arrived"), b.drop("arrived"), "1 hour", "1 day").select("block", "power_draw"), path)
    return rows.groupBy("block").agg(F.count("*").alias("samples"), F.avg("power_draw").alias("power"))
