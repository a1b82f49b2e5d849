"""Streams: late transforms, resets, restarts in the middle, and state across restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.plans import live as PL
from sweepframe.plans.fixtures import FRAME
from sweepframe.streaming import history as H
from sweepframe.streaming import live as L

DATA = "/root/testdata/sf0.001"
SWEEP = "sensor string, frame_index long, ts_ns long, arrived timestamp"
RECORD = "sensor string, edge int, ts_ns long, tx double, ty double, tz double, qw double, qx double, qy double, qz double, arrived timestamp"


def write(spark, rows, schema, path):
    """(arrival in seconds, row) as one file a second of arrival, in order."""
    for second in sorted({int(r[0]) for r in rows}):
        part = [(*r[1], r[0]) for r in rows if int(r[0]) == second]
        names = schema.replace("arrived timestamp", "at double")
        spark.createDataFrame(part, names).withColumn("arrived", F.timestamp_micros(((F.col("at") + 1_000) * 1_000_000).cast("long"))).drop("at").coalesce(1).write.mode("append").parquet(path)


def settled(spark, folder, sweeps, records, depth=2, gap_ns=0, conf=None):
    write(spark, sweeps, SWEEP, f"{folder}/a")
    write(spark, records, RECORD, f"{folder}/b")
    a, b = (H.replay(spark, f"{folder}/{n}", spark.read.parquet(f"{folder}/{n}").schema, 100) for n in "ab")
    return {r.frame_index: r for r in L.run_to_end(L.sweep_transforms(a, b, 1, depth, gap_ns), folder).groupBy("frame_index").agg(
        F.max("history_rank").alias("depth"), F.bool_and("accepted").alias("accepted"), F.first("reset").alias("reset"), F.sort_array(F.collect_list(F.struct("history_rank", "source_index"))).alias("sources"),
    ).collect()}


S = 1_000_000_000


def test_late_transform_rejects_this_output_only(spark, tmp_path):
    sweeps = [(k + 0.0, ("a", k, k * S)) for k in range(6)] + [(60.0, ("a", None, 60 * S))]
    records = [(k + 0.0, ("a", 0, k * S, float(k), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)) for k in (0, 1, 2)]
    # What brackets sweep 5 comes half a minute late; sweeps 3 and 4 are known by a record at 4.5 s.
    records += [(4.5, ("a", 0, 4 * S + S // 2, 4.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)), (61.0, ("a", 0, 6 * S, 6.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0))]
    write(spark, sweeps, SWEEP, f"{tmp_path}/a")
    write(spark, records[:-1], RECORD, f"{tmp_path}/b")
    a, b = (H.replay(spark, f"{tmp_path}/{n}", spark.read.parquet(f"{tmp_path}/{n}").schema, 100) for n in "ab")
    stream = L.sweep_transforms(a, b, 1, 2)
    L.run_to_end(stream, str(tmp_path))
    # Restart: the late record, and two more sweeps with their own records.
    write(spark, [(62.0, ("a", 6, 6 * S)), (62.0, ("a", 7, 7 * S)), (99.0, ("a", None, 99 * S))], SWEEP, f"{tmp_path}/a")
    write(spark, [records[-1], (62.0, ("a", 0, 7 * S, 7.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0))], RECORD, f"{tmp_path}/b")
    out = L.run_to_end(stream, str(tmp_path)).collect()
    accepted = {r.frame_index: r.accepted for r in out}
    # Sweep 5 is rejected and stays in the history of 6 and 7, which therefore have a missing transform too.
    assert accepted == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}
    ranks = {r.frame_index: [] for r in out}
    for r in sorted(out, key=lambda r: (r.frame_index, r.history_rank)):
        ranks[r.frame_index].append((r.source_index, r.relative is not None))
    assert ranks[7] == [(7, True), (6, True), (5, False)] and ranks[5] == [(5, False), (4, False), (3, False)]
    shift = next(r.relative for r in out if r.frame_index == 4 and r.history_rank == 1)
    assert abs(shift[3] + 1.0) < 1e-9


def test_resets_by_time_and_gap(spark, tmp_path):
    stamps = [0, 1, 2, 10, 11, 9, 10]
    sweeps = [(k + 0.0, ("a", k, t * S)) for k, t in enumerate(stamps)] + [(60.0, ("a", None, 60 * S))]
    records = [(k + 0.0, ("a", 0, t * S, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)) for k, t in enumerate(range(12))]
    got = settled(spark, str(tmp_path), sweeps, records, 2, 3 * S)
    assert [(got[k].depth, got[k].reset) for k in range(7)] == [(0, None), (1, None), (2, None), (0, "gap"), (1, None), (0, "time_regression"), (1, None)]
    assert all(r.accepted for r in got.values())


def test_interpolated_matrix():
    turn = lambda a: (np.cos(a / 2), 0.0, 0.0, np.sin(a / 2))
    own = [(0, 0.0, 0.0, 0.0, *turn(0.0)), (10, 2.0, 4.0, 0.0, *(-x for x in turn(1.0)))]
    m = L.interpolated_matrix(own, 5)
    assert np.allclose(m[:3, 3], [1, 2, 0]) and np.allclose(m[:2, 0], [np.cos(0.5), np.sin(0.5)])
    assert L.interpolated_matrix(own, 11) is None and L.interpolated_matrix(own, -1) is None and L.interpolated_matrix([], 0) is None
    assert np.allclose(L.interpolated_matrix(own, 10)[:2, 0], [np.cos(1), np.sin(1)])


def test_model_points_after_a_restart(spark):
    whole = PL.live_points(spark, DATA).collect()
    seen = []

    def fail(batch_id):
        seen.append(batch_id)
        if batch_id == 2:
            raise RuntimeError("cut short")

    folder = PL.scratch_folder
    made = []
    PL.scratch_folder = lambda s, n: made.append(folder(s, n)) or made[-1]
    try:
        with pytest.raises(Exception, match="cut short"):
            PL.live_points(spark, DATA, fail)
    finally:
        PL.scratch_folder = folder
    again = PL.live_points(spark, DATA, seen.append, made[0])
    assert seen == [0, 1, 2, 2, 3]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole)) and again.select(*FRAME, "history_rank", "src_row_idx").distinct().count() == len(whole)


def test_larger_payloads_give_more_slices(spark, monkeypatch):
    from sweepframe.plans.sweeps import reconstructed

    size = spark.read.parquet(f"{DATA}/lineitem.parquet").count() * 16
    monkeypatch.setattr(PL, "SLICE", size // 6 + 1)
    batches = []
    got = PL.live_points(spark, DATA, batches.append)
    columns = [*FRAME, "history_rank", "src_row_idx", "x", "y", "z", "time_lag"]
    assert batches == list(range(6)) and sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, reconstructed(spark, DATA).select(*columns).collect()))


def test_slices_are_worked_out_once_and_lie_in_order_of_arrival(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    at = [0, 5, 7, 30, 31, 59, 90, 99, 100]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(at)], "k long, at long").select("k", F.timestamp_micros(F.col("at") + 1_700_000_000_000_000).alias("arrived"))
    PL.sliced(rows.repartition(3).mapInArrow(counted, rows.schema), rows.select("arrived"), f"{tmp_path}/store", f"{tmp_path}/in", 5)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    got = [sorted(r.k for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert got == [[0, 1, 2], [3, 4], [5], [], [6, 7, 8]] and seen.value == len(at)
    # A single time, and none at all.
    for k, own in enumerate((rows.where("k = 3"), rows.where("k < 0"))):
        PL.sliced(own, own.select("arrived"), f"{tmp_path}/store{k}", f"{tmp_path}/in{k}", 4)
        assert spark.read.parquet(f"{tmp_path}/in{k}").count() == 1 - k and len(list((tmp_path / f"in{k}").glob("*.parquet"))) == 4


def test_micro_batches_read_stored_poses(spark, monkeypatch):
    made = []
    sink = PL.P.ModelPointSink
    monkeypatch.setattr(PL.P, "ModelPointSink", lambda poses, *rest: made.append(poses) or sink(poses, *rest))
    monkeypatch.setattr(PL.P, "run", lambda stream, own: stream)
    PL.live_points(spark, DATA)
    assert made[0].inputFiles() and not any("lineitem" in f for f in made[0].inputFiles())
    assert made[0].count() == PL.poses(spark, DATA).count() > 0


def test_a_transform_is_no_part_of_the_join(spark):
    """Its code, repeated for each face of the crop, is too long for the JVM to compile where it stands in a join's condition."""
    from sweepframe.plans.sweeps import reconstructed

    plan = reconstructed(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 3 and not any("Join" in line and "CASE WHEN" in line for line in plan.splitlines())
