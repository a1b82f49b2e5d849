"""Files written here are read back by the sources; streams agree with their batch twins."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sweepframe.sources import binary, manifests, sinks, text
from sweepframe.streaming.history import batch_history, stream_history


def test_points_and_labels(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    (tmp_path / "a.label").write_bytes(np.array([5 | 7 << 16, 1, 0xFFFF0002], "<u4").tobytes())
    rows = binary.read_points(spark, str(tmp_path), strict=True).orderBy("row_idx").collect()
    assert [[r.x, r.y, r.z, r.remission] for r in rows] == x.tolist()
    labels = binary.read_labels(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.semantic_id, r.instance_id) for r in labels] == [(5, 7), (1, 0), (2, 65535)]
    (tmp_path / "b.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole records"):
        binary.read_points(spark, str(tmp_path)).count()


def test_las(spark, tmp_path):
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    head[104] = 0
    struct.pack_into("<HI", head, 105, 20, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBH", 100 * k, 200, 300, 9, 0, 2 + k, 0, 0, 1) for k in range(2))
    (tmp_path / "t.las").write_bytes(bytes(head) + body)
    rows = binary.read_las(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.x, r.y, r.z, r.classification) for r in rows] == [(100.0, 202.0, 3.0, 2), (101.0, 202.0, 3.0, 3)]


def test_scan_writer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d0", 3, k, float(k), 0.0, 1.0, 0.5) for k in (2, 0, 1)], "drive_id string, frame_index long, row_idx long, x float, y float, z float, remission float")
    sinks.write_scans(df, str(tmp_path))
    assert [r.x for r in binary.read_points(spark, str(tmp_path)).orderBy("row_idx").collect()] == [0.0, 1.0, 2.0]


def test_message_round_trip(spark):
    df = spark.createDataFrame([("s", k, float(k), 2.0, 3.0, 0.1) for k in range(4)], "sensor string, row_idx long, x float, y float, z float, time_lag float")
    packed = sinks.payloads(df, ["sensor"])
    assert binary.layout_problem(packed).first().problem is None
    out = binary.decode_messages(packed, ["sensor"], ("time_lag", "x")).orderBy("row_idx").collect()
    assert [r.x for r in out] == [0.0, 1.0, 2.0, 3.0] and out[0].time_lag == pytest.approx(0.1)
    broken = packed.withColumn("width", F.lit(9))
    assert binary.layout_problem(broken).first().problem == "row_step"


def test_big_endian_padding_and_nan(spark):
    row = struct.pack(">ff4x", 1.0, 2.0) + struct.pack(">ff4x", float("nan"), 2.0) + b"pad!"
    fields = [("y", 4, 7, 1), ("x", 0, 7, 1)]
    m = spark.createDataFrame([("s", 1, 2, fields, True, 12, 28, bytearray(row))], "sensor string, height int, width int, fields array<struct<name: string, offset: int, datatype: int, count: int>>, is_bigendian boolean, point_step int, row_step int, data binary")
    assert [(r.row_idx, r.x, r.y) for r in binary.decode_messages(m, ["sensor"], ("x", "y")).collect()] == [(0, 1.0, 2.0)]
    with pytest.raises(Exception, match="non-finite"):
        binary.decode_messages(m, ["sensor"], ("x", "y"), "raise").count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "times.txt").write_text("2011-09-26 13:02:25.000000001\n2011-09-26 13:02:25.100000000\n")
    assert [r.ts_ns % 1_000_000_000 for r in text.timestamps(spark, str(tmp_path / "times.txt")).orderBy("frame_index").collect()] == [1, 100000000]
    (tmp_path / "calib.txt").write_text("calib_time: 1\nR: 1 0 0 0 1 0 0 0 1\nT: 1.5 2 3\n")
    values = text.calibration(spark, str(tmp_path / "calib.txt")).first()["values"]
    assert values["T"] == [1.5, 2.0, 3.0] and "calib_time" not in values
    (tmp_path / "oxts.txt").write_text("49 8.4 110 0 0 0.5 7\n")
    assert text.oxts(spark, str(tmp_path / "oxts.txt")).first().yaw == 0.5
    (tmp_path / "poses.txt").write_text("1 0 0 4 0 1 0 5 0 0 1 6\n")
    assert text.odometry_poses(spark, str(tmp_path / "poses.txt")).first().pose[3] == 4.0
    (tmp_path / "odo.txt").write_text("0.000000001\n1.25\n")
    assert [r.ts_ns for r in text.odometry_times(spark, str(tmp_path / "odo.txt")).orderBy("frame_index").collect()] == [1, 1250000000]


def test_tracklets(spark, tmp_path):
    pose = "<item><tx>1</tx><ty>2</ty><tz>3</tz><rx>0</rx><ry>0</ry><rz>0.5</rz><state>2</state><occlusion>0</occlusion><truncation>1</truncation></item>"
    (tmp_path / "t.xml").write_text(f"<root><tracklets><count>1</count><item><objectType>Pedestrian</objectType><h>1</h><w>2</w><l>3</l><first_frame>7</first_frame><poses><count>1</count>{pose}</poses></item></tracklets></root>")
    r = text.tracklets(spark, str(tmp_path / "t.xml")).first()
    assert (r.object_type, r.frame_index, r.state, r.tx) == ("Pedestrian", 7, 2, 1.0)


def test_manifest(spark, tmp_path):
    for folder, name in (("velodyne", "000000.bin"), ("velodyne", "000001.bin"), ("labels", "000000.label")):
        (tmp_path / "sequences" / "00" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "sequences" / "00" / folder / name).write_bytes(b"0" * 16)  # Spark skips empty files
    rows = manifests.scan_manifest(spark, str(tmp_path), {"00": "train"}).orderBy("frame_index").collect()
    assert [(r.split, r.scan_path is not None, r.label_path is not None) for r in rows] == [("train", True, True), ("train", True, False)]


def test_stream_equals_batch_twin(spark, tmp_path):
    rows = [(s, k, 1_000_000 * k - (5_000_000 if k % 7 == 3 else 0) + (90_000_000 if k > 20 else 0)) for s in (0, 1) for k in range(30)]
    df = spark.createDataFrame(rows, "sensor long, arrival_seq long, stamp_us long")
    for part in range(3):
        df.where(f"arrival_seq >= {part * 10} and arrival_seq < {part * 10 + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_history(stream, 5, 60_000_000).writeStream.format("memory").queryName("history").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.sensor, r.arrival_seq): (r.reset, r.depth) for r in spark.table("history").collect()}
    assert got == {(r.sensor, r.arrival_seq): (r.reset, r.depth) for r in batch_history(df, 5, 60_000_000).collect()}


def test_audit_job(spark, tmp_path):
    import json

    from sweepframe.jobs import audit

    rows = [("d", k % 2, k, float(k), 1.0, 0.0, 1 + k % 5, "val") for k in range(10)]
    spark.createDataFrame(rows, "drive_id string, frame_index long, row_idx long, x float, y float, z float, label int, split string").write.parquet(f"{tmp_path}/p")
    audit.main(["--points", f"{tmp_path}/p", "--out", f"{tmp_path}/out", "--split", "val", "--max-samples", "1", "--patch-size", "5"])
    r = json.loads(spark.read.text(f"{tmp_path}/out").first().value)
    assert r["n_points"] == 5 and r["max_x"] == 8.0 and r["ignored"] == 1 and list(r) == sorted(r)


def test_history_leaves_a_task_in_steps(spark, tmp_path):
    """A micro-batch of one sensor gives several tables, none of them over STEP rows, and the same rows as the batch twin."""
    from sweepframe.streaming import history as H

    n = 2 * H.STEP + 7
    rows = spark.range(n).select(F.lit(1).cast("long").alias("sensor"), F.col("id").alias("arrival_seq"), (F.col("id") * 1_000_000 - F.when(F.col("id") % 37 == 0, 5_000_000).otherwise(0) + F.when(F.col("id") > 9_000, 90_000_000).otherwise(0)).alias("stamp_us"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    q = H.stream_history(H.replay(spark, f"{tmp_path}/in", rows.schema, 2), 5, 60_000_000)
    q = q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == n

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    found = {}

    class Messages:
        def select(self, *_):
            return self

        groupBy = select

        def applyInPandasWithState(self, step, *_):  # noqa: N802
            found["step"] = step

    H.stream_history(Messages(), 5, 60_000_000)
    state = State()
    out = list(found["step"]((1,), iter([rows.drop("sensor").toPandas().sample(frac=1, random_state=2)]), state))
    assert len(out) == 3 and max(map(len, out)) == H.STEP
    want = {r.arrival_seq: (r.reset, r.depth) for r in H.batch_history(rows, 5, 60_000_000).collect()}
    assert {s: (r, d) for t in out for s, r, d in zip(t["arrival_seq"], t["reset"], t["depth"])} == want
    assert {None, "gap", "time_regression"} == {r for r, _ in want.values()}
    assert state.kept == ((n - 1) * 1_000_000 + 90_000_000, [n - 1, n - 2, n - 3, n - 4, n - 5])


def test_a_frame_is_written_a_batch_at_a_time(spark, tmp_path):
    """Frames larger than a batch, several of them in a task: the writer gets pieces, files are those of whole frames."""
    rows = [("d0", f, k, float(k), float(f), 0.5, k % 7) for f in (3, 4) for k in range(25, -1, -1)]
    df = spark.createDataFrame(rows, "drive_id string, frame_index long, row_idx long, x float, y float, z float, label int").repartition(3)
    pieces = binary._FrameWriter(str(tmp_path), ".las", ["x", "y", "z", "label"], True)
    t = pa.table({"drive_id": ["d0"] * 5, "frame_index": [3, 3, 3, 4, 4], "n_points": [3, 3, 3, 2, 2], "x": [0.0] * 5, "y": [0.0] * 5, "z": [0.0] * 5, "label": range(5)})
    assert [(k, len(b)) for k, b in pieces.pieces(t.to_batches(max_chunksize=2))] == [(("d0", 3, 3), 2), (("d0", 3, 3), 1), (("d0", 4, 2), 1), (("d0", 4, 2), 1)]
    with pytest.raises(ValueError, match="2 of 3 points"):
        pieces.write(iter(t.slice(0, 2).to_batches()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        sinks.write_tiles(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch") if before is None else spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for f in (3, 4):
        own = sorted((r for r in rows if r[1] == f), key=lambda r: r[2])
        assert (tmp_path / "t" / "d0" / f"{f:010d}.las").read_bytes() == binary.las_tile(np.array([r[3:6] for r in own]), np.array([r[6] for r in own]))
