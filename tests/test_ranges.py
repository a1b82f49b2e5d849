"""The range reader: tasks a file, global row numbers, files that predicates leave unopened, versions and formats of tiles, folders that can't be written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.sources import ranges as R
from sweepframe.sources.binary import _Writer, las_tile, read_las


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def tile(n, seed=0):
    r = np.random.default_rng(seed)
    return las_tile(np.round(r.uniform(-50, 50, (n, 3)), 3), r.integers(0, 9, n).astype(np.uint8))


def test_one_tile_gives_several_tasks_and_equal_rows(spark, tmp_path):
    put(tmp_path, "d1/0000000003.las", tile(1000))
    put(tmp_path, "d2/0000000004.las", tile(1))
    fields = ("x", "z", "classification")
    whole = read_las(spark, str(tmp_path), fields=fields)
    want = sorted((r.path.split("/")[-1], r.row_idx, r.x, r.z, r.classification) for r in whole.collect())
    for size in (1_000, 997, 20, 1 << 20):
        got = R.read_ranges(spark, str(tmp_path), fields, range_bytes=size)
        if size >= 997:
            assert got.rdd.getNumPartitions() == -(-len(tile(1000)) // size) + 1
        else:
            got = got.repartition(3)
        assert sorted((r.path.split("/")[-1], r.row_idx, r.x, r.z, r.classification) for r in got.collect()) == want
    assert got.columns == ["path", "drive_id", "frame_index", "row_idx", *fields]


def test_predicates_leave_files_unopened(spark, tmp_path):
    for drive in ("d0", "d1"):
        for frame in range(6):
            put(tmp_path, f"{drive}/{frame:010d}.las", tile(50, frame) if drive == "d1" and 2 <= frame <= 4 else b"broken")
    p = R.read_ranges(spark, str(tmp_path), ("x",))
    kept = p.where((F.col("drive_id") == "d1") & (F.col("frame_index") > 1) & F.col("frame_index").isin(2, 3, 4, 99) & (F.col("x") > 0))
    assert kept.rdd.getNumPartitions() == 3  # the three files that are opened
    assert kept.where("frame_index <= 3").select("frame_index").distinct().count() == 2
    with pytest.raises(Exception, match="no LAS file"):
        p.where("drive_id = 'd0'").count()


def test_float_records(spark, tmp_path):
    rows = np.arange(40, dtype="<f4").reshape(10, 4)
    put(tmp_path, "a/7.bin", rows.tobytes())
    put(tmp_path, "a/8.bin", b"")
    got = R.read_ranges(spark, str(tmp_path), ("x", "y", "z", "remission"), "float", 24)
    assert [tuple(r)[2:] for r in got.orderBy("row_idx").collect()] == [(7, k, *rows[k].tolist()) for k in range(10)]
    put(tmp_path, "a/9.bin", b"123")
    with pytest.raises(Exception, match="not whole records"):
        R.read_ranges(spark, str(tmp_path), ("x", "y", "z", "remission"), "float").count()


@pytest.mark.parametrize(("kind", "size", "version"), [(0, 20, 2), (1, 28, 3), (2, 26, 3), (3, 34, 3), (6, 30, 4), (7, 36, 4), (8, 38, 4), (6, 33, 4)])
def test_point_formats(spark, tmp_path, kind, size, version):
    n, head = 5, bytearray(375 if version == 4 else 227)
    head[:4], head[24:26], head[104] = b"LASF", bytes([1, version]), kind
    head[94:100] = len(head).to_bytes(2, "little") + len(head).to_bytes(4, "little")
    head[105:107] = size.to_bytes(2, "little")
    head[131:179] = np.array([0.01] * 3 + [100.0, 0.0, 0.0], "<f8").tobytes()
    if version == 4:
        head[247:255] = n.to_bytes(8, "little")
    else:
        head[107:111] = n.to_bytes(4, "little")
    layout = R.las_layout(bytes(head) + b"\0" * 200)
    rows = np.zeros(n, layout.record)
    rows["xyz"], rows["classification"] = np.arange(15).reshape(5, 3), [1, 2, 3, 31, 200 if kind >= 6 else 7]
    if "gps_time" in layout.record.names:
        rows["gps_time"] = np.arange(5) + 0.5
    put(tmp_path, "t/1.las", bytes(head) + rows.tobytes())
    got = R.read_ranges(spark, str(tmp_path), ("x", "classification", "gps_time"), range_bytes=50).orderBy("row_idx").collect()
    assert [r.classification for r in got] == rows["classification"].tolist() and [round(r.x, 6) for r in got] == [round(100 + 0.03 * k, 6) for k in range(5)]
    assert [r.gps_time for r in got] == ([k + 0.5 for k in range(5)] if kind not in (0, 2) else [0.0] * 5)
    put(tmp_path, "t/2.las", (bytes(head) + rows.tobytes())[:-1])
    with pytest.raises(Exception, match="fewer are there"):
        R.read_ranges(spark, str(tmp_path), ("x",)).count()


def test_unknown_file_systems_are_errors():
    with pytest.raises(Exception, match="(?i)scheme|filesystem|uri"):
        _Writer("nosuch://host/folder", ".bin")
    with pytest.raises(Exception, match="(?i)scheme|filesystem|uri"):
        R.RangeReader({"path": "nosuch://host/folder", "fields": "x"}).partitions()
    assert R.file_system("file:/tmp/x")[1] == "/tmp/x" == R.file_system("/tmp/x")[1]


def test_ranges_get_longer_rather_than_more(tmp_path):
    """3 MB in ranges of 24 bytes: every byte is in one range, and there are some hundred of them."""
    (tmp_path / "d1").mkdir()
    for k in range(3):
        (tmp_path / "d1" / f"{k}.bin").write_bytes(bytes(1_000_008))
    found = R.RangeReader({"path": str(tmp_path), "fields": "x,y,z", "format": "float", "rangeBytes": "24"}).partitions()
    assert len(found) <= R.TASKS + 3
    for path in {r.path for r in found}:
        own = [(r.low, r.high) for r in found if r.path == path]
        assert own[0][0] == 0 and own[-1][1] == 1_000_008 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
