"""Golden vectors of the library's operators, as small DataFrames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import geometry as G
from sweepframe.functions.numeric import ns_to_us, parse_timestamp_ns
from sweepframe.operators import boxes as B
from sweepframe.operators import metrics as M
from sweepframe.operators import points as P
from sweepframe.operators import voxels as V

POINT = "drive_id string, frame_index long, history_rank int, row_idx long, x float, y float, z float"


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_first_touch_pillars(spark):
    rows = [("d", 0, 0, 0, 0.10, 0.10, 0.0), ("d", 0, 1, 1, 1.10, 0.10, 0.0), ("d", 0, 2, 2, 0.20, 0.20, 0.0), ("d", 0, 2, 3, 2.10, 0.10, 0.0)]
    pillars = V.first_touch(spark.createDataFrame(rows, POINT), 2).orderBy("touch_rank").collect()
    assert [(p.cx, p.cy, p.first_sweep, p.retained) for p in pillars] == [(200, 200, 0, True), (204, 200, 1, True), (208, 200, 2, False)]


def test_points_outside_the_grid_are_left_out(spark):
    rows = [("d", 0, 0, 0, -50.1, 0.0, 0.0), ("d", 0, 0, 1, 49.9, 49.9, 0.0)]
    summary = V.pillar_summary(V.first_touch(spark.createDataFrame(rows, POINT), 5)).first()
    assert (summary.in_range_points, summary.candidates) == (1, 1)


def test_cell_index_rounds_in_single_precision(spark):
    rows = [("d", 0, 0, 0, -1e-9, 0.0, 0.0)]
    assert V.with_pillars(spark.createDataFrame(rows, POINT)).first().cx == 200


def test_cells_under_a_box(spark):
    box = spark.createDataFrame([("d", 0, 1, 0.25, 0.125, 0.25, 0.25, 0.0)], "drive_id string, frame_index long, track_id long, cx double, cy double, len double, wid double, yaw double")
    cells = {(r.px, r.py) for r in B.cells_of_boxes(box, 0.25).collect()}
    assert {(200, 200), (201, 200)} <= cells and (210, 210) not in cells


def test_regions(spark):
    for cell, want in {(240, 200): (0, 0, 0), (200, 240): (2, 0, 0), (60, 200): (5, 2, 1), (200, 60): (9, 1, 1)}.items():
        x, y = ((c + 0.5) * 0.25 - 50 for c in cell)
        r = one(spark, r=G.regions(F.lit(x), F.lit(y))).r
        assert (r.sector, r.quadrant, r.radial) == want


def test_count_metrics(spark):
    df = spark.createDataFrame([(2, 1, 2), (0, 0, 0)], "tp long, fp long, fn long")
    a, b = M.count_metrics(df).collect()
    assert a.precision == pytest.approx(2 / 3) and a.recall == 0.5 and a.f1 == pytest.approx(4 / 7) and b.f1 == 0


def test_average_precision(spark):
    r = spark.createDataFrame([("c", 0.8, "b", 0, False), ("c", 0.9, "a", 0, True), ("c", 0.8, "a", 1, True)], "k string, score double, frame string, idx int, tp boolean")
    n = spark.createDataFrame([("c", 2), ("none", 3)], "k string, n_truths long")
    out = {x.k: x.ap for x in M.average_precision(r, n, ["k"], ["frame", "idx"]).collect()}
    assert out == {"c": 1.0, "none": 0.0}


def test_longest_runs(spark):
    df = spark.createDataFrame([("o", i, h) for i, h in zip((10, 11, 13, 14, 15), (True, True, True, False, False), strict=True)], "o string, i int, hit boolean")
    r = M.longest_runs(df, ["o"], "i", "hit").first()
    assert (r.longest_hit, r.longest_miss) == (2, 2)


def test_homogeneity(spark):
    rows = [("even", k, 100, 1) for k in range(12)] + [("skew", k, 100, 80 if k == 0 else 20) for k in range(12)]
    out = {r.g: r for r in V.homogeneity(spark.createDataFrame(rows, "g string, k int, candidates long, discarded long"), ["g"]).collect()}
    assert not out["even"].adequate and out["even"].statistic is None and out["skew"].reject


def test_angles(spark):
    for a, want in ((0.0, 0.0), (math.pi, -math.pi), (-math.pi, -math.pi), (3 * math.pi, -math.pi)):
        assert one(spark, a=G.wrap(F.lit(a))).a == pytest.approx(want)


def test_oriented_iou(spark):
    def box(cx, yaw):
        return F.struct(F.lit(cx).alias("cx"), F.lit(0.0).alias("cy"), F.lit(4.0).alias("len"), F.lit(2.0).alias("wid"), F.lit(yaw).alias("yaw"))

    r = one(spark, same=G.oriented_iou(box(0.0, 0.3), box(0.0, 0.3)), far=G.oriented_iou(box(0.0, 0.0), box(10.0, 0.0)), turned=G.oriented_iou(box(0.0, 0.0), box(0.0, math.pi / 2)))
    assert r.same == pytest.approx(1) and r.far == 0 and r.turned == pytest.approx(1 / 3)


def test_greedy_matching(spark):
    kind = "drive_id string, frame_index long, class_name string, det_id long, score double, cx double, cy double, len double, wid double"
    dets = spark.createDataFrame([("d", 0, "Car", 0, 0.8, 0.0, 0.0, 4.0, 2.0), ("d", 0, "Car", 1, 0.9, 0.1, 0.0, 4.0, 2.0), ("d", 0, "Car", 2, 0.7, 20.0, 0.0, 4.0, 2.0), ("d", 0, "Car", 3, 0.6, 40.0, 0.0, 4.0, 2.0)], kind)
    box = "drive_id string, frame_index long, class_name string, track_id long, cx double, cy double, len double, wid double"
    targets = spark.createDataFrame([("d", 0, "Car", 5, 0.0, 0.0, 4.0, 2.0)], box)
    ignores = spark.createDataFrame([("d", 0, "Car", 6, 20.0, 0.0, 4.0, 2.0)], box)
    keys = ["drive_id", "frame_index", "class_name"]
    got = {r.det_id: r.disposition for r in B.match(dets, targets, ignores, keys, 0.5).collect()}
    assert got == {1: "true_positive", 0: "false_positive", 2: "ignored", 3: "false_positive"}
    n = B.match_counts(B.match(dets, targets, ignores, keys, 0.5), targets, keys).first()
    assert (n.tp, n.fp, n.ignored, n.fn) == (1, 2, 1, 0)


def test_grid_partition(spark):
    rows = [("t", 0, k, x, y, 0.0) for k, (x, y) in enumerate([(0.0, 0.0), (49.99, 49.99), (50.0, 0.0), (99.99, 50.0), (100.0, 100.0)])]
    r = P.grid_partition(spark.createDataFrame(rows, "drive_id string, frame_index long, row_idx long, x double, y double, z double"), 50.0).first()
    assert (r.rows * r.cols, r.empty, r.occupied, r.n_points) == (9, 5, 4, 5)


def test_unknown_labels(spark):
    out = P.map_labels(spark.createDataFrame([(1,), (5,), (99,)], "label int"), P.TILE_CLASSES).collect()
    assert sorted(r.shared_label for r in out) == [-1, -1, 0]


def test_times(spark):
    r = one(spark, ns=parse_timestamp_ns(F.lit("2011-09-26 13:02:25.964389445")), bad=parse_timestamp_ns(F.lit("2011-13-26 13:02:25.964389445")), us=ns_to_us(F.lit(-1)), now=ns_to_us(F.lit(1700000000123456999)))
    assert r.now == 1700000000123456 and r.ns % 1_000_000_000 == 964389445 and r.bad is None and r.us == -1


def test_ulp_distance(spark):
    x = np.float32(1.0)
    r = one(spark, d=G.ulp_distance(F.lit(float(x)).cast("float"), F.lit(float(np.nextafter(x, np.float32(2)))).cast("float")))
    assert r.d == 1


def test_permutation_invariance(spark):
    rows = [("d", 0, k % 3, k, float(k % 7), float(k % 5), 0.0) for k in range(60)]
    df = spark.createDataFrame(rows, POINT)
    a = V.hard_voxels(df, (2.0, 2.0, 4.0), 3, 5).orderBy("voxel_rank", "slot").collect()
    b = V.hard_voxels(df.repartition(7), (2.0, 2.0, 4.0), 3, 5).orderBy("voxel_rank", "slot").collect()
    assert [(r.voxel_rank, r.slot, r.row_idx) for r in a] == [(r.voxel_rank, r.slot, r.row_idx) for r in b]


def test_a_filter_on_visibility_keeps_the_plan_small(spark):
    """The filter is pushed down to the corners; no step may be repeated by that."""
    from sweepframe.functions.camera import with_visibility
    from sweepframe.plans.boxes import CAMERA

    df = spark.range(3).select("id", *((F.col("id") * 5.0).alias(c) for c in ("cx", "cy")))
    c = G.box_corners(F.col("cx"), F.col("cy"), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(1.5), F.lit(0.3))
    out = with_visibility(df.withColumn("corners", c), "corners", CAMERA).where("visible").select("id")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert {r.id for r in out.collect()} == {0, 1, 2} & {r.id for r in with_visibility(df.withColumn("corners", c), "corners", CAMERA).collect() if r.visible}


def test_first_mismatch_is_dealt_by_number_of_parts(spark):
    """Parts aren't put together by their size; null equals null, and a row that one side lacks differs."""
    from sweepframe.operators.fidelity import first_mismatch

    a = spark.createDataFrame([("d", 0, 1), ("d", 1, None), ("d", 2, 5), ("d", 3, 7)], "k string, i long, v int")
    b = spark.createDataFrame([("d", 0, 1), ("d", 1, None), ("d", 2, 6)], "k string, i long, v int")
    out = first_mismatch(a, b, ["k", "i"], ["v"], ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert [(r.rows, r.mismatches, r["first"].i) for r in out.collect()] == [(4, 2, 2)]
