"""The matching kernel of groups against plain searches of all pairs, and matches of detections with other targets than their own."""

import importlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import geometry as G
from sweepframe.operators import boxes as B
from sweepframe.operators import evaluation as E
from sweepframe.operators import matching as K


def made(n, seed, copies=3):
    r = np.random.default_rng(seed)
    rows = np.column_stack([r.uniform(-9, 9, (n, 2)).round(1), r.choice([1.0, 2.0, 4.0, 30.0], n, p=[0.3, 0.3, 0.35, 0.05]), r.choice([1.0, 2.0], n), r.choice([0.0, 0.4, 1.9], n)])
    return np.concatenate([rows] * copies)[r.permutation(n * copies)]


@pytest.mark.parametrize("least", [0.0, 0.5])
@pytest.mark.parametrize("measure", [G.aligned_overlap, G.oriented_overlap, G.clipped_overlap])
def test_near_classes_are_all_pairs(measure, least):
    a, b = made(40, 1, 1), made(50, 2, 1)
    b[:30] = a[:30] + [0.1, 0.0, 0.0, 0.0, 0.1]
    a[3, 0], b[4, 1] = np.nan, np.inf
    aligned = measure is G.aligned_overlap
    i, j, v = K.near_classes(a[:, :4] if aligned else a, b[:, :4] if aligned else b, measure if aligned else G.screened(measure, least), least)
    x, y = (k.ravel() for k in np.meshgrid(np.delete(np.arange(40), 3), np.delete(np.arange(50), 4), indexing="ij"))
    w = measure(a[x], b[y])
    keep = (w > 0) & (w >= least)
    assert dict(zip(zip(i.tolist(), j.tolist()), v.tolist())) == dict(zip(zip(x[keep].tolist(), y[keep].tolist()), w[keep].tolist()))
    assert len(i) == keep.sum() > 20


def test_evaluation_takes_the_best_of_all_pairs(spark):
    r = random.Random(5)
    a, b = made(30, 3), made(12, 4)
    b[:20] = a[:20] + [0.1, 0.0, 0.0, 0.0, 0.1]
    roles = [r.choice([("target", "Car"), ("target", "Car"), ("neighbour_ignore", "Van"), ("neighbour_ignore", "Bus")]) for _ in b]
    scores = [round(r.random(), 1) for _ in a]
    d = spark.createDataFrame([("f", k, s, *map(float, x)) for k, (s, x) in enumerate(zip(scores, a, strict=True))], "frame string, det_id long, score double, cx double, cy double, len double, wid double, yaw double")
    g = spark.createDataFrame([("f", k, *n, *map(float, x)) for k, (n, x) in enumerate(zip(roles, b, strict=True))], "frame string, track_id long, role string, object_type string, cx double, cy double, len double, wid double, yaw double")
    for oriented, measure in ((False, G.aligned_overlap), (True, G.oriented_overlap), (True, G.clipped_overlap)):
        rows = []
        for k, x in enumerate(a):
            if scores[k] >= 0.25:
                v = measure(np.repeat(x[None, :], len(b), 0), b)
                rows += [(k, scores[k], t, *roles[t], v[t]) for t in range(len(b)) if v[t] > 0] or [(k, scores[k], None, None, None, None)]
        want = Counter(E.dispositions(pd.DataFrame(rows, columns=["det_id", "score", "track_id", "role", "object_type", "iou"]), [0.3, 0.5]))
        got = E.matches(d, g, ["frame"], [0.3, 0.5], oriented, measure=measure)
        assert Counter(tuple(x) for x in got.select(*E.RECORD).collect()) == want
        assert {k[5] for k in want} == {"true_positive", "ignored", "false_positive"}


@pytest.mark.parametrize("oriented", [False, True])
def test_greedy_matches_hand_no_pairs_to_a_shuffle(spark, oriented):
    r = np.random.default_rng(11)
    a, b = made(30, 3), made(12, 4)
    b[:30] = a[:30] + [0.1, 0.0, 0.0, 0.0, 0.1]
    scores = r.random(len(a)).round(1)
    target = r.random(len(b)) < 0.6
    dets = [("f", k, float(s), *map(float, x)) for k, (s, x) in enumerate(zip(scores, a, strict=True))]
    dets += [dets[0], (None, 500, 0.5, *dets[0][3:]), ("g", 501, 0.5, *dets[0][3:]), ("f", 502, None, *dets[1][3:]), ("f", 503, 0.9, None, *dets[1][4:])]
    boxes = [("f", k, *map(float, x)) for k, x in enumerate(b)]
    boxes += [(None, 900, *boxes[0][2:]), ("h", 901, *boxes[0][2:])]
    columns = "cx double, cy double, len double, wid double, yaw double"
    d = spark.createDataFrame(dets, f"frame string, det_id long, score double, {columns}")
    own, other = (spark.createDataFrame([x for k, x in enumerate(boxes) if k >= len(b) or target[k] == t], f"frame string, track_id long, {columns}") for t in (True, False))
    measure = G.oriented_overlap if oriented else G.aligned_overlap
    rows = []
    for f, k, s, *x in dict.fromkeys(dets):
        v = measure(np.repeat(np.array(x, float)[None, :], len(b), 0), b) if f == "f" and None not in x else np.zeros(len(b))
        near = [(f, k, s, t, v[t], max(0.0, *v[~target])) for t in range(len(b)) if v[t] > 0 and target[t]]
        rows += near or [(f, k, s, None, None, max(0.0, *v[~target]))]
    rows = pd.DataFrame(rows, columns=["frame", "det_id", "score", "track_id", "iou", "ignore_iou"])
    want = Counter()
    for f, g in rows.groupby("frame", dropna=False):
        want.update((None if f != f else f, *(None if v is None or v != v else v for v in x)) for x in B.greedy(g, 0.5).itertuples(index=False, name=None))
    got = B.match(d, own, other, ["frame"], 0.5, oriented)
    assert Counter(map(tuple, got.collect())) == want
    kinds = Counter(k[5] for k in want)
    assert sum(kinds.values()) == len(dets) - 1 and min(kinds[k] for k in ("true_positive", "ignored", "false_positive")) > 2
    assert any(k[5] == "ignored" and 0 < k[4] < 0.5 for k in want)
    assert "Join" not in got._jdf.queryExecution().toString()


def test_parity_takes_the_best_of_all_pairs(spark):
    a = made(25, 6)
    b = np.concatenate([a[10:] + [0.1, 0.0, 0.0, 0.0, 0.1], made(5, 7)])
    kind = "frame string, det_id long, score double, object_type string, cx double, cy double, len double, wid double, yaw double"
    frames = [spark.createDataFrame([("f", k + at, 1.0 - k / 100, "Car", *map(float, x)) for k, x in enumerate(rows)], kind) for rows, at in ((a, 0), (b, 500))]
    for oriented, measure in ((False, G.aligned_overlap), (True, G.oriented_overlap)):
        v = [measure(np.repeat(x[None, :], len(b), 0), b) for x in a]
        rows = [(k, 500 + t, w[t], k + 1, t + 1) for k, w in enumerate(v) for t in range(len(b)) if w[t] >= 0.5]
        pairs = list(B.best_partners(pd.DataFrame(rows, columns=["det_id", "other_id", "iou", "place", "other_place"])).itertuples(index=False, name=None))
        got = B.parity_matches(*frames, ["frame", "object_type"], 0.5, oriented).collect()
        assert sorted((x.det_id, x.other_id, x.iou) for x in got if x.kind == "match") == sorted(pairs) and len(pairs) > 10
        assert {x.det_id for x in got if x.kind == "missing"} == set(range(len(a))) - {p[0] for p in pairs}
        assert {x.other_id for x in got if x.kind == "extra"} == set(range(500, 500 + len(b))) - {p[1] for p in pairs}


def test_an_item_of_several_places_is_taken_once():
    items = np.array([[0.0, 0, 4, 2], [0.5, 0, 4, 2], [9.0, 0, 4, 2]])
    taken, _ = K.Near(np.zeros((3, 4)) + [0, 0, 4, 2], items, np.array([0, 0, 1]), G.aligned_overlap).take(np.arange(3), 0.5)
    assert taken == [0, -1, -1]


def test_errors_of_a_detection_of_another_target(spark, tmp_path):
    """Two targets at one place: the better detection belongs to the second, and takes the first."""
    c = duckdb.connect()
    c.sql("CREATE TABLE customer AS SELECT k AS c_custkey, 'n' AS c_name, 0 AS c_nationkey, 1.0 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM (VALUES (7::BIGINT), (7::BIGINT + 60 * 41 * 43)) v(k)")
    c.sql("CREATE TABLE orders AS SELECT k AS o_orderkey, u AS o_custkey, 'O' AS o_orderstatus, p AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, '1' AS o_orderpriority FROM (VALUES (30::BIGINT, 7::BIGINT + 60 * 41 * 43, 400000.0::DOUBLE), (45::BIGINT, 7::BIGINT, 300000.0::DOUBLE)) v(k, u, p)")
    for t in ("customer", "orders"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    entry = importlib.import_module("__spark_entry__")
    name = "agg_16_error_distributions"
    df = entry.queries()[name](spark, str(tmp_path))
    want = c.sql(entry.oracle_sql()[name])
    rows = Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in want.fetchall())
    assert Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect()) == rows
    assert sum(rows.values()) == 10


def test_clipped_area_of_columns_and_arrays(spark):
    a, b = made(60, 8, 1), made(60, 9, 1)
    b[:, :2] = a[:, :2] + b[:, :2] / 6
    box = "struct<cx:double,cy:double,len:double,wid:double,yaw:double>"
    df = spark.createDataFrame([(k, tuple(map(float, x)), tuple(map(float, y))) for k, (x, y) in enumerate(zip(a, b, strict=True))], f"k long, a {box}, b {box}")
    p, q = (G.corners(*(F.col(f"{n}.{c}") for c in ("cx", "cy", "len", "wid", "yaw"))) for n in "ab")
    got = df.select("k", G.polygon_area(G.clipped(p, q)).alias("both"), G.clipped_iou(F.col("a"), F.col("b")).alias("iou")).collect()
    for r in got:
        union = a[r.k, 2] * a[r.k, 3] + b[r.k, 2] * b[r.k, 3] - r.both
        assert abs(r.iou - r.both / union) < 1e-9
    assert sum(r.iou > 0 for r in got) > 20


@pytest.mark.parametrize("oriented", [False, True])
def test_pairs_of_equal_footprints_are_measured_once(spark, oriented, monkeypatch):
    r = np.random.default_rng(5)
    place = ["cx", "cy", "len", "wid", "yaw"]
    shapes = [[float(x), float(y), 4.0, 2.0, float(k * math.pi / 8)] for x, y, k in r.integers(0, 7, (30, 3))]
    dets = [("a", "Car", d, d / 100, *shapes[d % 20]) for d in range(60)] + [(None, "Car", 60, 0.5, *shapes[0]), ("a", "Car", 61, 0.5, None, *shapes[0][1:]), ("b", "Car", 62, 0.5, *shapes[0]), ("a", "Car", None, 0.5, *shapes[1])]
    boxes = [("a", "Car", 1000 + t, *shapes[t % 30]) for t in range(90)] + [(None, "Car", 2000, *shapes[0]), ("c", "Car", 2001, *shapes[0])]
    columns = ", ".join(f"{c} double" for c in place)
    d, b = spark.createDataFrame(dets, f"drive string, class_name string, det_id long, score double, {columns}"), spark.createDataFrame(boxes, f"drive string, class_name string, track_id long, {columns}")
    n = 5 if oriented else 4
    measure = G.oriented_overlap if oriented else G.aligned_overlap
    want = Counter()
    for drive, _, det, score, *p in dets:
        for other, _, track, *q in boxes:
            if drive and drive == other and None not in p:
                v = float(measure(np.array([p[:n]]), np.array([q[:n]]))[0])
                want.update([(drive, "Car", det, score, track, v)] if v > 0 else [])
    df = B.pairs(d, b, ["drive", "class_name"], oriented)
    assert Counter(map(tuple, df.collect())) == want and len(want) > 1000
    assert "Join" not in df._jdf.queryExecution().toString()
    # The kernel itself: blocks are bounded, and 400 copies on either side are one measured pair.
    monkeypatch.setattr(K, "BLOCK", 1000)
    seen = []
    one = np.array([shapes[0][:n]] * 400)
    blocks = list(K.near_rows(one, one, lambda x, y: seen.append(len(x)) or measure(x, y)))
    assert sum(seen) == 1 and max(len(i) for i, _, _ in blocks) == 1000
    assert {(i, j) for x, y, _ in blocks for i, j in zip(x.tolist(), y.tolist(), strict=True)} == {(i, j) for i in range(400) for j in range(400)}


def test_clipped_areas_beyond_one_part():
    """Overlaps of many pairs equal those of each alone, by the plain cutting of polygons too."""
    r = np.random.default_rng(6)
    n = 9000
    a, b = (np.stack([r.integers(-6, 7, n) / 4, r.integers(-6, 7, n) / 4, r.choice([2.0, 4.0], n), r.choice([1.0, 2.0], n), r.integers(0, 16, n) * (math.pi / 8)], axis=1) for _ in range(2))
    got = G.oriented_overlap(a, b)
    assert np.abs(got - G.clipped_overlap(a, b)).max() < 1e-9
    assert all(got[k] == G.oriented_overlap(a[k : k + 1], b[k : k + 1])[0] for k in (*range(600), *range(4000, 4200), n - 1))
