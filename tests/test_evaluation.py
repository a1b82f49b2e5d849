"""Clipping, quaternions, and matches at several thresholds against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sweepframe.functions import geometry as G
from sweepframe.operators import evaluation as E


def rotations(n, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        q = r.normal(size=4) * ([1, 1, 1, 1], [0.01, 5, 1, 1], [0.01, 1, 5, 1], [0.01, 1, 1, 5])[k % 4]
        w, x, y, z = q / np.linalg.norm(q)
        out.append((np.array([w, x, y, z]), np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])))
    return out


def test_quaternions_of_all_branches(spark):
    made = rotations(80)
    made += [(None, np.diag(d)) for d in ([1.0, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1])]
    branches = Counter(0 if np.trace(m) > 0 else 1 + int(np.argmax(np.diag(m))) for _, m in made)
    assert set(branches) == {0, 1, 2, 3}
    df = spark.createDataFrame([(k, m.astype(float).ravel().tolist()) for k, (_, m) in enumerate(made)], "k long, m array<double>")
    got = {r.k: np.array(r.q) for r in df.select("k", F.array(*G.rotation_quaternion(F.col("m"), 3)).alias("q")).collect()}
    for k, (q, m) in enumerate(made):
        assert abs(np.linalg.norm(got[k]) - 1) < 1e-12
        if q is not None:
            assert min(np.abs(got[k] - q).max(), np.abs(got[k] + q).max()) < 1e-9
    back = df.select("k", F.array(*G.quaternion_entries(*G.rotation_quaternion(F.col("m"), 3))).alias("r")).collect()
    assert all(np.abs(np.array(r.r) - made[r.k][1].ravel()).max() < 1e-9 for r in back)


def test_distances(spark):
    rows = []
    for (p, _), (q, _) in zip(rotations(40, 2), rotations(40, 3), strict=True):
        rows.append((p.tolist(), q.tolist(), 2 * math.acos(min(1.0, abs(float(p @ q))))))
        rows.append((p.tolist(), (-p).tolist(), 0.0))
    for tiny in (1e-6, 1e-9, 1e-12, 0.0):
        rows.append(([1.0, 0.0, 0.0, 0.0], [-math.cos(tiny / 2), 0.0, -math.sin(tiny / 2), 0.0], tiny))
    df = spark.createDataFrame(rows, "p array<double>, q array<double>, want double")
    d = G.rotation_distance(*([F.col(c)[k] for k in range(4)] for c in "pq"))
    for r in df.select(d.alias("got"), "want").collect():
        assert abs(r.got - r.want) < (1e-15 if 0 < r.want < 1e-5 else 1e-7)


def corners(b):
    c, s = math.cos(b[4]), math.sin(b[4])
    return [(b[0] + u * c - v * s, b[1] + u * s + v * c) for u, v in ((b[2] / 2, b[3] / 2), (-b[2] / 2, b[3] / 2), (-b[2] / 2, -b[3] / 2), (b[2] / 2, -b[3] / 2))]


def plain_iou(a, b, n=400):
    """By counting the cells of a fine grid over the first box."""
    u, v = (np.arange(n) + 0.5) / n - 0.5, (np.arange(n) + 0.5) / n - 0.5
    x, y = np.meshgrid(u * a[2], v * a[3])
    gx, gy = a[0] + x * math.cos(a[4]) - y * math.sin(a[4]) - b[0], a[1] + x * math.sin(a[4]) + y * math.cos(a[4]) - b[1]
    inside = (np.abs(gx * math.cos(b[4]) + gy * math.sin(b[4])) <= b[2] / 2) & (np.abs(gy * math.cos(b[4]) - gx * math.sin(b[4])) <= b[3] / 2)
    both = inside.mean() * a[2] * a[3]
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_both_variants_of_oriented_overlap(spark):
    r = random.Random(4)
    cases = [((0, 0, 4, 2, 0), (0, 0, 4, 2, 0), 1.0), ((0, 0, 4, 2, 0), (4, 0, 4, 2, 0), 0.0), ((0, 0, 4, 2, 0), (0, 0, 2, 1, 0), 0.25), ((0, 0, 4, 2, 0.3), (0, 0, 2, 1, 0.3), 0.25), ((0, 0, 2, 2, 0), (0, 0, 2, 2, math.pi / 4), None),
             ((0, 0, 4, 2, 0), (0, 0, 2, 4, math.pi / 2), 1.0), ((0, 0, 4, 2, 0), (9, 9, 4, 2, 1), 0.0), ((0, 0, 4, 2, 0), (4, 2, 4, 2, 0), 0.0), ((0, 0, 4, 2, 0), (2, 0, 4, 2, 0), 1 / 3), ((0, 0, 0, 2, 0), (0, 0, 0, 2, 0), 0.0)]
    cases += [((0, 0, r.uniform(1, 5), r.uniform(1, 3), r.uniform(-4, 4)), (r.uniform(-2, 2), r.uniform(-2, 2), r.uniform(1, 5), r.uniform(1, 3), r.uniform(-4, 4)), None) for _ in range(40)]
    box = "struct<cx:double,cy:double,len:double,wid:double,yaw:double>"
    df = spark.createDataFrame([(k, tuple(map(float, a)), tuple(map(float, b))) for k, (a, b, _) in enumerate(cases)], f"k long, a {box}, b {box}")
    got = {x.k: x for x in df.select("k", G.clipped_iou(F.col("a"), F.col("b")).alias("c"), G.oriented_iou(F.col("a"), F.col("b")).alias("o")).collect()}
    for k, (a, b, want) in enumerate(cases):
        if want is not None:
            assert abs(got[k].c - want) < 1e-9
        elif a[2] * b[2] > 0:
            assert abs(got[k].c - plain_iou(a, b)) < 5e-3
        assert abs(got[k].c - got[k].o) < 1e-9


def plain_matches(dets, boxes, thresholds, least):
    """dets: (det_id, score, {track_id: iou}); boxes: track_id to (role, kind)."""
    out = Counter()
    for t in thresholds:
        free = {k for k, (role, _) in boxes.items() if role == "target"}
        for det, score, near in sorted(dets, key=lambda d: (-d[1], d[0])):
            if score < least:
                continue
            best = sorted(((-v, k) for k, v in near.items() if k in free))
            others = sorted((-v, boxes[k][1]) for k, v in near.items() if boxes[k][0] != "target")
            if best and -best[0][0] >= t:
                free.remove(best[0][1])
                out[t, det, best[0][1], "true_positive", None] += 1
            elif others and -others[0][0] >= t:
                out[t, det, None, "ignored", others[0][1]] += 1
            else:
                out[t, det, None, "false_positive", None] += 1
    return out


def test_dispositions_equal_plain_version():
    r = random.Random(9)
    for _ in range(60):
        boxes = {k: ("target", "Car") if k % 3 else ("neighbour_ignore", r.choice(["Van", "Bus"])) for k in range(r.randint(0, 7))}
        dets = [(d, round(r.random(), 1), {k: round(r.random(), 1) for k in boxes if r.random() < 0.5}) for d in range(r.randint(1, 9))]
        dets = [(d, s, {k: v for k, v in n.items() if v > 0}) for d, s, n in dets]
        rows = [(d, s, k, *boxes[k], v) for d, s, n in dets for k, v in n.items()] + [(d, s, None, None, None, None) for d, s, n in dets if not n]
        frame = pd.DataFrame(rows, columns=["det_id", "score", "track_id", "role", "object_type", "iou"])
        got = Counter((t, d, k, disposition, reason) for t, d, _, k, _, disposition, reason in E.dispositions(frame, [0.3, 0.5, 0.7]))
        assert got == plain_matches(dets, boxes, [0.3, 0.5, 0.7], 0.0)


def test_parity_partners_equal_plain_version():
    from sweepframe.operators.boxes import best_partners

    r = random.Random(3)
    for _ in range(60):
        pairs = {(a, b): round(r.uniform(0.5, 1), 1) for a in range(r.randint(1, 6)) for b in range(r.randint(1, 6)) if r.random() < 0.7}
        if not pairs:
            continue
        frame = pd.DataFrame([(100 + a, 200 + b, v, a + 1, b + 1) for (a, b), v in pairs.items()], columns=["det_id", "other_id", "iou", "place", "other_place"]).sample(frac=1, random_state=1)
        free, want = {b for _, b in pairs}, []
        for a in sorted({a for a, _ in pairs}):
            options = sorted((-v, b) for (x, b), v in pairs.items() if x == a and b in free)
            if options:
                free.remove(options[0][1])
                want.append((100 + a, 200 + options[0][1], -options[0][0]))
        assert [tuple(x) for x in best_partners(frame).itertuples(index=False)] == want


def test_track_report_matches_once(spark):
    from sweepframe.plans import evaluation as PE

    plan = PE.agg_20(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "CoGroup" in PE.tracks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
