"""Walks along pointers, picks of frames and SQL functions."""

import math

from sweepframe.functions.sql import FUNCTIONS, register
from sweepframe.operators.poses import previous_walk
from sweepframe.operators.selection import reconstruction_frames


def walked(spark, rows, depth):
    out = {}
    for r in sorted(previous_walk(spark, spark.createDataFrame(rows, "id string, prev string"), depth).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.previous)
    return out


def test_walk_ends_at_cycles_missing_links_and_depth(spark):
    chain = [("a", None), ("b", "a"), ("c", "b"), ("d", "c")]
    assert walked(spark, chain, 2) == {"b": ["a"], "c": ["b", "a"], "d": ["c", "b"]}
    assert walked(spark, chain, 9)["d"] == ["c", "b", "a"]
    assert walked(spark, [("a", "c"), ("b", "a"), ("c", "b")], 9) == {"a": ["c", "b"], "b": ["a", "c"], "c": ["b", "a"]}
    assert walked(spark, [("a", "gone"), ("b", "a"), ("s", "s")], 9) == {"b": ["a"]}
    assert walked(spark, [], 3) == {}


def plain_frames(motion):
    last = max(motion)
    taken = {0, 1, 2, 5, 10} | {11 + r * (last - 11) // 15 for r in range(16)}
    ranked = sorted((v, k) for k, v in motion.items() if k >= 11)
    middle = sorted(range(len(ranked)), key=lambda r: (abs(2 * r - (len(ranked) - 1)), ranked[r][1]))
    for order in (ranked, [ranked[r] for r in middle], ranked[::-1]):
        taken.add(next(k for _, k in order if k not in taken))
    return taken


def test_reconstruction_frames(spark):
    drives = {"a": {k: (k * 37 % 11) / 10 for k in range(60)}, "b": {k: 1.0 for k in range(40)}, "c": {k: math.sin(k) for k in range(200)}}
    df = spark.createDataFrame([(d, k, v) for d, m in drives.items() for k, v in m.items()], "drive_id string, frame_index long, motion double")
    rows = reconstruction_frames(df).collect()
    for d, m in drives.items():
        own = [r.frame_index for r in rows if r.drive_id == d]
        assert len(own) == 24 and set(own) == plain_frames(m)


def test_sql_functions(spark):
    assert register(spark) == list(FUNCTIONS)
    row = spark.sql("SELECT wrap_angle(7.0D) AS w, heading_difference(3.1D, -3.1D) AS h, axis_difference(0.1D, 3.1D) AS a, cell_index(-49.9D, -50.0D, 0.25D) AS c, stamp_ns(5, 7) AS n").first()
    assert abs(row.w - (7 - 2 * math.pi)) < 1e-12 and abs(row.h - math.degrees(2 * math.pi - 6.2)) < 1e-9 and abs(row.a - math.degrees(math.pi - 3.0)) < 1e-9 and (row.c, row.n) == (0, 5_000_000_007)
    assert "pmod(" in spark.sql("SELECT wrap_angle(id) FROM range(9)")._jdf.queryExecution().executedPlan().toString()
