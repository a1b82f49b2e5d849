"""Queries that accept or reject a second backend: matches, errors, counts, gates and review flags."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.operators import acceptance as A
from sweepframe.operators import boxes as B
from sweepframe.plans.boxes import IOU
from sweepframe.plans.fixtures import CAND, FRAME, LOGITS, candidates, detections, logits
from sweepframe.registry import query

FR = "drive_id, frame_index"


def matches_sql(a, b):
    """SQL of mt AS (det_id, other_id) and no AS (missing and extra ones): the greedy matches of two tables of detections by frame and class, a detection at a time."""
    return f"""pa AS (SELECT *, row_number() OVER (PARTITION BY {FR}, object_type ORDER BY score DESC, cx, cy, len, wid, det_id) AS n FROM {a}), pb AS (SELECT *, row_number() OVER (PARTITION BY {FR}, object_type ORDER BY score DESC, cx, cy, len, wid, det_id) AS n FROM {b}),
pn AS (SELECT p.det_id, {IOU} / (p.len * p.wid + g.len * g.wid - {IOU}) AS iou, g.det_id AS other, g.n AS place FROM pa p JOIN pb g ON p.drive_id = g.drive_id AND p.frame_index = g.frame_index AND p.object_type = g.object_type WHERE {IOU} > 0),
pl AS (SELECT det_id, list({{'o': other, 'i': iou}} ORDER BY iou DESC, place) AS near FROM pn WHERE iou >= 0.5 GROUP BY det_id), ln AS (SELECT pa.{FR.replace(", ", ", pa.")}, pa.object_type, pa.det_id, pa.n, near FROM pa LEFT JOIN pl USING (det_id)),
mw AS (SELECT DISTINCT {FR}, object_type, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS det_id, NULL::BIGINT AS other, NULL::DOUBLE AS iou FROM ln
  UNION ALL SELECT drive_id, frame_index, object_type, n, CASE WHEN best IS NOT NULL THEN list_append(taken, best.o) ELSE taken END, det_id, best.o, best.i FROM (SELECT w.drive_id, w.frame_index, w.object_type, l.n, w.taken, l.det_id, list_filter(l.near, lambda x: NOT list_contains(w.taken, x.o))[1] AS best
    FROM mw w JOIN ln l ON l.drive_id = w.drive_id AND l.frame_index = w.frame_index AND l.object_type = w.object_type AND l.n = w.n + 1)),
mt AS (SELECT det_id, other AS other_id, iou FROM mw WHERE other IS NOT NULL),
no AS (SELECT det_id, NULL::BIGINT AS other_id, 'missing' AS kind FROM {a} ANTI JOIN mt USING (det_id) UNION ALL SELECT NULL, x.det_id, 'extra' FROM {b} x ANTI JOIN mt ON mt.other_id = x.det_id)"""


FULL = f"""{CAND}, a AS (SELECT *, (det_id % 4) * 0.1::DOUBLE AS cz, 1.5::DOUBLE AS hgt, (track_id % 16) * pi() / 8 AS yaw FROM det),
b AS (SELECT * REPLACE (CASE WHEN det_id % 97 = 0 THEN 'Truck' ELSE object_type END AS object_type, len * (1 + (det_id % 5) * 0.01::DOUBLE) AS len), (det_id % 4) * 0.1::DOUBLE + CASE WHEN det_id % 3 = 0 THEN 0.02::DOUBLE ELSE 0 END AS cz, 1.5::DOUBLE + (det_id % 2) * 0.03::DOUBLE AS hgt,
  (track_id % 16) * pi() / 8 + 0.01::DOUBLE + CASE WHEN det_id % 40 = 0 THEN pi() ELSE 0 END AS yaw FROM cand WHERE det_id % 29 <> 0),
{matches_sql("a", "b")}, turn AS (SELECT a.det_id, abs((a.yaw - b.yaw + 3 * pi()) % (2 * pi()) - pi()) AS t FROM a JOIN mt ON mt.det_id = a.det_id JOIN b ON b.det_id = mt.other_id),
m AS (SELECT a.drive_id, a.frame_index, a.det_id, b.det_id AS other_id, a.object_type, a.score, b.score AS other_score, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS xy_error, abs(a.cz - b.cz) AS z_error, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) AS error_3d,
  abs(a.len - b.len) / a.len AS length_error, abs(a.wid - b.wid) / a.wid AS width_error, abs(a.hgt - b.hgt) / a.hgt AS height_error, degrees(t) AS yaw_degrees, degrees(least(t, pi() - t)) AS axis_degrees, t > pi() / 2 AS flip,
  abs(a.score - b.score) AS score_error, a.object_type = b.object_type AS class_equal, a.score >= 0.3 OR b.score >= 0.3 AS high FROM a JOIN mt ON mt.det_id = a.det_id JOIN b ON b.det_id = mt.other_id JOIN turn ON turn.det_id = a.det_id),
mm AS (SELECT *, greatest(length_error, width_error, height_error) AS size_error FROM m)"""


def first(s, d):
    return detections(s, d).withColumns({"cz": (F.col("det_id") % 4) * 0.1, "hgt": F.lit(1.5), "yaw": (F.col("track_id") % 16) * (math.pi / 8)})


def second(s, d):
    """The second backend: some boxes moved, turned, renamed or missing."""
    k, yaw = F.col("det_id"), (F.col("track_id") % 16) * (math.pi / 8)
    return candidates(s, d).where(k % 29 != 0).withColumns({
        "object_type": F.when(k % 97 == 0, "Truck").otherwise(F.col("object_type")), "len": F.col("len") * ((k % 5) * 0.01 + 1), "cz": (k % 4) * 0.1 + F.when(k % 3 == 0, 0.02).otherwise(0.0),
        "hgt": (k % 2) * 0.03 + 1.5, "yaw": yaw + 0.01 + F.when(k % 40 == 0, math.pi).otherwise(0.0),
    })


def matches(s, d):
    """Of upright footprints, so that the SQL can follow; jn_14_parity_matches has the oriented ones."""
    return B.parity_matches(first(s, d), second(s, d), [*FRAME, "object_type"], 0.5, oriented=False)


def errors(s, d):
    return A.matched_errors(first(s, d), second(s, d), FRAME, matches(s, d))


def samples(s, d):
    return A.sample_parity(first(s, d), second(s, d), FRAME)


LARGEST = {"xy": 1.5, "z": 0.05, "size": 0.05, "yaw": 2.0, "score": 0.01}
SHARES = {"xy": 0.05, "z": 0.01, "size": 0.025, "score": 0.01, "axis": 1.0}


@query("jn_14_parity_matches")
def jn_14(s, d):
    return B.parity_matches(first(s, d), second(s, d), [*FRAME, "object_type"], 0.5)


@query("jn_14_upright_matches", f"WITH RECURSIVE {FULL} SELECT det_id, other_id, round(iou, 6) AS iou, 'match' AS kind FROM mt UNION ALL SELECT det_id, other_id, NULL, kind FROM no")
def jn_14_upright(s, d):
    return matches(s, d).select("det_id", "other_id", F.round("iou", 6).alias("iou"), "kind")


@query("geo_20_pair_errors", f"WITH RECURSIVE {FULL} SELECT det_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('xy_error', 'z_error', 'error_3d', 'length_error', 'width_error', 'height_error', 'yaw_degrees', 'axis_degrees', 'score_error'))}, flip, class_equal FROM m")
def geo_20(s, d):
    rounded = ("xy_error", "z_error", "error_3d", "length_error", "width_error", "height_error", "yaw_degrees", "axis_degrees", "score_error")
    return errors(s, d).select("det_id", *(F.round(c, 6).alias(c) for c in rounded), "flip", "class_equal")


def _side(p: str) -> str:
    return f"""{p}c AS (SELECT {FR}, object_type, count(*) AS n, count(*) FILTER (score >= 0.25) AS e, count(*) FILTER (score >= 0.3) AS h FROM {p} GROUP BY ALL),
{p}s AS (SELECT {FR}, sum(n) AS raw_{p}, sum(e) AS exported_{p}, sum(h) AS high_{p}, coalesce(string_agg(CASE WHEN e > 0 THEN object_type || '=' || e END, ',' ORDER BY object_type || '=' || e), '') AS classes_{p} FROM {p}c GROUP BY ALL)"""


SAMPLES = f"""{FULL}, {_side("a")}, {_side("b")},
s AS (SELECT {FR}, {', '.join(f"CAST(coalesce({k}_{p}, 0) AS BIGINT) AS {k}_{p}" for k in ("raw", "exported", "high") for p in "ab")}, coalesce(classes_a, '') AS classes_a, coalesce(classes_b, '') AS classes_b FROM "as" FULL JOIN bs USING (drive_id, frame_index)),
p AS (SELECT *, abs(exported_a - exported_b) AS difference, CAST(greatest(1, ceil(exported_a * 0.05)) AS BIGINT) AS allowed FROM s)""".replace("as AS (SELECT drive_id", '"as" AS (SELECT drive_id')


@query("agg_31_sample_parity", f"WITH RECURSIVE {SAMPLES} SELECT *, difference <= allowed AS within FROM p")
def agg_31(s, d):
    return samples(s, d)


TOTALS = f"""{SAMPLES}, t AS (SELECT bool_and(difference <= allowed) AS sample_counts, sum(exported_a) AS ea, sum(exported_b) AS eb, sum(high_a) AS ha, sum(high_b) AS hb FROM p),
g AS (SELECT sample_counts, abs(eb - ea) / ea <= 0.02 AS total_counts, (SELECT count(*) FILTER (score >= 0.3) FROM mm) / ha >= 0.99 AS coverage_a, (SELECT count(*) FILTER (other_score >= 0.3) FROM mm) / hb >= 0.99 AS coverage_b FROM t)"""
_TEN = ["coverage_a", "coverage_b", "xy", "z", "size", "yaw", "score", "classes", "sample_counts", "total_counts"]


@query("agg_32_acceptance", f"""WITH RECURSIVE {TOTALS}, c AS (SELECT max(xy_error) <= 1.5 AS xy, max(z_error) <= 0.05 AS z, max(size_error) <= 0.05 AS size, max(yaw_degrees) <= 2 AS yaw, max(score_error) <= 0.01 AS score, bool_and(class_equal) AS classes FROM mm WHERE high)
SELECT {', '.join(_TEN)}, {' AND '.join(_TEN)} AS accepted FROM g, c""")
def agg_32(s, d):
    return A.by_largest_error(samples(s, d), errors(s, d), LARGEST)


_ELEVEN = ["sample_counts", "total_counts", "coverage_a", "coverage_b", "xy", "z", "size", "score", "axis", "direction", "classes"]
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {k} THEN '{k}' END" for k in _ELEVEN) + ")"
_OUT = "xy_error > 0.05 OR z_error > 0.01 OR size_error > 0.025 OR score_error > 0.01 OR axis_degrees > 1"
SHARED = f"""{TOTALS}, c AS (SELECT {', '.join(f"avg(CAST({c} <= {SHARES[n]} AS INT)) >= 0.95 AS {n}" for n, c in (("xy", "xy_error"), ("z", "z_error"), ("size", "size_error"), ("score", "score_error"), ("axis", "axis_degrees")))},
  avg(CAST(NOT flip AS INT)) >= 0.99 AS direction, bool_and(class_equal) AS classes, count(*) FILTER ({_OUT}) AS n_outliers FROM mm WHERE high),
r AS (SELECT {', '.join(_ELEVEN)}, n_outliers, {_FAILED} AS failed FROM g, c)"""


@query("agg_33_acceptance_failures", f"WITH RECURSIVE {SHARED} SELECT *, CASE WHEN failed = '' THEN 'accept' WHEN sample_counts AND total_counts AND coverage_a AND coverage_b AND direction AND classes THEN 'review' ELSE 'reject' END AS next FROM r")
def agg_33(s, d):
    return A.by_pass_fraction(samples(s, d), errors(s, d), SHARES)


@query("agg_33_outliers", f"WITH RECURSIVE {FULL} SELECT det_id, object_type, flip, concat_ws(',', CASE WHEN xy_error > 0.05 THEN 'xy' END, CASE WHEN z_error > 0.01 THEN 'z' END, CASE WHEN size_error > 0.025 THEN 'size' END, CASE WHEN score_error > 0.01 THEN 'score' END, CASE WHEN axis_degrees > 1 THEN 'axis' END) AS failed FROM mm WHERE high AND ({_OUT})")
def agg_33_outliers(s, d):
    return A.outliers(errors(s, d), SHARES).select("det_id", "object_type", "flip", F.array_join("failed", ",").alias("failed"))


@query("agg_53_verdict", f"""WITH RECURSIVE {SHARED}, {LOGITS.replace('logits AS', 'lg AS')}, u AS (SELECT abs(unnest(reference) - unnest(candidate)) AS e FROM lg), z AS (SELECT bool_and(len(reference) = len(candidate)) AS shapes FROM lg), y AS (SELECT max(e) <= 10 AS arrays FROM u)
SELECT sample_counts, failed = '' AS accepted, shapes, arrays, sample_counts AND failed = '' AND shapes AND arrays AS equivalent FROM r, z, y""")
def agg_53(s, d):
    gates = A.by_pass_fraction(samples(s, d), errors(s, d), SHARES).select("sample_counts", (F.col("next") == "accept").alias("accepted"), F.lit(1).alias("_"))
    same = F.size("reference") == F.size("candidate")
    largest = F.array_max(F.zip_with("reference", "candidate", lambda a, b: F.abs(a - b)))
    arrays = logits(s, d).agg(F.bool_and(same).alias("shapes"), (F.max(F.when(same, largest)) <= 10).alias("arrays")).withColumn("_", F.lit(1))
    return gates.join(arrays, "_").drop("_").withColumn("equivalent", F.forall(F.array("sample_counts", "accepted", "shapes", "arrays"), lambda x: x))


_KINDS = {"native": "view", "native_network": "click", "fast": "purchase", "fast_network": "error"}


@query("prj_25_review_flags", f"""WITH q AS (SELECT user_id % 64 AS sample, {', '.join(f"median(value) FILTER (event_type = '{t}') AS {n}, quantile_cont(value, 0.95) FILTER (event_type = '{t}') AS {n}_p95" for n, t in _KINDS.items())} FROM events WHERE value > 0 GROUP BY ALL)
SELECT sample, concat_ws(',', CASE WHEN native > 2 * 20 THEN 'native_over_2x_history' END, CASE WHEN native / fast > 10 THEN 'end_to_end_over_10x' END, CASE WHEN native_network / fast_network > 10 THEN 'network_over_10x' END, CASE WHEN native_p95 > 2 * native THEN 'native_p95_over_2x' END,
  CASE WHEN fast_p95 > 2 * fast THEN 'fast_p95_over_2x' END, CASE WHEN native < native_network THEN 'native_below_network' END, CASE WHEN fast < fast_network THEN 'fast_below_network' END) AS flags FROM q""")
def prj_25(s, d):
    def of(kind, stat):
        return stat(F.when(F.col("event_type") == kind, F.col("value")))

    stats = {n: of(t, F.median) for n, t in _KINDS.items()} | {f"{n}_p95": of(_KINDS[n], lambda v: F.percentile(v, F.lit(0.95))) for n in ("native", "fast")}
    q = s.read.parquet(f"{d}/events.parquet").where("value > 0").groupBy((F.col("user_id") % 64).alias("sample")).agg(*(v.alias(k) for k, v in stats.items()))
    flags = A.review_flags(*(F.col(c) for c in ("native", "native_network", "native_p95", "fast", "fast_network", "fast_p95")), history=20.0)
    return q.select("sample", F.array_join(flags, ",").alias("flags"))


@query("prj_26_divergence_class", f"""WITH RECURSIVE {FULL}, ra AS (SELECT det_id, row_number() OVER (PARTITION BY {FR} ORDER BY score DESC, det_id) AS k FROM a), rb AS (SELECT det_id, row_number() OVER (PARTITION BY {FR} ORDER BY score DESC, det_id) AS k FROM b),
o AS (SELECT a.*, other_id, class_equal, flip FROM (SELECT det_id, other_id, class_equal, flip, xy_error FROM mm) JOIN a USING (det_id) WHERE xy_error > 0.5),
near AS (SELECT o.det_id, o.other_id, b.det_id AS other, round((o.cx - b.cx) ** 2 + (o.cy - b.cy) ** 2, 6) AS dist FROM o JOIN b ON o.drive_id = b.drive_id AND o.frame_index = b.frame_index AND o.object_type = b.object_type AND abs(o.cx - b.cx) < 2 AND abs(o.cy - b.cy) < 2),
ev AS (SELECT det_id, count(*) FILTER (other <> other_id) > 0 AS overlap, arg_min(other, {{'d': dist, 'o': other}}) <> any_value(other_id) AS survivors FROM near GROUP BY det_id)
SELECT o.det_id, CASE WHEN class_equal AND coalesce(overlap, false) AND coalesce(survivors, false) AND ra.k <> rb.k THEN 'confirmed_swap' WHEN flip OR NOT class_equal THEN 'other_divergence' ELSE 'unexplained' END AS kind FROM o JOIN ra USING (det_id) JOIN rb ON rb.det_id = o.other_id LEFT JOIN ev USING (det_id)""")
def prj_26(s, d):
    a, b = first(s, d), second(s, d)
    w = Window.partitionBy(*FRAME).orderBy(F.desc("score"), "det_id")
    places = a.select("det_id", F.row_number().over(w).alias("ka")), b.select(F.col("det_id").alias("other_id"), F.row_number().over(w).alias("kb"))
    o = a.join(errors(s, d).where("xy_error > 0.5").select("det_id", "other_id", "class_equal", "flip"), "det_id")
    near = o.alias("o").join(b.alias("b"), [*FRAME, "object_type"]).where((F.abs(F.col("o.cx") - F.col("b.cx")) < 2) & (F.abs(F.col("o.cy") - F.col("b.cy")) < 2))
    near = near.select(F.col("o.det_id").alias("det_id"), "o.other_id", F.col("b.det_id").alias("other"), F.round((F.col("o.cx") - F.col("b.cx")) ** 2 + (F.col("o.cy") - F.col("b.cy")) ** 2, 6).alias("dist"))
    evidence = near.groupBy("det_id").agg((F.count_if(F.col("other") != F.col("other_id")) > 0).alias("overlap"), (F.min_by("other", F.struct("dist", "other")) != F.first("other_id")).alias("survivors"))
    out = o.join(places[0], "det_id").join(places[1], "other_id").join(evidence, "det_id", "left").fillna(False, ["overlap", "survivors"])
    return out.select("det_id", A.divergence(F.col("class_equal"), F.col("overlap"), F.col("survivors"), F.col("ka") != F.col("kb"), F.col("flip") | ~F.col("class_equal")).alias("kind"))
