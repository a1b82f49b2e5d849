"""Queries on boxes and detections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sweepframe.functions import geometry as G
from sweepframe.operators import boxes as B
from sweepframe.operators import metrics as M
from sweepframe.plans.fixtures import CAND, DET, FRAME, GT, candidates, detections, ground_truth
from sweepframe.registry import query

FR = "drive_id, frame_index"
KEYS = [*FRAME, "class_name"]
ROLE = "CASE object_type WHEN 'Car' THEN 'target' WHEN 'Pedestrian' THEN 'target' WHEN 'Van' THEN 'neighbour_ignore' WHEN 'Person (sitting)' THEN 'neighbour_ignore' ELSE 'unmapped' END"
CLASS = "CASE object_type WHEN 'Car' THEN 'Car' WHEN 'Van' THEN 'Car' WHEN 'Pedestrian' THEN 'Pedestrian' WHEN 'Person (sitting)' THEN 'Pedestrian' END"


def yaw_of_track():
    """A direction for each box; made when a query runs, as columns need a session."""
    return F.pmod("track_id", F.lit(16)) * (math.pi / 8)


def named(df):
    return df.withColumn("role", B.role(F.col("object_type"))).withColumn("class_name", B.class_name(F.col("object_type")))


def scored(s, d):
    """Detections of evaluated classes."""
    return named(detections(s, d)).where("class_name is not null")


@query("prj_9_score_threshold", f"WITH {DET} SELECT det_id, score, CAST(0.5 AS DOUBLE) AS score_threshold FROM det WHERE score >= 0.5")
def prj_9(s, d):
    return detections(s, d).where("score >= 0.5D").select("det_id", "score", F.lit(0.5).alias("score_threshold"))


@query("prj_10_invalid_detections", f"WITH {DET}, x AS (SELECT det_id, score * 1.5 - 0.1 AS score, len - det_id % 5 AS len, wid, CASE WHEN det_id % 11 = 0 THEN '' ELSE object_type END AS name FROM det) SELECT det_id, CASE WHEN score < 0 OR score > 1 THEN 'score_range' WHEN len <= 0 OR wid <= 0 THEN 'size' WHEN name = '' THEN 'class' END AS reason FROM x")
def prj_10(s, d):
    name = F.when(F.col("det_id") % 11 == 0, "").otherwise(F.col("object_type"))
    return detections(s, d).select("det_id", B.invalid_reason(F.col("score") * 1.5 - 0.1, F.col("len") - F.col("det_id") % 5, F.col("wid"), name).alias("reason"))


@query("prj_11_class_names", f"WITH {DET}, c(class_id, name) AS (VALUES (0, 'Car'), (1, 'Pedestrian'), (2, 'Van')) SELECT det_id, name, CASE WHEN det_id % 2 = 0 THEN cx END AS vx FROM det JOIN c ON det_id % 3 = class_id")
def prj_11(s, d):
    classes = s.createDataFrame([(0, "Car"), (1, "Pedestrian"), (2, "Van")], "class_id long, name string")
    box = F.when(F.col("det_id") % 2 == 0, F.array("cx", "cy", "len", "wid", "cx", "cy", "cx", "cx", "cy")).otherwise(F.array("cx", "cy", "len", "wid"))
    rows = detections(s, d).withColumn("class_id", F.col("det_id") % 3).withColumn("box", box)
    return rows.join(F.broadcast(classes), "class_id").select("det_id", "name", F.when(F.size("box") >= 9, F.get("box", F.lit(7))).alias("vx"))


@query("prj_17_eligibility", f"WITH {GT} SELECT track_id, state = 2 AND occlusion IN (0, 1) AND truncation IN (0, 1) AS eligible FROM gt")
def prj_17(s, d):
    return ground_truth(s, d).select("track_id", B.eligible(F.col("state"), F.col("occlusion"), F.col("truncation")).alias("eligible"))


@query("prj_18_roles", f"WITH {GT} SELECT track_id, {ROLE} AS role, {CLASS} AS class_name FROM gt")
def prj_18(s, d):
    return named(ground_truth(s, d)).select("track_id", "role", "class_name")


#: A camera ahead of the origin that looks along y; its projected depth is 0.3 m less than the distance.
CAMERA = {"p": [700.0, 0, 600, 0, 0, 700, 180, 0, 0, 0, 1, -0.3], "e": [1.0, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1], "width": 1242.0, "height": 375.0, "near": 0.1}
_SIGNS = ", ".join(f"({k + 4 * up}, {sx}, {sy}, {up - 0.5})" for up in (0, 1) for k, (sx, sy) in enumerate(((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))))
_EDGES = ", ".join(f"({a}, {b})" for k in range(4) for a, b in ((k, (k + 1) % 4), (4 + k, 4 + (k + 1) % 4), (k, 4 + k)))


def corner_sql(source, key):
    """SQL of corner AS (key, k, x, y, z) for boxes of 1.5 m height around z = 0."""
    return f"""corner AS (SELECT {key}, k, cx + len * sx * cos(yaw) - wid * sy * sin(yaw) AS x, cy + len * sx * sin(yaw) + wid * sy * cos(yaw) AS y, 1.5::DOUBLE * sz AS z
  FROM (SELECT *, (track_id % 16) * pi() / 8 AS yaw FROM {source}), (VALUES {_SIGNS}) v(k, sx, sy, sz))"""


def visible_sql(source, key):
    return f"""{corner_sql(source, key)}, seen AS (SELECT {key}, k, x, -z AS y, y AS z FROM corner),
place AS (SELECT {key}, x, y, z FROM seen WHERE z >= 0.1 UNION ALL SELECT a.{key}, a.x + t * (b.x - a.x), a.y + t * (b.y - a.y), a.z + t * (b.z - a.z) FROM (VALUES {_EDGES}) e(i, j) JOIN seen a ON a.k = i JOIN seen b ON b.k = j AND a.{key} = b.{key},
  LATERAL (SELECT (0.1 - a.z) / (b.z - a.z) AS t) WHERE (a.z >= 0.1) <> (b.z >= 0.1)),
flat AS (SELECT {key}, (700 * x + 600 * z) / (z - 0.3) AS u, (700 * y + 180 * z) / (z - 0.3) AS v FROM place WHERE z > 0.3),
vis AS (SELECT {key}, max(u) >= 0 AND min(u) < 1242 AND max(v) >= 0 AND min(v) < 375 AS visible FROM flat GROUP BY {key})"""


def seen_boxes(df):
    from sweepframe.functions.camera import with_visibility

    c = G.box_corners(F.col("cx"), F.col("cy"), F.lit(0.0), F.col("len"), F.col("wid"), F.lit(1.5), yaw_of_track())
    return with_visibility(df.withColumn("corners", c), "corners", CAMERA).drop("corners")


@query("prj_19_eligible_targets", f"WITH {GT}, {visible_sql('gt', 'track_id')} SELECT {FR}, count(*) AS n FROM gt JOIN vis USING (track_id) WHERE visible AND state = 2 AND occlusion IN (0, 1) AND truncation IN (0, 1) AND {ROLE} <> 'unmapped' GROUP BY ALL")
def prj_19(s, d):
    g = seen_boxes(named(ground_truth(s, d)).where(B.eligible(F.col("state"), F.col("occlusion"), F.col("truncation")) & (F.col("role") != "unmapped")))
    return g.where("visible").groupBy(*FRAME).agg(F.count("*").alias("n"))


@query("prj_20_field_of_view", f"WITH {DET}, {visible_sql('det', 'det_id')} SELECT det_id, coalesce(visible, false) AS in_fov FROM det LEFT JOIN vis USING (det_id)")
def prj_20(s, d):
    return seen_boxes(detections(s, d)).select("det_id", F.col("visible").alias("in_fov"))


@query("prj_21_model_boxes", f"WITH {GT} SELECT track_id, -cy AS x, cx AS y, 0.75::DOUBLE AS z, len AS length, wid AS width, round((yaw + pi() / 2 + pi()) % (2 * pi()) - pi(), 6) + 0 AS yaw FROM (SELECT *, (track_id % 15) * 0.3::DOUBLE AS yaw FROM gt)")
def prj_21(s, d):
    x, y, z, length, width, _, yaw = B.model_box(F.col("cx"), F.col("cy"), F.lit(0.0), F.lit(1.5), F.col("wid"), F.col("len"), (F.col("track_id") % 15) * 0.3)
    return ground_truth(s, d).select("track_id", x.alias("x"), y.alias("y"), z.alias("z"), length.alias("length"), width.alias("width"), (F.round(yaw, 6) + 0.0).alias("yaw"))


@query("prj_22_threshold_edge", f"WITH {DET} SELECT det_id FROM det WHERE score BETWEEN 0.20::DOUBLE AND 0.30::DOUBLE")
def prj_22(s, d):
    return detections(s, d).where(F.col("score").between(0.20, 0.30)).select("det_id")


IOU = """greatest(0, least(p.cx + p.len / 2, g.cx + g.len / 2) - greatest(p.cx - p.len / 2, g.cx - g.len / 2)) * greatest(0, least(p.cy + p.wid / 2, g.cy + g.wid / 2) - greatest(p.cy - p.wid / 2, g.cy - g.wid / 2))"""
PAIRS = f"""{DET}, pairs AS (SELECT p.drive_id, p.frame_index, {CLASS.replace('object_type', 'p.object_type')} AS class_name, det_id, g.track_id, {IOU} / (p.len * p.wid + g.len * g.wid - {IOU}) AS iou
  FROM det p JOIN gt g ON p.drive_id = g.drive_id AND p.frame_index = g.frame_index AND {CLASS.replace('object_type', 'p.object_type')} = g.object_type WHERE {IOU} > 0)"""


def targets(s, d):
    return named(ground_truth(s, d)).where("role = 'target'")


def ignores(s, d):
    return named(ground_truth(s, d)).where("role = 'neighbour_ignore'")


@query("jn_12_iou_pairs", f"WITH {PAIRS} SELECT {FR}, class_name, det_id, track_id, round(iou, 6) AS iou FROM pairs")
def jn_12(s, d):
    return B.pairs(scored(s, d), targets(s, d), KEYS).select(*KEYS, "det_id", "track_id", F.round("iou", 6).alias("iou"))


@query("jn_12_oriented_pairs")
def jn_12o(s, d):
    return B.pairs(scored(s, d).withColumn("yaw", yaw_of_track()), targets(s, d).withColumn("yaw", yaw_of_track()), KEYS, oriented=True)


@query("jn_13_greedy_matches")
def jn_13(s, d):
    return B.match(scored(s, d), targets(s, d), ignores(s, d), KEYS, 0.5)


@query("jn_13_single_target_frames", f"""WITH {PAIRS}, one AS (SELECT {FR}, object_type AS class_name FROM gt WHERE object_type IN ('Car', 'Pedestrian') GROUP BY ALL HAVING count(*) = 1),
hit AS (SELECT {FR}, class_name, max(iou) >= 0.5 AS hit FROM pairs JOIN one USING (drive_id, frame_index, class_name) GROUP BY ALL)
SELECT {FR}, class_name, CAST(coalesce(hit, false) AS BIGINT) AS tp FROM one LEFT JOIN hit USING (drive_id, frame_index, class_name)""")
def jn_13_single(s, d):
    one = targets(s, d).groupBy(*KEYS).agg(F.count("*").alias("n")).where("n = 1").select(*KEYS)
    records = B.match(scored(s, d).join(one, KEYS, "left_semi"), targets(s, d).join(one, KEYS, "left_semi"), ignores(s, d), KEYS, 0.5)
    hits = records.where("disposition = 'true_positive'").groupBy(*KEYS).agg(F.count("*").alias("tp"))
    return one.join(hits, KEYS, "left").fillna(0)


@query("jn_15_ignore_reasons", f"""WITH {DET}, near AS (SELECT p.det_id, g.object_type, {IOU} / (p.len * p.wid + g.len * g.wid - {IOU}) AS iou FROM det p JOIN gt g ON p.drive_id = g.drive_id AND p.frame_index = g.frame_index
  AND {CLASS.replace('object_type', 'p.object_type')} = {CLASS.replace('object_type', 'g.object_type')} AND g.object_type IN ('Van', 'Person (sitting)') WHERE {IOU} > 0)
SELECT det_id, object_type AS reason FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, object_type) AS k FROM near) WHERE k = 1""")
def jn_15(s, d):
    kinds = ignores(s, d)
    near = B.pairs(scored(s, d), kinds, KEYS).join(kinds.select(*FRAME, "track_id", "object_type"), [*FRAME, "track_id"])
    best = near.groupBy("det_id", "object_type").agg(F.max("iou").alias("iou"))
    top = best.groupBy("det_id").agg(F.max("iou").alias("top"))
    return best.join(top, "det_id").where("iou = top").groupBy("det_id").agg(F.min("object_type").alias("reason"))


@query("win_3_average_precision", f"""WITH {DET}, r AS (SELECT object_type, score, det_id, det_id % 3 <> 0 AS tp FROM det), n AS (SELECT object_type, count(*) AS n_truths FROM det GROUP BY object_type),
c AS (SELECT *, sum(CAST(tp AS INT)) OVER w / row_number() OVER w AS precision FROM r WINDOW w AS (PARTITION BY object_type ORDER BY score DESC, det_id)),
e AS (SELECT *, max(precision) OVER (PARTITION BY object_type ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c)
SELECT object_type, sum(CASE WHEN tp THEN env ELSE 0 END) / max(n_truths) AS ap FROM e JOIN n USING (object_type) GROUP BY object_type""")
def win_3(s, d):
    det = detections(s, d).withColumn("tp", F.col("det_id") % 3 != 0)
    return M.average_precision(det.select("object_type", "score", "det_id", "tp"), det.groupBy("object_type").agg(F.count("*").alias("n_truths")), ["object_type"], ["det_id"])


@query("agg_37_drive_census", f"WITH {GT} SELECT drive_id, count(*) FILTER (state = 2) AS valid_poses, count(DISTINCT track_id) AS tracks, count(DISTINCT frame_index) AS labelled_frames, max(frame_index) AS last_frame, count(*) AS poses FROM gt GROUP BY drive_id")
def agg_37(s, d):
    return ground_truth(s, d).groupBy("drive_id").agg(F.count_if(F.col("state") == 2).alias("valid_poses"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("frame_index").alias("labelled_frames"), F.max("frame_index").alias("last_frame"), F.count("*").alias("poses"))


@query("sel_3_drive_choice", f"WITH {GT} SELECT drive_id FROM gt GROUP BY drive_id ORDER BY count(*) FILTER (state = 2) DESC, count(DISTINCT track_id) DESC, count(DISTINCT frame_index) DESC, drive_id LIMIT 1")
def sel_3(s, d):
    return agg_37(s, d).orderBy(F.desc("valid_poses"), F.desc("tracks"), F.desc("labelled_frames"), "drive_id").limit(1).select("drive_id")


@query("agg_38_drive_records", f"WITH {GT} SELECT {FR}, object_type, count(*) FILTER (state = 2 AND occlusion IN (0, 1) AND truncation IN (0, 1)) AS eligible FROM gt WHERE frame_index >= 10 GROUP BY ALL")
def agg_38(s, d):
    return ground_truth(s, d).where("frame_index >= 10").groupBy(*FRAME, "object_type").agg(F.count_if(B.eligible(F.col("state"), F.col("occlusion"), F.col("truncation"))).alias("eligible"))


@query("agg_39_annotation_contract", f"WITH {GT} SELECT object_type, occlusion, truncation, state, count(*) AS n FROM gt GROUP BY GROUPING SETS ((object_type), (occlusion), (truncation), (state))")
def agg_39(s, d):
    ground_truth(s, d).createOrReplaceTempView("_annotations")
    return s.sql("SELECT object_type, occlusion, truncation, state, count(*) AS n FROM _annotations GROUP BY GROUPING SETS ((object_type), (occlusion), (truncation), (state))")


@query("snk_3_message_records", f"WITH {DET}, f AS (SELECT DISTINCT {FR} FROM gt) SELECT {FR}, count(det_id) AS detections, round(coalesce(sum(sin(score / 2)), 0), 6) AS z, round(coalesce(sum(cos(score / 2)), 0), 6) AS w FROM f LEFT JOIN det USING (drive_id, frame_index) GROUP BY ALL")
def snk_3(s, d):
    from sweepframe.sources.sinks import detection_messages

    out = detection_messages(detections(s, d).withColumn("yaw", F.col("score")), ground_truth(s, d).select(*FRAME).distinct(), FRAME)

    def total(c):
        return F.round(F.aggregate("detections", F.lit(0.0), lambda a, x: a + x["orientation"][c]), 6)

    return out.select(*FRAME, F.size("detections").cast("long").alias("detections"), total("z").alias("z"), total("w").alias("w"))


@query("snk_4_markers", f"WITH {DET} SELECT {FR}, kind, count(*) AS n FROM (SELECT {FR}, unnest(['box', 'label']) AS kind FROM det UNION ALL SELECT DISTINCT {FR}, 'delete_all' FROM det) GROUP BY ALL")
def snk_4(s, d):
    from sweepframe.sources.sinks import markers

    return markers(detections(s, d), FRAME).groupBy(*FRAME, "kind").agg(F.count("*").alias("n"))


LEDGER = f"""{DET}, expected AS (SELECT DISTINCT {FR}, condition FROM gt, (VALUES ('H10'), ('H5')) v(condition)),
entries AS (SELECT {FR}, CASE WHEN det_id % 2 = 0 THEN 'H10' ELSE 'H5' END AS condition, det_id AS seq, CASE WHEN score > 0.9 THEN 'COMPLETE' WHEN frame_index = 7 AND det_id % 2 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status, 'run-1' AS identity FROM det WHERE score > 0.55),
st AS (SELECT {FR}, condition, coalesce(status, 'PENDING') AS status FROM expected LEFT JOIN (SELECT {FR}, condition, arg_max(status, {{'c': status = 'COMPLETE', 's': seq}}) AS status FROM entries GROUP BY ALL) USING (drive_id, frame_index, condition))"""


def ledger(s, d):
    from sweepframe.sources.sinks import ledger_states

    expected = ground_truth(s, d).select(*FRAME).distinct().withColumn("condition", F.explode(F.array(F.lit("H10"), F.lit("H5"))))
    even = F.col("det_id") % 2 == 0
    status = F.when(F.col("score") > 0.9, "COMPLETE").when((F.col("frame_index") == 7) & even, "FAILED").otherwise("RUNNING")
    entries = detections(s, d).where("score > 0.55D").select(*FRAME, F.when(even, "H10").otherwise("H5").alias("condition"), F.col("det_id").alias("seq"), status.alias("status"), F.lit("run-1").alias("identity"))
    return ledger_states(expected, entries, [*FRAME, "condition"])


@query("snk_6_ledger", f"WITH {LEDGER} SELECT condition, status, count(*) AS n FROM st GROUP BY ALL")
def snk_6(s, d):
    from sweepframe.sources.sinks import ledger_totals

    return ledger_totals(ledger(s, d))


@query("snk_6_resumable", f"WITH {LEDGER} SELECT {FR}, condition FROM st WHERE status IN ('PENDING', 'RUNNING') AND condition NOT IN (SELECT condition FROM st WHERE status = 'FAILED')")
def snk_6_resumable(s, d):
    from sweepframe.sources.sinks import resumable

    return resumable(ledger(s, d), [*FRAME, "condition"], "run-1")


@query("sel_1_canonical_order", f"WITH {DET} SELECT {FR}, det_id, row_number() OVER (PARTITION BY {FR} ORDER BY score DESC, object_type, cx, cy, len, wid, det_id) AS place FROM det")
def sel_1(s, d):
    from pyspark.sql.window import Window

    return detections(s, d).select(*FRAME, "det_id", F.row_number().over(Window.partitionBy(*FRAME).orderBy(*B.detection_order())).alias("place"))


@query("sel_12_first_sample", f"WITH {DET} SELECT {FR}, count(*) AS n, max(score) AS best FROM det WHERE object_type = 'Pedestrian' AND score >= 0.8 GROUP BY ALL ORDER BY drive_id, frame_index LIMIT 1")
def sel_12(s, d):
    return detections(s, d).where("object_type = 'Pedestrian' and score >= 0.8D").groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("score").alias("best")).orderBy(*FRAME).limit(1)


@query("geo_5_corners", f"WITH {GT}, y AS (SELECT *, (track_id % 16) * pi() / 8 AS yaw FROM gt) SELECT track_id, round(cx + 2 * cos(yaw) - sin(yaw), 6) AS x0, round(cy + 2 * sin(yaw) + cos(yaw), 6) AS y0, round(cx - 2 * cos(yaw) + sin(yaw), 6) AS x2, round(cy - 2 * sin(yaw) - cos(yaw), 6) AS y2 FROM y")
def geo_5(s, d):
    c = G.corners(F.col("cx"), F.col("cy"), F.col("len"), F.col("wid"), yaw_of_track())
    return ground_truth(s, d).select("track_id", c.alias("c")).select("track_id", *(F.round(F.col("c")[k][a], 6).alias(f"{a}{k}") for k in (0, 2) for a in "xy"))


@query("geo_6_oriented_iou")
def geo_6(s, d):
    g = ground_truth(s, d)
    box = {k: F.struct((F.col("cx") + k).alias("cx"), "cy", "len", "wid", (yaw_of_track() * k).alias("yaw")) for k in (0.0, 1.0)}
    return g.select("track_id", G.oriented_iou(box[0.0], box[1.0]).alias("iou"))


@query("geo_7_box_corners", f"WITH {GT}, {corner_sql('gt', 'track_id')} SELECT track_id, k, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) AS z FROM corner")
def geo_7(s, d):
    c = G.box_corners(F.col("cx"), F.col("cy"), F.lit(0.0), F.col("len"), F.col("wid"), F.lit(1.5), yaw_of_track())
    return ground_truth(s, d).select("track_id", F.posexplode(c).alias("k", "c")).select("track_id", "k", *((F.round(F.col(f"c.{n}"), 6) + 0.0).alias(n) for n in "xyz"))


@query("geo_8_native_corners", f"WITH {GT}, {corner_sql('gt', 'track_id')} SELECT track_id, k, round(y, 6) + 0 AS x, round(-x, 6) + 0 AS y, round(z, 6) AS z FROM corner")
def geo_8(s, d):
    model = G.box_corners(F.col("cx"), F.col("cy"), F.lit(0.0), F.col("len"), F.col("wid"), F.lit(1.5), yaw_of_track())
    out = ground_truth(s, d).select("track_id", model.alias("model")).select("track_id", F.posexplode(G.native_corners(F.col("model"))).alias("k", "c"))
    return out.select("track_id", "k", *((F.round(F.col(f"c.{n}"), 6) + 0.0).alias(n) for n in "xyz"))


@query("geo_9_camera_visibility", f"WITH {GT}, {visible_sql('gt', 'track_id')} SELECT track_id, coalesce(visible, false) AS visible FROM gt LEFT JOIN vis USING (track_id)")
def geo_9(s, d):
    return seen_boxes(ground_truth(s, d)).select("track_id", "visible")


@query("geo_12_footprint_cells", f"""WITH {GT}, b AS (SELECT track_id, cx + 0.123::DOUBLE AS cx, cy + 0.077::DOUBLE AS cy, len, wid, (track_id % 16) * pi() / 8 + 0.05::DOUBLE AS yaw FROM gt WHERE abs(cx) < 40 AND abs(cy) < 40), g AS (SELECT *, px * 2.0::DOUBLE - 49 AS x, py * 2.0::DOUBLE - 49 AS y FROM b, range(0, 50) r(px), range(0, 50) q(py) WHERE abs(px * 2.0 - 49 - cx) < 5 AND abs(py * 2.0 - 49 - cy) < 5)
SELECT track_id, count(*) AS cells FROM g WHERE abs(x - cx) <= len / 2 * abs(cos(yaw)) + wid / 2 * abs(sin(yaw)) + 1 AND abs(y - cy) <= len / 2 * abs(sin(yaw)) + wid / 2 * abs(cos(yaw)) + 1
  AND abs((x - cx) * cos(yaw) + (y - cy) * sin(yaw)) <= len / 2 + abs(cos(yaw)) + abs(sin(yaw)) AND abs((y - cy) * cos(yaw) - (x - cx) * sin(yaw)) <= wid / 2 + abs(cos(yaw)) + abs(sin(yaw)) GROUP BY track_id""")
def geo_12(s, d):
    """Cells of two metres that an oriented footprint touches, by the separating axes of both."""
    b = ground_truth(s, d).where("abs(cx) < 40 and abs(cy) < 40").withColumns({"cx": F.col("cx") + 0.123, "cy": F.col("cy") + 0.077, "yaw": yaw_of_track() + 0.05})
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-3, 4) for j in range(-3, 4)))
    g = b.withColumn("n", F.explode(near)).select("track_id", "cx", "cy", "len", "wid", "yaw", *(((F.floor((F.col(f"c{a}") + 50) / 2) + F.col(f"n.{k}")) * 2.0 - 49.0).alias(f"g{a}") for a, k in (("x", "i"), ("y", "j"))))
    return g.where(G.axes_overlap(F.col("cx"), F.col("cy"), F.col("len"), F.col("wid"), F.col("yaw"), F.col("gx"), F.col("gy"), 1.0)).groupBy("track_id").agg(F.count("*").alias("cells"))


@query("geo_1_4_angles", f"WITH {GT}, a AS (SELECT track_id, (track_id % 37) * 0.4::DOUBLE AS a, (track_id % 11) * 0.7::DOUBLE AS b FROM gt), w AS (SELECT *, abs((((a - b + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi()) AS e FROM a) SELECT track_id, round((a + pi()) % (2 * pi()) - pi(), 6) AS wrapped, round(e, 6) AS yaw_error, round(degrees(e), 6) AS heading, e > pi() / 2 AS flip, round(degrees(least(e, pi() - e)), 6) AS axis FROM w")
def geo_1(s, d):
    a, b = (F.col("track_id") % 37) * 0.4, (F.col("track_id") % 11) * 0.7
    return ground_truth(s, d).select("track_id", F.round(G.wrap(a), 6).alias("wrapped"), F.round(G.yaw_error(a, b), 6).alias("yaw_error"), F.round(G.heading_degrees(a, b), 6).alias("heading"), G.is_flip(a, b).alias("flip"), F.round(G.axis_degrees(a, b), 6).alias("axis"))


@query("geo_13_yaw_quaternion", f"WITH {GT} SELECT track_id, round(sin(track_id % 16 * pi() / 16), 6) AS z, round(cos(track_id % 16 * pi() / 16), 6) AS w FROM gt")
def geo_13(s, d):
    q = G.yaw_quaternion(yaw_of_track())
    return ground_truth(s, d).select("track_id", F.round(q["z"], 6).alias("z"), F.round(q["w"], 6).alias("w"))


@query("jsn_1_canonical_json", f"WITH {DET} SELECT det_id, to_json({{'class': object_type, 'id': det_id}}) AS body FROM det")
def jsn_1(s, d):
    return detections(s, d).select("det_id", F.to_json(F.struct(F.col("object_type").alias("class"), F.col("det_id").alias("id"))).alias("body"))


PICKS = f"""WITH {DET}, f AS (SELECT {FR}, count(*) AS n, greatest(0, count(*) - 60) AS lost, max(score) AS recall, median(score) FILTER (score > 0.9) AS iou, max(score) FILTER (det_id % 2 = 0) AS paired FROM det GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY round(recall, 6), coalesce(iou, -1), drive_id, frame_index) AS k, row_number() OVER (ORDER BY round(recall, 6) DESC, coalesce(iou, -1) DESC, drive_id, frame_index) AS b, row_number() OVER (ORDER BY lost DESC, drive_id, frame_index) AS h,
  row_number() OVER (ORDER BY round(abs(recall - coalesce(paired, 0)), 6) DESC, drive_id, frame_index) AS p, count(*) OVER () AS c FROM f),
x AS (SELECT *, row_number() OVER (ORDER BY abs(n - (SELECT n FROM o WHERE h = 1)), drive_id, frame_index) AS near FROM o WHERE lost = 0)
SELECT drive_id, frame_index, 'best' AS pick FROM o WHERE b = 1 UNION ALL SELECT drive_id, frame_index, 'worst' FROM o WHERE k = 1 UNION ALL SELECT drive_id, frame_index, 'median' FROM o WHERE k = (c - 1) // 2 + 1 UNION ALL SELECT drive_id, frame_index, 'overflow' FROM o WHERE h = 1
UNION ALL SELECT drive_id, frame_index, 'no_overflow' FROM x WHERE near = 1 UNION ALL SELECT drive_id, frame_index, 'paired' FROM o WHERE p = 1"""


@query("sel_11_display_picks", PICKS)
def sel_11(s, d):
    from sweepframe.operators.selection import display_picks

    f = detections(s, d).groupBy(*FRAME).agg(
        F.count("*").alias("n"), F.greatest(F.lit(0), F.count("*") - 60).alias("lost"), F.round(F.max("score"), 6).alias("recall"), F.median(F.when(F.col("score") > 0.9, F.col("score"))).alias("iou"),
        F.round(F.abs(F.max("score") - F.coalesce(F.max(F.when(F.col("det_id") % 2 == 0, F.col("score"))), F.lit(0.0))), 6).alias("change"),
    )
    return display_picks(f, FRAME)
