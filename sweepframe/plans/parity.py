"""Queries on parity of two backends, descriptive statistics and array outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G
from sweepframe.functions.numeric import fraction, gib
from sweepframe.operators import boxes as B
from sweepframe.operators import metrics as M
from sweepframe.operators.acceptance import threshold_edges
from sweepframe.operators.fidelity import tolerance
from sweepframe.plans.acceptance import matches_sql
from sweepframe.plans.fixtures import CAND, DET, FRAME, LOGITS, candidates, detections, logits
from sweepframe.registry import query

FR = "drive_id, frame_index"
MATCHED = f"{CAND}, {matches_sql('det', 'cand')}, m AS (SELECT p.drive_id, p.frame_index, p.object_type, mt.det_id, mt.other_id, p.score AS score, c.score AS other_score, sqrt((p.cx - c.cx) ** 2 + (p.cy - c.cy) ** 2) AS xy_error, abs(p.score - c.score) AS score_error FROM mt JOIN det p ON p.det_id = mt.det_id JOIN cand c ON c.det_id = mt.other_id)"


def pairs(s, d):
    return B.parity_matches(detections(s, d).withColumn("det_id", F.col("det_id").cast("long")), candidates(s, d), [*FRAME, "object_type"], 0.5, oriented=False)


def matched(s, d):
    """Matched detections of two backends with their errors."""
    m = pairs(s, d).where("kind = 'match'").select("det_id", "other_id")
    c = candidates(s, d).select(F.col("det_id").alias("other_id"), *(F.col(k).alias(f"other_{k}") for k in ("cx", "cy", "score")))
    both = detections(s, d).join(m, "det_id").join(c, "other_id")
    return both.select(*FRAME, "object_type", "det_id", "other_id", "score", "other_score", F.hypot(F.col("cx") - F.col("other_cx"), F.col("cy") - F.col("other_cy")).alias("xy_error"), F.abs(F.col("score") - F.col("other_score")).alias("score_error"))


@query("agg_21_descriptive", f"WITH {DET} SELECT object_type, count(*) AS n, avg(score) AS mean, median(score) AS median, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.95) AS p95, min(score) AS min, max(score) AS max, stddev_pop(score) AS std FROM det GROUP BY object_type")
def agg_21(s, d):
    return M.describe(detections(s, d), "score", ["object_type"])


@query("agg_22_latency", "SELECT event_type, count(*) AS n, median(value) AS median, quantile_cont(value, 0.95) AS p95, 1000 / median(value) AS fps FROM events WHERE value > 0 GROUP BY event_type")
def agg_22(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("value > 0 and value < double('inf')")
    return M.describe(e, "value", ["event_type"]).select("event_type", "n", "median", "p95", (1000 / F.col("median")).alias("fps"))


@query("agg_23_distribution", f"WITH RECURSIVE {MATCHED} SELECT object_type, median(xy_error) AS median, quantile_cont(xy_error, 0.95) AS p95, quantile_cont(xy_error, 0.99) AS p99, max(xy_error) AS max, avg(xy_error) AS mean FROM m GROUP BY object_type")
def agg_23(s, d):
    return matched(s, d).groupBy("object_type").agg(F.median("xy_error").alias("median"), F.percentile("xy_error", F.lit(0.95)).alias("p95"), F.percentile("xy_error", F.lit(0.99)).alias("p99"), F.max("xy_error").alias("max"), F.avg("xy_error").alias("mean"))


@query("agg_24_tolerance", f"WITH RECURSIVE {MATCHED} SELECT object_type, count(*) AS n, count(*) FILTER (xy_error <= 0.05) AS passed, avg(CAST(xy_error <= 0.05 AS INT)) AS pass_fraction, avg(CAST(xy_error <= 0.05 AS INT)) >= 0.99 AS accepted FROM m GROUP BY object_type")
def agg_24(s, d):
    return tolerance(matched(s, d), "xy_error", 0.05, ["object_type"])


@query("jn_23_frame_difference", f"WITH {CAND}, a AS (SELECT {FR}, row_number() OVER (PARTITION BY {FR} ORDER BY score DESC, det_id) AS k, det_id, cx FROM det), b AS (SELECT {FR}, row_number() OVER (PARTITION BY {FR} ORDER BY score DESC, det_id) AS k, det_id, cx FROM cand) SELECT {FR}, count(a.k) AS a_count, count(b.k) AS b_count, min(k) FILTER (a.det_id IS DISTINCT FROM b.det_id OR abs(a.cx - b.cx) > 0.5) AS first FROM a FULL JOIN b USING (drive_id, frame_index, k) GROUP BY ALL")
def jn_23(s, d):
    w = Window.partitionBy(*FRAME).orderBy(F.desc("score"), "det_id")
    a, b = (x.select(*FRAME, F.row_number().over(w).alias("k"), F.struct("det_id", "cx").alias(n)) for x, n in ((detections(s, d), "a"), (candidates(s, d), "b")))
    differs = ~F.col("a.det_id").eqNullSafe(F.col("b.det_id")) | (F.abs(F.col("a.cx") - F.col("b.cx")) > 0.5)
    return a.join(b, [*FRAME, "k"], "full").groupBy(*FRAME).agg(F.count("a").alias("a_count"), F.count("b").alias("b_count"), F.min(F.when(differs, F.col("k"))).alias("first"))


@query("jn_24_threshold_edges", f"""WITH RECURSIVE {MATCHED} SELECT 'matched_crossing' AS kind, det_id, other_id FROM m WHERE (score >= 0.25) <> (other_score >= 0.25) AND (score BETWEEN 0.2 AND 0.3 OR other_score BETWEEN 0.2 AND 0.3)
UNION ALL SELECT 'reference_only', no.det_id, NULL FROM no JOIN det ON det.det_id = no.det_id WHERE kind = 'missing' AND score BETWEEN 0.25 AND 0.3 UNION ALL SELECT 'candidate_only', NULL, no.other_id FROM no JOIN cand ON cand.det_id = no.other_id WHERE kind = 'extra' AND score BETWEEN 0.25 AND 0.3""")
def jn_24(s, d):
    """Pairs that cross the threshold of export, and exported detections near it that only one side has."""
    return threshold_edges(detections(s, d), candidates(s, d), pairs(s, d))


@query("prj_24_latency_classes", "SELECT event_id, CASE WHEN value <= 50 THEN '20Hz' WHEN value <= 75 THEN '13Hz' WHEN value <= 100 THEN '10Hz' ELSE 'slow' END AS class FROM events")
def prj_24(s, d):
    v = F.col("value")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(v <= 50, "20Hz").when(v <= 75, "13Hz").when(v <= 100, "10Hz").otherwise("slow").alias("class"))


@query("agg_34_array_differences", f"WITH {LOGITS}, u AS (SELECT anchor % 8 AS sample, abs(unnest(reference) - unnest(candidate)) AS e FROM logits) SELECT sample, count(*) AS n, median(e) AS median, quantile_cont(e, 0.95) AS p95, max(e) AS max FROM u GROUP BY sample")
def agg_34(s, d):
    u = logits(s, d).select((F.col("anchor") % 8).alias("sample"), F.explode(F.zip_with("reference", "candidate", lambda a, b: F.abs(a - b))).alias("e"))
    return u.groupBy("sample").agg(F.count("*").alias("n"), F.median("e").alias("median"), F.percentile("e", F.lit(0.95)).alias("p95"), F.max("e").alias("max"))


DIRS = f"{LOGITS}, dirs AS (SELECT anchor, CASE WHEN dir_a[2] > dir_a[1] THEN 1 ELSE 0 END AS a, CASE WHEN dir_b[2] > dir_b[1] THEN 1 ELSE 0 END AS b, abs(dir_a[2] - dir_a[1]) AS margin FROM logits)"


def directions(s, d):
    def top(c):
        return F.when(F.col(c)[1] > F.col(c)[0], 1).otherwise(0)

    return logits(s, d).select("anchor", top("dir_a").alias("a"), top("dir_b").alias("b"), F.abs(F.col("dir_a")[1] - F.col("dir_a")[0]).alias("margin"))


@query("agg_35_direction_population", f"WITH {DIRS} SELECT a = b AS agree, count(*) AS n, median(margin) AS median, max(margin) AS max FROM dirs GROUP BY ALL")
def agg_35(s, d):
    return directions(s, d).groupBy((F.col("a") == F.col("b")).alias("agree")).agg(F.count("*").alias("n"), F.median("margin").alias("median"), F.max("margin").alias("max"))


@query("agg_36_disagreements", f"WITH {DIRS} SELECT anchor, a, b, margin FROM dirs WHERE a <> b")
def agg_36(s, d):
    return directions(s, d).where("a <> b")


@query("agg_49_array_statistics", f"WITH {LOGITS} SELECT anchor, list_min(reference) AS min, list_max(reference) AS max, list_avg(reference) AS mean FROM logits")
def agg_49(s, d):
    mean = F.aggregate("reference", F.lit(0.0), lambda a, x: a + x) / F.size("reference")
    return logits(s, d).select("anchor", F.array_min("reference").alias("min"), F.array_max("reference").alias("max"), mean.alias("mean"))


@query("win_12_top_anchors", f"WITH {LOGITS}, r AS (SELECT anchor, row_number() OVER (ORDER BY list_max(reference) DESC, anchor) AS a, row_number() OVER (ORDER BY list_max(candidate) DESC, anchor) AS b FROM logits) SELECT anchor FROM r WHERE a <= 100 OR b <= 100")
def win_12(s, d):
    lg = logits(s, d)
    top = [lg.orderBy(F.desc(F.array_max(c)), "anchor").limit(100).select("anchor") for c in ("reference", "candidate")]
    return top[0].union(top[1]).distinct()


@query("set_3_index_union", f"WITH {LOGITS} SELECT anchor FROM logits WHERE anchor % 3 = 0 UNION SELECT anchor FROM logits WHERE anchor % 5 = 0")
def set_3(s, d):
    a = logits(s, d).select("anchor")
    return a.where("anchor % 3 = 0").union(a.where("anchor % 5 = 0")).distinct()


@query("arr_1_per_anchor_rows", f"WITH {LOGITS} SELECT anchor * 5 + (k - 1) % 5 AS row, list(reference[k] ORDER BY k) AS logits FROM logits, range(1, 11) r(k) GROUP BY ALL")
def arr_1(s, d):
    """Channels-first outputs (2 values by 5 anchors a cell) as one row per anchor with its values in order."""
    u = logits(s, d).select("anchor", F.posexplode("reference").alias("k", "v"))
    return u.groupBy((F.col("anchor") * 5 + F.col("k") % 5).alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("logits"))


@query("mth_1_ulp_distance")
def mth_1(s, d):
    from sweepframe.plans.fixtures import points

    return points(s, d).select(*FRAME, "row_idx", G.ulp_distance(F.col("x"), (F.col("x").cast("double") + 1e-6).cast("float")).alias("ulp"))


@query("mth_2_3_fractions", f"WITH {DET} SELECT object_type, coalesce(count(*) FILTER (score > 2) / nullif(count(*) FILTER (score > 3), 0)::DOUBLE, 1) AS one, coalesce(count(*) FILTER (score > 2) / nullif(count(*) FILTER (score > 3), 0)::DOUBLE, 0) AS zero, CAST(NULL AS DOUBLE) AS none, count(*) / 1073741824::DOUBLE AS gib FROM det GROUP BY object_type")
def mth_2(s, d):
    g = detections(s, d).groupBy("object_type").agg(F.count_if(F.col("score") > 2).alias("a"), F.count_if(F.col("score") > 3).alias("b"), F.count("*").alias("n"))
    return g.select("object_type", *(fraction(F.col("a"), F.col("b"), e).alias(n) for n, e in (("one", 1.0), ("zero", 0.0), ("none", None))), gib(F.col("n")).alias("gib"))


@query("agg_48_runs", f"""WITH RECURSIVE {MATCHED}, t AS (SELECT det_id % 4 AS run, count(*) AS n FROM det GROUP BY ALL), o AS (SELECT det_id % 4 AS run, xy_error, row_number() OVER (PARTITION BY drive_id, frame_index, det_id % 4 ORDER BY score DESC, det_id) AS ka, row_number() OVER (PARTITION BY drive_id, frame_index, det_id % 4 ORDER BY other_score DESC, other_id) AS kb FROM m),
r AS (SELECT run, max(xy_error) AS worst, avg(xy_error) AS mean, count(*) / any_value(n)::DOUBLE AS coverage, bool_and(ka = kb) AS exact FROM o JOIN t USING (run) GROUP BY run)
SELECT count(*) AS runs, count(*) FILTER (exact) AS exact_order_runs, max(worst) AS worst, median(mean) AS median_mean, min(coverage) AS least_coverage, avg(coverage) AS mean_coverage FROM r""")
def agg_48(s, d):
    """Runs side by side: their largest and mean errors, the share of detections that found a match, and how many keep the order of scores in every frame."""
    run = F.col("det_id") % 4
    total = detections(s, d).groupBy(run.alias("run")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*FRAME, "run")
    o = matched(s, d).withColumn("run", run).withColumns({"ka": F.row_number().over(w.orderBy(F.desc("score"), "det_id")), "kb": F.row_number().over(w.orderBy(F.desc("other_score"), "other_id"))})
    r = o.join(total, "run").groupBy("run").agg(F.max("xy_error").alias("worst"), F.avg("xy_error").alias("mean"), (F.count("*") / F.first("n")).alias("coverage"), F.bool_and(F.col("ka") == F.col("kb")).alias("exact"))
    return r.agg(F.count("*").alias("runs"), F.count_if("exact").alias("exact_order_runs"), F.max("worst").alias("worst"), F.median("mean").alias("median_mean"), F.min("coverage").alias("least_coverage"), F.avg("coverage").alias("mean_coverage"))
