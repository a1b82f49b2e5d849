"""Queries on pillars and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G
from sweepframe.operators import voxels as V
from sweepframe.operators.points import in_range
from sweepframe.plans.fixtures import FRAME, GT, POINTS, ground_truth, points
from sweepframe.registry import query

FR = "drive_id, frame_index"
SIZE, CAP = 10.0, 20


def ranked(s, d):
    """Points with a history rank: every seventh of a frame's rows belongs to one sweep."""
    return points(s, d).withColumn("history_rank", F.col("label") - 1)


RANKED = f"{POINTS}, ranked AS (SELECT *, label - 1 AS history_rank FROM points)"
PILLARS = f"""{RANKED}, cells AS (SELECT {FR}, CAST(floor(CAST(CAST(x::DOUBLE + 50 AS FLOAT)::DOUBLE / 10 AS FLOAT)) AS INT) AS cx, CAST(floor(CAST(CAST(y::DOUBLE + 50 AS FLOAT)::DOUBLE / 10 AS FLOAT)) AS INT) AS cy, history_rank, row_idx FROM ranked),
first AS (SELECT {FR}, cx, cy, count(*) AS n_points, min({{'h': history_rank, 'r': row_idx}}) AS f FROM cells WHERE cx BETWEEN 0 AND 9 AND cy BETWEEN 0 AND 9 GROUP BY ALL),
pillars AS (SELECT {FR}, cx, cy, n_points, f.r AS first_row, f.h AS first_sweep, row_number() OVER (PARTITION BY {FR} ORDER BY f.h, f.r) - 1 AS touch_rank FROM first)"""
REGION = """CAST(floor(((degrees(atan2(py, px)) + 360) % 360) / 30) AS INT)"""
SECTORS = f"""{PILLARS}, placed AS (SELECT *, (cx + 0.5::DOUBLE) * 10 - 50 AS px, (cy + 0.5::DOUBLE) * 10 - 50 AS py, touch_rank < 20 AS retained FROM pillars),
sectors AS (SELECT drive_id, {REGION} AS sector, count(*) AS candidates, count(*) FILTER (NOT retained) AS discarded FROM placed GROUP BY ALL)"""


def pillars(s, d):
    return V.first_touch(ranked(s, d), CAP, SIZE)


def placed(s, d):
    p = pillars(s, d).withColumn("px", V.centre(F.col("cx"), SIZE)).withColumn("py", V.centre(F.col("cy"), SIZE))
    return p.select("*", G.regions(F.col("px"), F.col("py")).alias("r")).select("*", "r.*")


@query("win_1_first_touch_pillars", f"WITH {PILLARS} SELECT {FR}, cx, cy, n_points, first_row, first_sweep, touch_rank, touch_rank < 20 AS retained FROM pillars")
def win_1(s, d):
    return pillars(s, d)


@query("agg_9_pillar_summary", f"WITH {PILLARS} SELECT {FR}, CAST(sum(n_points) AS BIGINT) AS in_range_points, count(*) AS candidates, count(*) FILTER (touch_rank < 20) AS retained, count(*) FILTER (touch_rank >= 20) AS discarded, count(*) FILTER (touch_rank >= 20) / count(*)::DOUBLE AS overflow_fraction FROM pillars GROUP BY ALL")
def agg_9(s, d):
    return V.pillar_summary(pillars(s, d))


@query("agg_9_first_touch_histogram", f"WITH {PILLARS} SELECT {FR}, first_sweep, count(*) AS candidates, count(*) FILTER (touch_rank < 20) AS retained, count(*) FILTER (touch_rank >= 20) AS discarded FROM pillars GROUP BY ALL")
def agg_9h(s, d):
    return V.first_touch_histogram(pillars(s, d))


@query("agg_10_candidate_pillars", f"WITH {PILLARS} SELECT {FR}, count(*) AS candidates FROM pillars GROUP BY ALL")
def agg_10(s, d):
    return V.with_pillars(points(s, d), SIZE).groupBy(*FRAME).agg(F.countDistinct("cx", "cy").alias("candidates"))


@query("agg_11_sector_counts", f"""WITH {SECTORS}, dense AS (SELECT DISTINCT drive_id, k AS sector FROM sectors, range(12) r(k))
SELECT dense.drive_id, CAST(dense.sector AS INT) AS sector, coalesce(candidates, 0) AS candidates, coalesce(discarded, 0) AS discarded FROM dense LEFT JOIN sectors ON dense.drive_id = sectors.drive_id AND dense.sector = sectors.sector""")
def agg_11(s, d):
    counts = placed(s, d).groupBy("drive_id", "sector").agg(F.count("*").alias("candidates"), F.count_if(~F.col("retained")).alias("discarded"))
    dense = counts.select("drive_id").distinct().select("drive_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("sector"))
    return dense.join(counts, ["drive_id", "sector"], "left").fillna(0)


BINS = f"""{PILLARS}, placed AS (SELECT *, (cx + 0.5::DOUBLE) * 10 - 50 AS px, (cy + 0.5::DOUBLE) * 10 - 50 AS py, touch_rank < 20 AS retained FROM pillars),
binned AS (SELECT *, {REGION} AS sector, CASE WHEN px < 0 THEN 2 ELSE 0 END + CASE WHEN py < 0 THEN 1 ELSE 0 END AS quadrant, CASE WHEN sqrt(px * px + py * py) < 20 THEN 0 WHEN sqrt(px * px + py * py) < 35 THEN 1 ELSE 2 END AS radial FROM placed)"""


@query("agg_11_regions", f"""WITH {BINS}, u AS (UNPIVOT (SELECT drive_id, retained, sector, quadrant, radial FROM binned) ON sector, quadrant, radial INTO NAME kind VALUE bin), every AS (SELECT DISTINCT drive_id, kind, bin FROM (SELECT DISTINCT drive_id FROM binned),
  (SELECT 'sector' AS kind, unnest(range(12)) AS bin UNION ALL SELECT 'quadrant', unnest(range(4)) UNION ALL SELECT 'radial', unnest(range(3))))
SELECT drive_id, kind, bin::INT AS bin, count(retained) AS candidates, count(*) FILTER (NOT retained) AS discarded FROM every LEFT JOIN u USING (drive_id, kind, bin) GROUP BY ALL""")
def agg_11_regions(s, d):
    """Candidates and discarded pillars of each sector, quadrant and radial bin, empty ones too."""
    bins = {"sector": 12, "quadrant": 4, "radial": 3}
    p = placed(s, d).select("drive_id", "retained", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("int").alias("bin")) for k in bins))).alias("b")).select("drive_id", "retained", "b.*")
    n = p.groupBy("drive_id", "kind", "bin").agg(F.count("*").alias("candidates"), F.count_if(~F.col("retained")).alias("discarded"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("bin")) for k, m in bins.items() for i in range(m))))
    every = n.select("drive_id").distinct().select("drive_id", each.alias("b")).select("drive_id", "b.*")
    return every.join(n, ["drive_id", "kind", "bin"], "left").na.fill(0)


@query("agg_11_discarded_bounds", f"WITH {BINS} SELECT drive_id, frame_index, count(*) AS discarded, min(px) - 5 AS low_x, max(px) + 5 AS high_x, min(py) - 5 AS low_y, max(py) + 5 AS high_y FROM binned WHERE NOT retained GROUP BY ALL")
def agg_11_bounds(s, d):
    """The rectangle that holds a frame's discarded pillars."""
    p = placed(s, d).where(~F.col("retained"))
    edge = {"low_x": F.min("px") - SIZE / 2, "high_x": F.max("px") + SIZE / 2, "low_y": F.min("py") - SIZE / 2, "high_y": F.max("py") + SIZE / 2}
    return p.groupBy(*FRAME).agg(F.count("*").alias("discarded"), *(v.alias(k) for k, v in edge.items()))


@query("agg_12_drop_rates", f"""WITH {SECTORS}, r AS (SELECT *, discarded / candidates::DOUBLE AS rate, row_number() OVER (PARTITION BY drive_id ORDER BY discarded / candidates::DOUBLE DESC, sector) AS k FROM sectors)
SELECT drive_id, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(discarded) AS BIGINT) AS discarded, max(rate) / nullif(min(rate), 0) AS ratio, max(CASE WHEN k = 1 THEN sector END) AS worst_sector FROM r GROUP BY drive_id""")
def agg_12(s, d):
    rates = placed(s, d).groupBy("drive_id", "sector").agg(F.count("*").alias("candidates"), F.count_if(~F.col("retained")).alias("discarded")).withColumn("rate", F.col("discarded") / F.col("candidates"))
    return rates.groupBy("drive_id").agg(F.sum("candidates").alias("candidates"), F.sum("discarded").alias("discarded"), F.try_divide(F.max("rate"), F.min("rate")).alias("ratio"), F.max_by("sector", F.struct("rate", -F.col("sector"))).alias("worst_sector"))


@query("agg_13_homogeneity", f"""WITH {SECTORS}, e AS (SELECT *, sum(discarded) OVER w * candidates / sum(candidates) OVER w AS e FROM sectors WINDOW w AS (PARTITION BY drive_id))
SELECT drive_id, min(e) >= 5 AS adequate, CASE WHEN min(e) >= 5 THEN sum((discarded - e) * (discarded - e) / e) END AS statistic, CASE WHEN min(e) >= 5 THEN sum((discarded - e) * (discarded - e) / e) > 24.72497 END AS reject FROM e GROUP BY drive_id""")
def agg_13(s, d):
    counts = placed(s, d).groupBy("drive_id", "sector").agg(F.count("*").alias("candidates"), F.count_if(~F.col("retained")).alias("discarded"))
    return V.homogeneity(counts, ["drive_id"])


VOXELS = f"""{RANKED}, v AS (SELECT *, CAST(floor(CAST(CAST(x::DOUBLE + 50 AS FLOAT)::DOUBLE / 10 AS FLOAT)) AS INT) AS cx, CAST(floor(CAST(CAST(y::DOUBLE + 50 AS FLOAT)::DOUBLE / 10 AS FLOAT)) AS INT) AS cy, CAST(floor(CAST(CAST(z::DOUBLE + 5 AS FLOAT)::DOUBLE / 4 AS FLOAT)) AS INT) AS cz
  FROM ranked WHERE x >= -50 AND x < 50 AND y >= -50 AND y < 50 AND z >= -5 AND z < 3),
vs AS (SELECT *, row_number() OVER (PARTITION BY {FR}, cz, cy, cx ORDER BY history_rank, row_idx) - 1 AS slot FROM v),
vr AS (SELECT {FR}, cz, cy, cx, n, row_number() OVER (PARTITION BY {FR} ORDER BY f) - 1 AS voxel_rank FROM (SELECT {FR}, cz, cy, cx, count(*) AS n, min({{'h': history_rank, 'r': row_idx}}) AS f FROM v GROUP BY ALL)),
hard AS (SELECT vs.*, voxel_rank, least(n, 3) AS num_points, n AS all_points FROM vs JOIN vr USING (drive_id, frame_index, cz, cy, cx) WHERE slot < 3 AND voxel_rank < 60)"""


def hard(s, d):
    return V.hard_voxels(ranked(s, d), (10.0, 10.0, 4.0), 3, 60)


@query("win_2_hard_voxels", f"WITH {VOXELS} SELECT {FR}, cz, cy, cx, voxel_rank, slot, row_idx, num_points FROM hard")
def win_2(s, d):
    return hard(s, d).select(*FRAME, "cz", "cy", "cx", "voxel_rank", "slot", "row_idx", "num_points")


@query("agg_14_saturation", f"""WITH {VOXELS}, f AS (SELECT {FR}, voxel_rank, max(num_points) AS num_points FROM hard GROUP BY ALL), r AS (SELECT {FR}, count(*) AS valid FROM v GROUP BY ALL)
SELECT {FR}, count(*) AS voxels, count(*) FILTER (num_points = 3) AS saturated, count(*) FILTER (num_points = 3) / count(*)::DOUBLE AS saturated_fraction, CAST(sum(num_points) AS BIGINT) AS retained_points, CASE WHEN count(*) < 60 THEN CAST(max(valid) - sum(num_points) AS BIGINT) END AS discarded_points FROM f JOIN r USING (drive_id, frame_index) GROUP BY ALL""")
def agg_14(s, d):
    voxels = hard(s, d).groupBy(*FRAME, "voxel_rank").agg(F.max("num_points").alias("num_points"))
    valid = ranked(s, d).where(in_range(F.col("x"), F.col("y"), F.col("z"), (-50, -50, -5), (50, 50, 3))).groupBy(*FRAME).agg(F.count("*").alias("valid"))
    out = voxels.groupBy(*FRAME).agg(F.count("*").alias("voxels"), F.count_if(F.col("num_points") == 3).alias("saturated"), F.sum("num_points").alias("retained_points")).join(valid, FRAME)
    return out.select(*FRAME, "voxels", "saturated", (F.col("saturated") / F.col("voxels")).alias("saturated_fraction"), "retained_points", F.when(F.col("voxels") < 60, F.col("valid") - F.col("retained_points")).alias("discarded_points"))


@query("win_5_sweep_indices", f"""WITH {RANKED}, p AS (SELECT *, CAST(history_rank / 10::DOUBLE AS FLOAT) AS time_lag FROM ranked WHERE x > 0)
SELECT {FR}, time_lag, row_number() OVER (PARTITION BY {FR} ORDER BY f) - 1 AS sweep_index FROM (SELECT {FR}, time_lag, min({{'h': history_rank, 'r': row_idx}}) AS f FROM p GROUP BY ALL)""")
def win_5(s, d):
    return V.sweep_indices(ranked(s, d).where("x > 0").withColumn("time_lag", (F.col("history_rank") / 10.0).cast("float")))


@query("jn_16_pillars_in_boxes", f"""WITH {PILLARS}, {GT}, near AS (SELECT p.drive_id, p.frame_index, track_id, p.cx AS px, p.cy AS py FROM pillars p JOIN gt g ON p.drive_id = g.drive_id AND p.frame_index = g.frame_index AND abs((p.cx + 0.5::DOUBLE) * 10 - 50 - g.cx) <= 5 + len / 2 AND abs((p.cy + 0.5::DOUBLE) * 10 - 50 - g.cy) <= 5 + wid / 2)
SELECT {FR}, track_id, count(*) AS pillars FROM near GROUP BY ALL""")
def jn_16(s, d):
    from sweepframe.operators.boxes import cells_of_boxes

    boxes = ground_truth(s, d).withColumn("yaw", F.lit(0.0))
    hits = cells_of_boxes(boxes, SIZE).join(pillars(s, d).select(*FRAME, "cx", "cy").withColumnsRenamed({"cx": "px", "cy": "py"}), [*FRAME, "px", "py"])
    return hits.groupBy(*FRAME, "track_id").agg(F.count("*").alias("pillars"))


def two_voxel_sets(s, d):
    a = ranked(s, d)
    return V.with_pillars(a, SIZE).groupBy(*FRAME, "cx", "cy").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("row_idx")).alias("rows")), V.with_pillars(a.where("label < 7"), SIZE).groupBy(*FRAME, "cx", "cy").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("row_idx")).alias("rows"))


TWO = f"""{PILLARS}, a AS (SELECT {FR}, cx, cy, count(*) AS n, list(row_idx ORDER BY row_idx) AS rows FROM cells WHERE cx BETWEEN 0 AND 9 AND cy BETWEEN 0 AND 9 GROUP BY ALL),
b AS (SELECT {FR}, cx, cy, count(*) AS n, list(row_idx ORDER BY row_idx) AS rows FROM cells WHERE cx BETWEEN 0 AND 9 AND cy BETWEEN 0 AND 9 AND history_rank < 6 GROUP BY ALL)"""


@query("jn_18_voxel_sets", f"""WITH {TWO} SELECT {FR}, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS common, count(*) FILTER (b.n IS NULL) AS only_a, count(*) FILTER (a.n IS NULL) AS only_b,
count(*) FILTER (a.rows = b.rows) / greatest(1, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL))::DOUBLE AS equal_fraction FROM a FULL JOIN b USING (drive_id, frame_index, cx, cy) GROUP BY ALL""")
def jn_18(s, d):
    from sweepframe.operators.fidelity import compare_sets

    a, b = two_voxel_sets(s, d)
    return compare_sets(a, b, [*FRAME, "cx", "cy"], FRAME, "rows")


@query("set_2_coordinate_sets", f"""WITH {TWO} SELECT drive_id, count(*) AS in_union, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS in_both, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) / count(*)::DOUBLE AS jaccard FROM a FULL JOIN b USING (drive_id, frame_index, cx, cy) GROUP BY drive_id""")
def set_2(s, d):
    a, b = two_voxel_sets(s, d)
    both = a.select(*FRAME, "cx", "cy", F.lit(1).alias("a")).join(b.select(*FRAME, "cx", "cy", F.lit(1).alias("b")), [*FRAME, "cx", "cy"], "full")
    out = both.groupBy("drive_id").agg(F.count("*").alias("in_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))
    return out.withColumn("jaccard", F.col("in_both") / F.col("in_union"))


@query("jn_25_exact_gate", f"""WITH {TWO}, m AS (SELECT {FR}, count(*) FILTER (a.rows IS DISTINCT FROM b.rows) AS mismatches FROM a FULL JOIN b USING (drive_id, frame_index, cx, cy) GROUP BY ALL)
SELECT drive_id, count(*) AS samples, count(*) FILTER (mismatches = 0) AS exact_samples, min(frame_index) FILTER (mismatches > 0) AS first_mismatch FROM m GROUP BY drive_id""")
def jn_25(s, d):
    a, b = two_voxel_sets(s, d)
    m = a.select(*FRAME, "cx", "cy", F.col("rows").alias("a")).join(b.select(*FRAME, "cx", "cy", F.col("rows").alias("b")), [*FRAME, "cx", "cy"], "full").groupBy(*FRAME).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))
    bad = F.when(F.col("mismatches") > 0, F.col("frame_index"))
    return m.groupBy("drive_id").agg(F.count("*").alias("samples"), F.count_if(F.col("mismatches") == 0).alias("exact_samples"), F.min(bad).alias("first_mismatch"))


@query("geo_10_pillar_centres", f"WITH {PILLARS} SELECT {FR}, cx, cy, (cx + 0.5::DOUBLE) * 10 - 50 AS x, (cy + 0.5::DOUBLE) * 10 - 50 AS y FROM pillars")
def geo_10(s, d):
    return pillars(s, d).select(*FRAME, "cx", "cy", V.centre(F.col("cx"), SIZE).alias("x"), V.centre(F.col("cy"), SIZE).alias("y"))


@query("geo_11_regions", f"WITH {SECTORS} SELECT {FR}, cx, cy, {REGION} AS sector, CASE WHEN px < 0 THEN 2 ELSE 0 END + CASE WHEN py < 0 THEN 1 ELSE 0 END AS quadrant, CASE WHEN sqrt(px * px + py * py) < 20 THEN 0 WHEN sqrt(px * px + py * py) < 35 THEN 1 ELSE 2 END AS radial FROM placed")
def geo_11(s, d):
    return placed(s, d).select(*FRAME, "cx", "cy", "sector", "quadrant", "radial")


@query("agg_25_nearest_rank", f"WITH {PILLARS}, n AS (SELECT {FR}, count(*) AS n FROM pillars GROUP BY ALL) SELECT drive_id, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, count(*) FILTER (n > 80) AS over FROM n GROUP BY drive_id")
def agg_25(s, d):
    n = pillars(s, d).groupBy(*FRAME).agg(F.count("*").alias("n"))
    return n.groupBy("drive_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95"), F.count_if(F.col("n") > 80).alias("over"))


@query("agg_26_capacity_profile", f"WITH {PILLARS}, n AS (SELECT {FR}, count(*) AS n FROM pillars GROUP BY ALL) SELECT drive_id, min(n) AS min, quantile_disc(n, 0.5) AS p50, max(n) AS max, CAST(least(120, greatest(80, ceil(1.25 * max(n)))) AS BIGINT) AS headroom FROM n GROUP BY drive_id")
def agg_26(s, d):
    n = pillars(s, d).groupBy(*FRAME).agg(F.count("*").alias("n"))
    room = F.least(F.lit(120), F.greatest(F.lit(80), F.ceil(F.lit(1.25) * F.max("n")))).cast("long")
    return n.groupBy("drive_id").agg(F.min("n").alias("min"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("p50"), F.max("n").alias("max"), room.alias("headroom"))


@query("sel_6_highest_and_closest", f"WITH {PILLARS}, n AS (SELECT {FR}, count(*) AS n FROM pillars GROUP BY ALL) SELECT drive_id, arg_min(frame_index, {{'a': -n, 'b': frame_index}}) AS highest, arg_min(frame_index, {{'a': abs(n - 75), 'b': frame_index}}) AS closest FROM n GROUP BY drive_id")
def sel_6(s, d):
    n = pillars(s, d).groupBy(*FRAME).agg(F.count("*").alias("n"))
    return n.groupBy("drive_id").agg(F.min_by("frame_index", F.struct(-F.col("n"), "frame_index")).alias("highest"), F.min_by("frame_index", F.struct(F.abs(F.col("n") - 75), "frame_index")).alias("closest"))


@query("sel_10_min_upper_median_max", f"WITH {PILLARS}, n AS (SELECT {FR}, count(*) AS n FROM pillars GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY n, frame_index) - 1 AS k, count(*) OVER (PARTITION BY drive_id) AS m FROM n) SELECT drive_id, max(CASE WHEN k = 0 THEN frame_index END) AS lowest, max(CASE WHEN k = m // 2 THEN frame_index END) AS median, max(CASE WHEN k = m - 1 THEN frame_index END) AS highest FROM r GROUP BY drive_id")
def sel_10(s, d):
    w = Window.partitionBy("drive_id")
    n = pillars(s, d).groupBy(*FRAME).agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w.orderBy("n", "frame_index")) - 1).withColumn("m", F.count("*").over(w))
    return n.groupBy("drive_id").agg(*(F.max(F.when(c, F.col("frame_index"))).alias(a) for a, c in (("lowest", F.col("k") == 0), ("median", F.col("k") == F.floor(F.col("m") / 2)), ("highest", F.col("k") == F.col("m") - 1))))
