"""Queries on points: projections, filters, labels, grids and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G
from sweepframe.functions.numeric import fraction, is_finite
from sweepframe.operators import points as P
from sweepframe.plans.fixtures import FRAME, GT, POINTS, frames, ground_truth, points
from sweepframe.registry import query

CROP = "x > -50 AND x < 50 AND y > -50 AND y < 50 AND z > -5 AND z < 3"
FR = "drive_id, frame_index"


def crop(df):
    return df.where(P.in_crop(F.col("x"), F.col("y"), F.col("z")))


@query("src_4_label_bits", "SELECT l_orderkey, l_linenumber, p & 65535 AS semantic_id, p >> 16 AS instance_id, count(*) AS n FROM (SELECT *, l_partkey * 65536 + l_suppkey AS p FROM lineitem) GROUP BY ALL")
def src_4(s, d):
    p = F.col("l_partkey") * 65536 + F.col("l_suppkey")
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", p.bitwiseAND(F.lit(65535)).alias("semantic_id"), F.shiftrightunsigned(p, 16).alias("instance_id")).groupBy("l_orderkey", "l_linenumber", "semantic_id", "instance_id").agg(F.count("*").alias("n"))


@query("src_7_scan_pairing", f"""WITH {POINTS}, scans AS (SELECT DISTINCT {FR} FROM points WHERE label <> 7), labels_ AS (SELECT DISTINCT {FR} FROM points WHERE label = 6)
SELECT coalesce(s.drive_id, l.drive_id) AS drive_id, coalesce(s.frame_index, l.frame_index) AS frame_index, CASE WHEN s.drive_id IS NULL THEN 'orphan_label' WHEN l.drive_id IS NULL THEN 'missing_label' ELSE 'paired' END AS status
FROM scans s FULL JOIN labels_ l ON s.drive_id = l.drive_id AND s.frame_index = l.frame_index""")
def src_7(s, d):
    from sweepframe.sources.manifests import pair_scans

    p = points(s, d)
    return pair_scans(p.where("label <> 7").select(*FRAME).distinct(), p.where("label = 6").select(*FRAME).distinct(), FRAME)


@query("src_9_drive_contiguity", f"WITH {POINTS} SELECT drive_id, count(DISTINCT frame_index) AS frames, min(frame_index) AS first, max(frame_index) AS last, min(frame_index) = 0 AND count(DISTINCT frame_index) = max(frame_index) + 1 AS contiguous FROM points GROUP BY drive_id")
def src_9(s, d):
    from sweepframe.sources.manifests import contiguity

    return contiguity(points(s, d).select(*FRAME).distinct())


@query("prj_1_cloud_contract", f"""WITH {POINTS}, a AS (SELECT {FR}, count(*) AS n_points FROM points GROUP BY ALL), b AS (SELECT {FR}, count(*) AS n_labels FROM points WHERE label <= 6 GROUP BY ALL)
SELECT {FR}, n_points, coalesce(n_labels, 0) AS n_labels, n_points = coalesce(n_labels, 0) AS equal_lengths FROM a LEFT JOIN b USING (drive_id, frame_index)""")
def prj_1(s, d):
    p = points(s, d)
    a, b = p.groupBy(*FRAME).agg(F.count("*").alias("n_points")), p.where("label <= 6").groupBy(*FRAME).agg(F.count("*").alias("n_labels"))
    return a.join(b, FRAME, "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0))).withColumn("equal_lengths", F.col("n_points") == F.col("n_labels"))


@query("prj_2_min_xyz", f"WITH {POINTS} SELECT {FR}, row_idx, CAST(x - min(x) OVER w AS FLOAT) AS x, CAST(y - min(y) OVER w AS FLOAT) AS y, CAST(z - min(z) OVER w AS FLOAT) AS z FROM points WINDOW w AS (PARTITION BY {FR})")
def prj_2(s, d):
    return P.min_xyz(points(s, d)).select(*FRAME, "row_idx", "x", "y", "z")


@query("prj_3_finite_rows", f"WITH {POINTS}, p AS (SELECT *, CASE WHEN row_idx % 17 = 0 THEN CAST('nan' AS FLOAT) WHEN row_idx % 19 = 0 THEN CAST('inf' AS FLOAT) ELSE x END AS x2 FROM points) SELECT {FR}, count(*) AS n, count(*) FILTER (isfinite(x2) AND isfinite(y) AND isfinite(z)) AS finite FROM p GROUP BY ALL")
def prj_3(s, d):
    x = F.when(F.col("row_idx") % 17 == 0, F.lit(float("nan"))).when(F.col("row_idx") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("x")).cast("float")
    return points(s, d).withColumn("x", x).groupBy(*FRAME).agg(F.count("*").alias("n"), F.count_if(is_finite("x", "y", "z")).alias("finite"))


@query("prj_4_strict_crop", f"WITH {POINTS} SELECT {FR}, row_idx, x, y, z FROM points WHERE {CROP}")
def prj_4(s, d):
    return crop(points(s, d)).select(*FRAME, "row_idx", "x", "y", "z")


@query("prj_5_half_open_count", f"WITH {POINTS} SELECT {FR}, count(*) FILTER (x >= -50 AND x < 50 AND y >= -50 AND y < 50 AND z >= -5 AND z < 3) AS valid FROM points GROUP BY ALL")
def prj_5(s, d):
    return points(s, d).groupBy(*FRAME).agg(F.count_if(P.in_range(F.col("x"), F.col("y"), F.col("z"), (-50, -50, -5), (50, 50, 3))).alias("valid"))


@query("prj_6_even_subsample", f"""WITH {POINTS}, p AS (SELECT *, count(*) OVER (PARTITION BY {FR}) AS n, row_number() OVER (PARTITION BY {FR} ORDER BY row_idx) - 1 AS i FROM points WHERE x BETWEEN -40 AND 40 AND y BETWEEN -40 AND 40),
want AS (SELECT DISTINCT {FR}, CAST(CASE WHEN k = 99 THEN n - 1 ELSE floor(k * ((n - 1) / 99::DOUBLE)) END AS BIGINT) AS i FROM (SELECT DISTINCT {FR}, n FROM p), range(100) r(k) WHERE n > 100)
SELECT {FR}, row_idx FROM p WHERE n <= 100 UNION ALL SELECT {FR}, row_idx FROM p JOIN want USING (drive_id, frame_index, i) WHERE n > 100""")
def prj_6(s, d):
    near = points(s, d).where(F.col("x").between(-40, 40) & F.col("y").between(-40, 40))
    return P.even_subsample(near, 100).select(*FRAME, "row_idx")


@query("prj_7_remove_close", f"WITH {POINTS} SELECT {FR}, count(*) AS n FROM points WHERE NOT (abs(x) < 5 AND abs(y) < 5) GROUP BY ALL")
def prj_7(s, d):
    return points(s, d).where(~P.too_close(F.col("x"), F.col("y"), 5.0)).groupBy(*FRAME).agg(F.count("*").alias("n"))


@query("prj_8_patch_membership", f"WITH {POINTS} SELECT {FR}, row_idx FROM points WHERE x >= -10 AND x < 15 AND y >= -20 AND y < 5")
def prj_8(s, d):
    return points(s, d).where((F.col("x") >= -10) & (F.col("x") < 15) & (F.col("y") >= -20) & (F.col("y") < 5)).select(*FRAME, "row_idx")


@query("prj_12_axis_change", f"WITH {POINTS} SELECT {FR}, row_idx, CAST(-y AS FLOAT) AS x, x AS y, z, CAST(0 AS FLOAT) AS ring FROM points")
def prj_12(s, d):
    return points(s, d).select(*FRAME, "row_idx", (-F.col("y")).alias("x"), F.col("x").alias("y"), "z", F.lit(0).cast("float").alias("ring"))


@query("prj_13_raw_sweep", f"WITH {POINTS} SELECT {FR}, row_idx, x, y, z, CAST(0 AS FLOAT) AS intensity, CAST(0 AS FLOAT) AS ring, drive_id || '@' || frame_index || '.' || lpad(CAST(frame_index * 7 AS VARCHAR), 9, '0') AS source_id FROM points")
def prj_13(s, d):
    from sweepframe.functions.numeric import acquisition_id

    zero = F.lit(0).cast("float")
    return points(s, d).select(*FRAME, "row_idx", "x", "y", "z", zero.alias("intensity"), zero.alias("ring"), acquisition_id(F.col("drive_id"), F.col("frame_index"), F.col("frame_index") * 7).alias("source_id"))


_A = (0.9998, -0.0199, 0.001, 0.0199, 0.9998, 0.002, -0.001, -0.002, 0.99999)
_B = (1.25, -0.5, 0.125)


def _rigid_sql(k: int) -> str:
    return f"CAST(CAST(x::DOUBLE * {_A[k]}::DOUBLE + y::DOUBLE * {_A[3 + k]}::DOUBLE + z::DOUBLE * {_A[6 + k]}::DOUBLE AS FLOAT)::DOUBLE - {_B[k]}::DOUBLE AS FLOAT)"


@query("prj_14_rigid_row_vectors", f"WITH {POINTS} SELECT {FR}, row_idx, {_rigid_sql(0)} AS x, {_rigid_sql(1)} AS y, {_rigid_sql(2)} AS z FROM points")
def prj_14(s, d):
    moved = P.rigid_rows(*(F.col(c).cast("double") for c in "xyz"), [F.lit(a) for a in _A], [F.lit(b) for b in _B])
    return points(s, d).select(*FRAME, "row_idx", *(m.alias(c) for m, c in zip(moved, "xyz", strict=True)))


@query("prj_15_conventional_transform", f"WITH {POINTS} SELECT {FR}, row_idx, round(0.8 * x::DOUBLE - 0.6 * y::DOUBLE + 1.5, 6) AS x, round(0.6 * x::DOUBLE + 0.8 * y::DOUBLE - 2.0, 6) AS y, round(z::DOUBLE + 0.25, 6) AS z FROM points")
def prj_15(s, d):
    m = F.array(*(F.lit(float(v)) for v in (0.8, -0.6, 0, 1.5, 0.6, 0.8, 0, -2, 0, 0, 1, 0.25, 0, 0, 0, 1)))
    return points(s, d).select(*FRAME, "row_idx", *(F.round(v, 6).alias(c) for v, c in zip(G.apply(m, *(F.col(c).cast("double") for c in "xyz")), "xyz", strict=True)))


@query("prj_16_time_lag", "WITH f AS (SELECT epoch_us(ts) AS cur, epoch_us(ts) - event_id * 50000 AS src, event_id FROM events) SELECT event_id, CAST(cur / 1e6::DOUBLE - src / 1e6::DOUBLE AS FLOAT) AS time_lag FROM f")
def prj_16(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", P.time_lag(us, us - F.col("event_id") * 50000).alias("time_lag"))


@query("prj_23_failed_faces", f"""WITH {POINTS} SELECT {FR}, row_idx, array_to_string(list_filter([CASE WHEN x + 50 <= 0 THEN 'x_min' END, CASE WHEN 50 - x <= 0 THEN 'x_max' END, CASE WHEN y + 50 <= 0 THEN 'y_min' END,
CASE WHEN 50 - y <= 0 THEN 'y_max' END, CASE WHEN z + 5 <= 0 THEN 'z_min' END, CASE WHEN 3 - z <= 0 THEN 'z_max' END], lambda f: f IS NOT NULL), ',') AS faces FROM points WHERE NOT ({CROP})""")
def prj_23(s, d):
    out = points(s, d).where(~P.in_crop(F.col("x"), F.col("y"), F.col("z")))
    return out.select(*FRAME, "row_idx", F.array_join(P.failed_faces(P.face_distances(F.col("x"), F.col("y"), F.col("z"))), ",").alias("faces"))


@query("jn_1_map_labels", f"WITH {POINTS} SELECT {FR}, row_idx, CASE label WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 WHEN 8 THEN 6 ELSE -1 END AS shared_label FROM points")
def jn_1(s, d):
    return P.map_labels(points(s, d), P.TILE_CLASSES).select(*FRAME, "row_idx", "shared_label")


@query("jn_2_points_with_labels", f"WITH {POINTS}, l AS (SELECT {FR}, row_idx, label FROM points WHERE row_idx % 50 <> 49) SELECT {FR}, count(*) AS n, count(l.label) AS labelled, count(*) = count(l.label) AS complete FROM points p FULL JOIN l USING (drive_id, frame_index, row_idx) GROUP BY ALL")
def jn_2(s, d):
    p = points(s, d)
    labels = p.where("row_idx % 50 <> 49").select(*FRAME, "row_idx", F.col("label").alias("l"))
    out = p.join(labels, [*FRAME, "row_idx"], "full").groupBy(*FRAME).agg(F.count("*").alias("n"), F.count("l").alias("labelled"))
    return out.withColumn("complete", F.col("n") == F.col("labelled"))


@query("agg_1_coordinate_stats", f"WITH {POINTS} SELECT drive_id, count(*) AS n_points, CAST(0 AS BIGINT) AS n_non_finite, {', '.join(f'{f}({c})::DOUBLE AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} FROM points GROUP BY drive_id")
def agg_1(s, d):
    return P.coordinate_stats(points(s, d), ["drive_id"])


@query("agg_2_count_statistics", f"WITH {POINTS} SELECT drive_id, min(n) AS min, max(n) AS max, avg(n) AS mean, median(n) AS median FROM (SELECT {FR}, count(*) AS n FROM points GROUP BY ALL) GROUP BY drive_id")
def agg_2(s, d):
    return P.count_statistics(points(s, d).groupBy(*FRAME).agg(F.count("*").alias("n")), "n", ["drive_id"])


@query("agg_3_label_histogram", f"WITH {POINTS} SELECT drive_id, label, count(*) AS n FROM points GROUP BY ALL")
def agg_3(s, d):
    return P.label_histogram(points(s, d), "label", ["drive_id"])


@query("agg_4_mapping_coverage", f"WITH {POINTS} SELECT drive_id, count(*) AS total, count(*) FILTER (label = 5) AS ignored, count(*) FILTER (label = 5) / count(*)::DOUBLE AS ignored_fraction FROM points GROUP BY drive_id")
def agg_4(s, d):
    return P.mapping_coverage(P.map_labels(points(s, d), P.TILE_CLASSES), ["drive_id"])


_PATCH = f"""{POINTS}, patches AS (SELECT {FR}, CAST(floor((y::DOUBLE - min(y) OVER w) / 25::DOUBLE) AS INT) AS r, CAST(floor((x::DOUBLE - min(x) OVER w) / 25::DOUBLE) AS INT) AS c, x, y, z, label FROM points WINDOW w AS (PARTITION BY {FR}))"""


@query("agg_5_grid_partition", f"""WITH {_PATCH}, g AS (SELECT {FR}, r, c, count(*) AS n FROM patches GROUP BY ALL)
SELECT {FR}, max(r) + 1 AS rows, max(c) + 1 AS cols, count(*) AS occupied, CAST(sum(n) AS BIGINT) AS n_points, min(n) AS min_points, max(n) AS max_points, CAST((max(r) + 1) * (max(c) + 1) - count(*) AS BIGINT) AS empty FROM g GROUP BY ALL""")
def agg_5(s, d):
    return P.grid_partition(points(s, d), 25.0)


@query("agg_6_scan_audit", f"""WITH {POINTS} SELECT {FR}, count(*) AS n_points, min(x)::DOUBLE AS min_x, max(z)::DOUBLE AS max_z, count(*) FILTER (label = 5) AS ignored, count(*) FILTER (label = 5) / nullif(count(*), 0)::DOUBLE AS ignored_fraction FROM points GROUP BY ALL""")
def agg_6(s, d):
    return _audited(points(s, d), FRAME).drop("frames")


def _audited(p, keys):
    out = P.map_labels(p, P.TILE_CLASSES).groupBy(*keys).agg(F.countDistinct("frame_index").alias("frames"), F.count("*").alias("n_points"), F.min("x").cast("double").alias("min_x"), F.max("z").cast("double").alias("max_z"), F.count_if(F.col("shared_label") == -1).alias("ignored"))
    return out.withColumn("ignored_fraction", fraction(F.col("ignored"), F.col("n_points")))


@query("agg_6_whole_scan_audit", f"""WITH {POINTS} SELECT drive_id, count(DISTINCT frame_index) AS frames, count(*) AS n_points, min(x)::DOUBLE AS min_x, max(z)::DOUBLE AS max_z, count(*) FILTER (label = 5) AS ignored, count(*) FILTER (label = 5) / nullif(count(*), 0)::DOUBLE AS ignored_fraction FROM points GROUP BY drive_id""")
def agg_6_whole(s, d):
    return _audited(points(s, d), ["drive_id"])


@query("agg_7_tile_audit", f"""WITH {_PATCH}, n AS (SELECT {FR}, r, c, count(*) AS n, max(CAST(z - z0 AS FLOAT)) AS height FROM (SELECT *, min(z) OVER (PARTITION BY {FR}, r, c) AS z0 FROM patches) GROUP BY ALL)
SELECT drive_id, count(*) AS patches, CAST(sum(n) AS BIGINT) AS n_points, median(n) AS median_points, max(height)::DOUBLE AS max_height FROM n GROUP BY drive_id""")
def agg_7(s, d):
    cells = P.min_xyz(P.grid_cells(points(s, d), 25.0), [*FRAME, "patch_row", "patch_col"])
    per = cells.groupBy(*FRAME, "patch_row", "patch_col").agg(F.count("*").alias("n"), F.max("z").alias("height"))
    return per.groupBy("drive_id").agg(F.count("*").alias("patches"), F.sum("n").alias("n_points"), F.median("n").alias("median_points"), F.max("height").cast("double").alias("max_height"))


@query("agg_8_repeatability", f"WITH {POINTS} SELECT {FR}, count(*) AS n, count(*) FILTER (row_idx = 7 AND frame_index % 6 = 1) = 0 AS repeatable FROM points GROUP BY ALL")
def agg_8(s, d):
    """Digests of three runs: two as they are, the second from a table that was written and read back in another order, and one in which a point was altered."""
    from sweepframe.sources.scratch import scratch_folder

    p, path = points(s, d), scratch_folder(s, "points")
    p.repartition(7, "row_idx").sortWithinPartitions(F.desc("x")).write.parquet(path)
    altered = p.withColumn("z", F.when((F.col("row_idx") == 7) & (F.col("frame_index") % 6 == 1), F.col("z") + 1).otherwise(F.col("z")).cast("float"))
    runs = [P.digests(x, [*FRAME, "row_idx", "x", "y", "z"]) for x in (p, s.read.parquet(path), altered)]
    return runs[0].union(runs[1]).union(runs[2]).groupBy(*FRAME).agg(F.max("n").alias("n"), (F.countDistinct("digest") == 1).alias("repeatable"))


@query("set_1_concatenation", f"WITH {POINTS} SELECT drive_id, count(*) AS n FROM (SELECT * FROM points WHERE label < 4 UNION ALL SELECT * FROM points WHERE label > 2) GROUP BY drive_id")
def set_1(s, d):
    p = points(s, d)
    return p.where("label < 4").unionByName(p.where("label > 2")).groupBy("drive_id").agg(F.count("*").alias("n"))


@query("set_4_equal_sets", f"WITH {POINTS}, a AS (SELECT DISTINCT {FR} FROM points WHERE label = 1), b AS (SELECT DISTINCT {FR} FROM points WHERE label = 7) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS equal")
def set_4(s, d):
    p = points(s, d)
    a, b = (p.where(f"label = {k}").select(*FRAME).distinct().withColumn(f"s{k}", F.lit(1)) for k in (1, 7))
    out = a.join(b, FRAME, "full").agg(F.count_if(F.col("s7").isNull()).alias("only_a"), F.count_if(F.col("s1").isNull()).alias("only_b"))
    return out.withColumn("equal", F.col("only_a") + F.col("only_b") == 0)


@query("str_2_ids", f"WITH {POINTS} SELECT DISTINCT drive_id || '/' || lpad(CAST(frame_index AS VARCHAR), 10, '0') AS frame_id, lpad(CAST(frame_index AS VARCHAR), 2, '0') AS sequence FROM points")
def str_2(s, d):
    from sweepframe.functions.numeric import frame_id

    return frames(s, d).select(frame_id(F.col("drive_id"), F.col("frame_index")).alias("frame_id"), F.lpad(F.col("frame_index").cast("string"), 2, "0").alias("sequence"))


@query("map_1_metadata_append", f"WITH {GT} SELECT track_id, 'min_xyz,score_threshold=' || (track_id % 5) AS history FROM gt")
def map_1(s, d):
    base = F.create_map(F.lit("history"), F.lit("min_xyz"))
    more = F.map_zip_with(base, F.create_map(F.lit("history"), F.concat(F.lit("score_threshold="), (F.col("track_id") % 5).cast("string"))), lambda k, a, b: F.concat_ws(",", a, b))
    return ground_truth(s, d).select("track_id", more["history"].alias("history"))


@query("sel_9_norm_picks", f"""WITH {POINTS}, r AS (SELECT {FR}, row_idx, row_number() OVER (PARTITION BY {FR} ORDER BY x::DOUBLE * x + y::DOUBLE * y + z::DOUBLE * z, row_idx) - 1 AS k, count(*) OVER (PARTITION BY {FR}) AS n FROM points)
SELECT {FR}, row_idx, CASE WHEN k = 0 THEN 'min' WHEN k = n // 2 THEN 'median' ELSE 'max' END AS pick FROM r WHERE k IN (0, n // 2, n - 1)""")
def sel_9(s, d):
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    w = Window.partitionBy(*FRAME)
    r = points(s, d).withColumn("norm", x * x + y * y + z * z).withColumn("k", F.row_number().over(w.orderBy("norm", "row_idx")) - 1).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    return r.where((F.col("k") == 0) | (F.col("k") == half) | (F.col("k") == F.col("n") - 1)).select(*FRAME, "row_idx", F.when(F.col("k") == 0, "min").when(F.col("k") == half, "median").otherwise("max").alias("pick"))


@query("sel_2_first_frames", f"WITH {POINTS} SELECT {FR} FROM (SELECT {FR}, row_number() OVER (PARTITION BY drive_id ORDER BY frame_index) AS k FROM (SELECT DISTINCT {FR} FROM points)) WHERE k <= 5")
def sel_2(s, d):
    return frames(s, d).withColumn("k", F.row_number().over(Window.partitionBy("drive_id").orderBy("frame_index"))).where("k <= 5").select(*FRAME)
