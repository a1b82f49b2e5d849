"""Queries on current-plus-history reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions.numeric import ns_to_us
from sweepframe.operators import sweeps as S
from sweepframe.operators.fidelity import first_mismatch
from sweepframe.plans.fixtures import FRAME, POINTS, POSES, frames, points, poses
from sweepframe.registry import query

FR = "drive_id, frame_index"
DEPTH = 3
HISTORY = f"""hist AS (SELECT c.drive_id, c.frame_index, CAST(k AS INT) AS history_rank, s.frame_index AS source_index FROM frames c, range(0, {DEPTH + 1}) r(k) JOIN frames s ON s.drive_id = c.drive_id AND s.frame_index = c.frame_index - k)"""
TRANSFORMS = f"""{POSES}, {HISTORY}, tf AS (SELECT h.*, s.yaw - c.yaw AS turn, s.tx - c.tx AS dx, s.ty - c.ty AS dy, s.tz - c.tz AS dz, c.yaw AS cyaw, c.ts_ns // 1000 AS cur_us, s.ts_ns // 1000 AS src_us
  FROM hist h JOIN poses c ON c.drive_id = h.drive_id AND c.frame_index = h.frame_index JOIN poses s ON s.drive_id = h.drive_id AND s.frame_index = h.source_index)"""


def transforms(s, d):
    return S.sweep_transforms(S.history_index(frames(s, d), DEPTH), poses(s, d))


def reconstructed(s, d):
    stamps = frames(s, d).select(*FRAME, ns_to_us(F.col("ts_ns")).alias("ts_us"))
    return S.model_points(points(s, d), transforms(s, d), stamps, 1.0)


#: Only the current sweep and yaw-free fields are compared bit by bit; moved points are counted well away from the crop's faces.
MOVED = f"""{POINTS}, {TRANSFORMS}, moved AS (SELECT tf.drive_id, tf.frame_index, history_rank, row_idx, CAST(cur_us / 1e6::DOUBLE - src_us / 1e6::DOUBLE AS FLOAT) AS time_lag,
  CASE WHEN history_rank = 0 THEN x ELSE CAST(CAST(x::DOUBLE * CAST(cos(turn) AS FLOAT)::DOUBLE + y::DOUBLE * CAST(-sin(turn) AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE - CAST(-(cos(cyaw) * dx + sin(cyaw) * dy) AS FLOAT)::DOUBLE AS FLOAT) END AS x,
  CASE WHEN history_rank = 0 THEN y ELSE CAST(CAST(x::DOUBLE * CAST(sin(turn) AS FLOAT)::DOUBLE + y::DOUBLE * CAST(cos(turn) AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE - CAST(-(cos(cyaw) * dy - sin(cyaw) * dx) AS FLOAT)::DOUBLE AS FLOAT) END AS y,
  CASE WHEN history_rank = 0 THEN z ELSE CAST(z::DOUBLE - CAST(-dz AS FLOAT)::DOUBLE AS FLOAT) END AS z
  FROM points p JOIN tf ON p.drive_id = tf.drive_id AND p.frame_index = tf.source_index WHERE history_rank = 0 OR NOT (abs(x) < 1 AND abs(y) < 1)),
model AS (SELECT * FROM moved WHERE x > -50 AND x < 50 AND y > -50 AND y < 50 AND z > -5 AND z < 3)"""


@query("jn_3_history_index", f"WITH {POSES}, {HISTORY} SELECT * FROM hist")
def jn_3(s, d):
    return S.history_index(frames(s, d), DEPTH)


@query("jn_5_sweep_transforms", f"WITH {TRANSFORMS} SELECT {FR}, history_rank, round(cos(turn), 5) AS a00, round(-(cos(cyaw) * dx + sin(cyaw) * dy), 4) + 0 AS b0, round(-dz, 4) + 0 AS b2 FROM tf")
def jn_5(s, d):
    t = transforms(s, d)
    return t.select(*FRAME, "history_rank", F.round(F.col("a")[0].cast("double"), 5).alias("a00"), (F.round(F.col("b")[0].cast("double"), 4) + 0.0).alias("b0"), (F.round(F.col("b")[2].cast("double"), 4) + 0.0).alias("b2"))


@query("jn_4_model_points", f"WITH {MOVED} SELECT {FR}, history_rank, count(*) AS n, min(time_lag) AS time_lag, round(min(x)::DOUBLE, 2) AS x, round(max(y)::DOUBLE, 2) AS y FROM model GROUP BY ALL")
def jn_4(s, d):
    return reconstructed(s, d).groupBy(*FRAME, "history_rank").agg(F.count("*").alias("n"), F.min("time_lag").alias("time_lag"), F.round(F.min("x").cast("double"), 2).alias("x"), F.round(F.max("y").cast("double"), 2).alias("y"))


def frozen(s, d):
    """The transforms as a table that was written once and is read back."""
    from sweepframe.sources.scratch import scratch_folder

    path = scratch_folder(s, "transforms")
    transforms(s, d).write.parquet(path)
    return s.read.parquet(path)


def digested(t):
    return t.groupBy(*FRAME).agg(F.count("*").alias("transforms"), F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("history_rank", "source_index", "a", "b")))).cast("binary"), 256).alias("digest"))


@query("jn_6_frozen_transforms", f"WITH {TRANSFORMS}, t AS (SELECT *, frame_index % 9 = 4 AND history_rank = 2 AS spoiled FROM tf) SELECT {FR}, count(*) AS transforms, NOT bool_or(spoiled) AS same FROM t GROUP BY ALL")
def jn_6(s, d):
    """A replay from the stored table is accepted where rank order, sources and digest of all its transforms agree; here some were altered in store."""
    stored = frozen(s, d)
    bad = (F.col("frame_index") % 9 == 4) & (F.col("history_rank") == 2)
    stored = stored.withColumn("b", F.when(bad, F.transform("b", lambda x: x + F.lit(0.5).cast("float"))).otherwise(F.col("b")))
    both = digested(transforms(s, d)).join(digested(stored).withColumnsRenamed({"transforms": "n", "digest": "stored"}), FRAME, "full")
    return both.select(*FRAME, "transforms", (F.col("transforms").eqNullSafe(F.col("n")) & F.col("digest").eqNullSafe(F.col("stored"))).alias("same"))


@query("jn_6_replayed_points", f"WITH {MOVED} SELECT {FR}, history_rank, count(*) AS n FROM model GROUP BY ALL")
def jn_6_replayed(s, d):
    stamps = frames(s, d).select(*FRAME, ns_to_us(F.col("ts_ns")).alias("ts_us"))
    return S.model_points(points(s, d), frozen(s, d), stamps, 1.0).groupBy(*FRAME, "history_rank").agg(F.count("*").alias("n"))


@query("jn_20_membership_difference", f"WITH {MOVED}, other AS (SELECT * FROM moved WHERE x > -49 AND x < 49 AND y > -50 AND y < 50 AND z > -5 AND z < 3) SELECT history_rank, count(*) FILTER (o.row_idx IS NULL) AS only_a, count(*) FILTER (m.row_idx IS NULL) AS only_b FROM model m FULL JOIN other o USING (drive_id, frame_index, history_rank, row_idx) GROUP BY history_rank")
def jn_20(s, d):
    a = reconstructed(s, d)
    return S.membership_difference(a, a.where("x > -49 and x < 49"), [*FRAME, "history_rank", "src_row_idx"], ["history_rank"])


@query("jn_21_provenance", f"WITH {MOVED} SELECT {FR}, history_rank, CASE WHEN history_rank = 0 THEN 'current' ELSE 'history' END AS role, min(row_idx) AS first_row, max(row_idx) AS last_row FROM model GROUP BY ALL")
def jn_21(s, d):
    role = F.when(F.col("history_rank") == 0, "current").otherwise("history")
    return reconstructed(s, d).groupBy(*FRAME, "history_rank", role.alias("role")).agg(F.min("src_row_idx").alias("first_row"), F.max("src_row_idx").alias("last_row"))


@query("jn_26_ledger_verification", f"""WITH {MOVED}, a AS (SELECT {FR}, count(*) AS n, count(DISTINCT time_lag) AS lags, array_to_string(list_sort(list(DISTINCT frame_index - history_rank)), ',') AS sources FROM model GROUP BY ALL),
l AS (SELECT {FR}, n + CASE WHEN frame_index % 10 = 3 THEN 1 ELSE 0 END AS n, lags, CASE WHEN frame_index % 10 = 6 THEN sources || ',99' ELSE sources END AS sources, frame_index % 10 = 8 AS spoiled FROM a WHERE frame_index % 10 <> 9)
SELECT coalesce(a.drive_id, l.drive_id) AS drive_id, coalesce(a.frame_index, l.frame_index) AS frame_index, CASE WHEN l.n IS NULL THEN 'unrecorded' WHEN a.n IS NULL THEN 'absent' ELSE concat_ws(',', CASE WHEN a.n <> l.n THEN 'points' END, CASE WHEN a.lags <> l.lags THEN 'lags' END, CASE WHEN a.sources <> l.sources THEN 'sources' END, CASE WHEN spoiled THEN 'digest' END) END AS reason
FROM a FULL JOIN l USING (drive_id, frame_index) WHERE l.n IS NULL OR a.n IS NULL OR a.n <> l.n OR a.lags <> l.lags OR a.sources <> l.sources OR spoiled""")
def jn_26(s, d):
    """Frames whose points, lags, sources or digest differ from a ledger that an earlier run wrote; here some of its entries were altered, one in ten is missing."""
    from sweepframe.sources.scratch import scratch_folder

    actual = S.input_ledger(reconstructed(s, d))
    path, k = scratch_folder(s, "ledger"), F.col("frame_index") % 10
    actual.where(k != 9).withColumns({
        "points": F.col("points") + F.when(k == 3, 1).otherwise(0), "sources": F.when(k == 6, F.concat("sources", F.array(F.lit(99).cast("long")))).otherwise(F.col("sources")),
        "digest": F.when(k == 8, F.col("digest") + 1).otherwise(F.col("digest")),
    }).write.parquet(path)
    return S.ledger_mismatches(actual, s.read.parquet(path))


@query("jn_19_first_mismatch", f"WITH {POINTS}, b AS (SELECT * REPLACE (CASE WHEN row_idx % 97 = 5 THEN label + 1 ELSE label END AS label) FROM points) SELECT {FR}, count(*) AS rows, count(*) FILTER (a.label IS DISTINCT FROM b.label) AS mismatches, min(row_idx) FILTER (a.label IS DISTINCT FROM b.label) AS first_row FROM points a FULL JOIN b USING (drive_id, frame_index, row_idx) GROUP BY ALL")
def jn_19(s, d):
    a = points(s, d)
    b = a.withColumn("label", F.when(F.col("row_idx") % 97 == 5, F.col("label") + 1).otherwise(F.col("label")))
    return first_mismatch(a, b, [*FRAME, "row_idx"], ["label"], FRAME).select(*FRAME, "rows", "mismatches", F.col("first.row_idx").alias("first_row"))


@query("agg_40_reconstruction_invariants", f"WITH {MOVED}, g AS (SELECT {FR}, history_rank, count(*) AS n, count(DISTINCT time_lag) AS lags, min(time_lag) AS lag_s FROM model GROUP BY ALL), o AS (SELECT *, coalesce(lag_s > lag(lag_s) OVER (PARTITION BY {FR} ORDER BY history_rank), true) AS up FROM g) SELECT {FR}, max(history_rank) AS depth, CAST(sum(n) AS BIGINT) AS in_range, bool_and(lags = 1) AS constant_lags, bool_and(up) AS increasing FROM o GROUP BY ALL")
def agg_40(s, d):
    g = reconstructed(s, d).groupBy(*FRAME, "history_rank").agg(F.count("*").alias("n"), F.countDistinct("time_lag").alias("lags"), F.min("time_lag").alias("lag_s"))
    w = Window.partitionBy(*FRAME).orderBy("history_rank")
    g = g.withColumn("up", F.coalesce(F.col("lag_s") > F.lag("lag_s").over(w), F.lit(True)))
    return g.groupBy(*FRAME).agg(F.max("history_rank").alias("depth"), F.sum("n").alias("in_range"), F.bool_and(F.col("lags") == 1).alias("constant_lags"), F.bool_and("up").alias("increasing"))


@query("agg_41_condition_summary", f"WITH {MOVED}, c AS (SELECT *, 'H3' AS condition FROM model UNION ALL SELECT *, 'H1' FROM model WHERE history_rank <= 1), f AS (SELECT condition, {FR}, count(*) AS n, max(history_rank) AS depth FROM c GROUP BY ALL) SELECT condition, count(*) AS frames, avg(n) AS mean_points, median(n) AS median_points, max(depth) AS depth FROM f GROUP BY condition")
def agg_41(s, d):
    m = reconstructed(s, d).withColumn("condition", F.explode(F.when(F.col("history_rank") <= 1, F.array(F.lit("H3"), F.lit("H1"))).otherwise(F.array(F.lit("H3")))))
    f = m.groupBy("condition", *FRAME).agg(F.count("*").alias("n"), F.max("history_rank").alias("depth"))
    return f.groupBy("condition").agg(F.count("*").alias("frames"), F.avg("n").alias("mean_points"), F.median("n").alias("median_points"), F.max("depth").alias("depth"))
