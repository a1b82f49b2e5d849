"""Queries that pick frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe.operators import selection as L
from sweepframe.plans.fixtures import FRAME
from sweepframe.plans.voxels import PILLARS, pillars
from sweepframe.registry import query

COUNTS = f"{PILLARS}, n AS (SELECT drive_id, frame_index, count(*) AS n, count(*) FILTER (touch_rank >= 20) AS lost FROM pillars GROUP BY ALL)"


def counts(s, d):
    return pillars(s, d).groupBy(*FRAME).agg(F.count("*").alias("n"), F.count_if(~F.col("retained")).alias("lost"))


@query("sel_5_spanning_picks")
def sel_5(s, d):
    return L.spanning(counts(s, d), "n", 12, ["drive_id"], "frame_index")


@query("sel_7_gap_picks", f"""WITH {COUNTS}, a AS (SELECT drive_id, arg_min(frame_index, {{'d': abs(n - 70), 'i': frame_index}}) AS frame_index FROM n WHERE abs(n - 70) <= 10 GROUP BY drive_id),
b AS (SELECT drive_id, arg_min(frame_index, {{'d': abs(n - 75), 'i': frame_index}}) AS frame_index FROM n ANTI JOIN a USING (drive_id, frame_index) WHERE abs(n - 75) <= 10 GROUP BY drive_id)
SELECT *, 'target_70' AS role FROM a UNION ALL SELECT *, 'target_75' FROM b""")
def sel_7(s, d):
    return L.nearest_to(counts(s, d), "n", [70, 75], 10, ["drive_id"], "frame_index")


@query("sel_8_role_sentinels", f"""WITH {COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY n, frame_index) AS k, count(*) OVER (PARTITION BY drive_id) AS c FROM n), a AS (SELECT drive_id, min(frame_index) AS frame_index FROM n GROUP BY drive_id),
m AS (SELECT drive_id, arg_min(frame_index, {{'l': k < (c - 1) // 2 + 1, 'k': k}}) AS frame_index FROM k ANTI JOIN a USING (drive_id, frame_index) GROUP BY drive_id),
b AS (SELECT drive_id, arg_min(frame_index, {{'d': -lost, 'n': -n, 'i': frame_index}}) AS frame_index FROM n ANTI JOIN (FROM a UNION ALL FROM m) USING (drive_id, frame_index) WHERE frame_index % 3 = 0 GROUP BY drive_id),
c AS (SELECT drive_id, arg_min(frame_index, {{'d': abs(n - 75), 'i': frame_index}}) AS frame_index FROM n ANTI JOIN (FROM a UNION ALL FROM m UNION ALL FROM b) USING (drive_id, frame_index) WHERE lost < 60 GROUP BY drive_id),
e AS (SELECT drive_id, min(frame_index) AS frame_index FROM n ANTI JOIN (FROM a UNION ALL FROM m UNION ALL FROM b UNION ALL FROM c) USING (drive_id, frame_index) WHERE n % 2 = 0 GROUP BY drive_id)
SELECT *, 'first' AS role FROM a UNION ALL SELECT *, 'lower_median' FROM m UNION ALL SELECT *, 'overflow' FROM b UNION ALL SELECT *, 'nearest' FROM c UNION ALL SELECT *, 'eligible' FROM e""")
def sel_8(s, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("drive_id")
    ranked = counts(s, d).withColumn("k", F.row_number().over(w.orderBy("n", "frame_index"))).withColumn("c", F.count("*").over(w))
    i, every = F.col("frame_index"), F.lit(True)
    # The lower median and those after it come first, then the rest from the start.
    roles = {
        "first": (every, F.struct(i)), "lower_median": (every, F.struct(F.col("k") < F.floor((F.col("c") - 1) / 2) + 1, "k")), "overflow": (i % 3 == 0, F.struct(-F.col("lost"), -F.col("n"), i)),
        "nearest": (F.col("lost") < 60, F.struct(F.abs(F.col("n") - 75), i)), "eligible": (F.col("n") % 2 == 0, F.struct(i)),
    }
    return L.first_unused(ranked, roles, ["drive_id"], "frame_index")


@query("agg_52_drive_census", f"WITH {COUNTS} SELECT drive_id, count(*) AS frames, min(n) AS min, quantile_disc(n, 0.5) AS p50, max(n) AS max, count(*) FILTER (lost > 0) AS overflow FROM n GROUP BY drive_id")
def agg_52(s, d):
    return counts(s, d).groupBy("drive_id").agg(F.count("*").alias("frames"), F.min("n").alias("min"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("p50"), F.max("n").alias("max"), F.count_if(F.col("lost") > 0).alias("overflow"))
