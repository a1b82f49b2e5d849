"""Queries on arrival logs, telemetry and rates, among them the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.operators import metrics as M
from sweepframe.plans.fixtures import MESSAGES, TELEMETRY, messages, telemetry
from sweepframe.registry import query
from sweepframe.streaming import history as H

GAP = 3_600_000_000
TWIN = f"""{MESSAGES}, r AS (SELECT *, CASE WHEN stamp_us <= p THEN 'time_regression' WHEN stamp_us - p > {GAP} THEN 'gap' END AS reset FROM (SELECT *, lag(stamp_us) OVER (PARTITION BY sensor ORDER BY arrival_seq) AS p FROM msg)),
g AS (SELECT *, count(reset) OVER (PARTITION BY sensor ORDER BY arrival_seq) AS session FROM r),
twin AS (SELECT sensor, arrival_seq, reset, CAST(least(10, row_number() OVER (PARTITION BY sensor, session ORDER BY arrival_seq) - 1) AS INT) AS depth FROM g)"""


@query("stm_1_2_history", f"WITH {TWIN} SELECT * FROM twin")
def stm_1(s, d):
    return H.batch_history(messages(s, d), 10, GAP)


@query("stm_3_resets", f"WITH {TWIN} SELECT sensor, count(*) FILTER (reset = 'gap') AS gaps, count(*) FILTER (reset = 'time_regression') AS regressions, max(depth) AS depth FROM twin GROUP BY sensor")
def stm_3(s, d):
    return H.batch_history(messages(s, d), 10, GAP).groupBy("sensor").agg(F.count_if(F.col("reset") == "gap").alias("gaps"), F.count_if(F.col("reset") == "time_regression").alias("regressions"), F.max("depth").alias("depth"))


@query("stm_7_tumbling_rollup", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, avg(value) AS mean, max(value) AS max FROM events GROUP BY ALL")
def stm_7(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return H.windowed_latency(e, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stm_8_block_samples", f"WITH {TELEMETRY}, b AS (SELECT block, min(ts_us) AS t0, max(ts_us) AS t1 FROM tel GROUP BY block) SELECT b.block, count(*) AS samples, avg(power_draw) AS power FROM b JOIN tel ON ts_us BETWEEN t0 AND t1 GROUP BY b.block")
def stm_8(s, d):
    t = telemetry(s, d)
    blocks = t.groupBy("block").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    # A block meets only the days that it lies in.
    days = blocks.select("block", "t0", "t1", F.explode(F.sequence(F.floor(F.col("t0") / 86400000000), F.floor(F.col("t1") / 86400000000))).alias("day"))
    rows = t.select("ts_us", "power_draw", F.floor(F.col("ts_us") / 86400000000).alias("day")).join(days, "day").where("ts_us between t0 and t1")
    return rows.groupBy("block").agg(F.count("*").alias("samples"), F.avg("power_draw").alias("power"))


@query("stm_9_keep_last", f"WITH {MESSAGES} SELECT sensor, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY arrival_seq DESC) AS k FROM msg) WHERE k <= 5")
def stm_9(s, d):
    return H.keep_last(messages(s, d), 5, ["sensor"], "arrival_seq").select("sensor", "arrival_seq")


@query("jn_22_dropped_inputs", f"WITH {MESSAGES}, a AS (SELECT sensor, min(ts_us) AS t0, max(ts_us) AS t1 FROM msg WHERE event_type <> 'error' GROUP BY sensor) SELECT m.sensor, count(*) AS dropped FROM msg m JOIN a ON m.sensor = a.sensor AND ts_us BETWEEN t0 AND t1 WHERE event_type = 'error' GROUP BY m.sensor")
def jn_22(s, d):
    m = messages(s, d)
    accepted = m.where("event_type <> 'error'")
    span = accepted.groupBy("sensor").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    inside = m.join(span, "sensor").where("ts_us between t0 and t1")
    return inside.join(accepted.select("sensor", "arrival_seq"), ["sensor", "arrival_seq"], "left_anti").groupBy("sensor").agg(F.count("*").alias("dropped"))


@query("win_6_intervals", f"WITH {MESSAGES} SELECT sensor, arrival_seq, (ts_us - lag(ts_us) OVER (PARTITION BY sensor ORDER BY arrival_seq)) / 1000::DOUBLE AS interval_ms FROM msg")
def win_6(s, d):
    w = Window.partitionBy("sensor").orderBy("arrival_seq")
    return messages(s, d).select("sensor", "arrival_seq", ((F.col("ts_us") - F.lag("ts_us").over(w)) / 1000.0).alias("interval_ms"))


HALVES = f"{MESSAGES}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sensor ORDER BY arrival_seq) <= count(*) OVER (PARTITION BY sensor) // 2 THEN 'first' ELSE 'second' END AS half FROM msg)"


@query("win_7_half_runs", f"WITH {HALVES} SELECT sensor, median(value) FILTER (half = 'first') AS first, median(value) FILTER (half = 'second') AS second, median(value) FILTER (half = 'second') > median(value) FILTER (half = 'first') AS grows FROM h GROUP BY sensor")
def win_7(s, d):
    w = Window.partitionBy("sensor")
    h = messages(s, d).withColumn("first", F.row_number().over(w.orderBy("arrival_seq")) <= F.floor(F.count("*").over(w) / 2))
    out = h.groupBy("sensor").agg(*(F.median(F.when(c, F.col("value"))).alias(n) for n, c in (("first", F.col("first")), ("second", ~F.col("first")))))
    return out.withColumn("grows", F.col("second") > F.col("first"))


@query("win_8_time_halves", f"WITH {MESSAGES}, x AS (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM msg) SELECT arrival_seq, CASE WHEN ts_us < t0 + (t1 - t0) // 2 THEN 'first' ELSE 'second' END AS half FROM msg, x")
def win_8(s, d):
    m = messages(s, d)
    span = m.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    return m.crossJoin(F.broadcast(span)).select("arrival_seq", F.when(F.col("ts_us") < F.col("t0") + F.floor((F.col("t1") - F.col("t0")) / 2), "first").otherwise("second").alias("half"))


@query("agg_27_telemetry_rollup", f"WITH {TELEMETRY} SELECT count(*) AS samples, count(*) FILTER (available) AS available, count(DISTINCT pstate) AS pstates, min(clocks_sm) AS min, median(clocks_sm) AS median, avg(clocks_sm) AS mean, max(clocks_sm) AS max FROM tel")
def agg_27(s, d):
    return telemetry(s, d).agg(F.count("*").alias("samples"), F.count_if("available").alias("available"), F.countDistinct("pstate").alias("pstates"), F.min("clocks_sm").alias("min"), F.median("clocks_sm").alias("median"), F.avg("clocks_sm").alias("mean"), F.max("clocks_sm").alias("max"))


@query("agg_28_block_rollup", f"WITH {TELEMETRY} SELECT block, pstate, count(*) AS n, median(power_draw) AS median FROM tel WHERE available GROUP BY ALL")
def agg_28(s, d):
    return telemetry(s, d).where("available and block is not null").groupBy("block", "pstate").agg(F.count("*").alias("n"), F.median("power_draw").alias("median"))


@query("agg_29_paired_eligibility", f"WITH {TELEMETRY}, b AS (SELECT block, min(clocks_sm) AS lo, max(clocks_sm) AS hi, list_sort(list(DISTINCT pstate)) AS states FROM tel GROUP BY block) SELECT a.block AS first, c.block AS second, NOT (NOT list_has_any(a.states, c.states) AND greatest(a.lo, c.lo) > least(a.hi, c.hi)) AS eligible FROM b a JOIN b c ON a.block < c.block")
def agg_29(s, d):
    b = telemetry(s, d).groupBy("block").agg(F.min("clocks_sm").alias("lo"), F.max("clocks_sm").alias("hi"), F.collect_set("pstate").alias("states"))
    a, c = b.alias("a"), b.alias("c")
    apart = ~F.arrays_overlap("a.states", "c.states") & (F.greatest("a.lo", "c.lo") > F.least("a.hi", "c.hi"))
    return a.join(c, F.col("a.block") < F.col("c.block")).select(F.col("a.block").alias("first"), F.col("c.block").alias("second"), (~apart).alias("eligible"))


@query("agg_30_session_eligibility", f"WITH {TELEMETRY}, b AS (SELECT block, count(DISTINCT pstate) AS states, max(power_draw) AS power FROM tel GROUP BY block) SELECT block, concat_ws(',', CASE WHEN states > 1 THEN 'mixed_states' END, CASE WHEN power > 100 THEN 'power' END) AS reasons FROM b")
def agg_30(s, d):
    b = telemetry(s, d).groupBy("block").agg(F.countDistinct("pstate").alias("states"), F.max("power_draw").alias("power"))
    reasons = F.array_union(F.array_compact(F.array(F.when(F.col("states") > 1, "mixed_states"))), F.array_compact(F.array(F.when(F.col("power") > 100, "power"))))
    return b.select("block", F.array_join(reasons, ",").alias("reasons"))


@query("agg_46_deadline_misses", "SELECT event_type, count(*) FILTER (value > 50) AS misses, count(*) FILTER (value > 50) / count(*)::DOUBLE AS fraction FROM events GROUP BY event_type")
def agg_46(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("misses"), (F.count_if(F.col("value") > 50) / F.count("*")).alias("fraction"))


@query("agg_47_rates", f"""WITH {MESSAGES}, v AS (SELECT *, arrival_seq % 41 <> 0 OR sensor = 2 AS received, arrival_seq % 53 <> 0 OR sensor <> 1 AS sent FROM msg),
c AS (SELECT sensor, count(*) AS offered, count(*) FILTER (received) AS received, count(*) FILTER (received AND (event_type <> 'error' OR sensor = 2)) AS accepted, count(*) FILTER (received AND (event_type <> 'error' OR sensor = 2) AND sent) AS published, (max(ts_us) - min(ts_us)) / 1e6::DOUBLE AS span,
  (max(ts_us) FILTER (received AND (event_type <> 'error' OR sensor = 2) AND sent) - min(ts_us) FILTER (received AND (event_type <> 'error' OR sensor = 2) AND sent)) / 1e6::DOUBLE AS out_span FROM v GROUP BY sensor),
r AS (SELECT sensor, (offered - 1) / span AS offered_hz, (published - 1) / out_span AS output_hz, offered - received AS input_loss, received - accepted AS rejected, accepted - published AS backlog, 0.0004::DOUBLE AS rate FROM c)
SELECT sensor, offered_hz, output_hz, input_loss, rejected, backlog, CASE WHEN input_loss > 0 OR rejected > 0 OR backlog > 0 THEN 'lossy' WHEN offered_hz < 0.95 * rate THEN 'not_offered' WHEN output_hz < 0.95 * rate THEN 'not_sustained' ELSE 'sustained' END AS verdict FROM r""")
def agg_47(s, d):
    """Rates by intervals, losses between the stages, and whether the asked rate of 0.0004 Hz is sustained."""
    n = F.col("arrival_seq")
    accepted = F.col("received") & ((F.col("event_type") != "error") | (F.col("sensor") == 2))
    v = messages(s, d).withColumns({"received": (n % 41 != 0) | (F.col("sensor") == 2), "sent": (n % 53 != 0) | (F.col("sensor") != 1)}).withColumn("accepted", accepted).withColumn("published", F.col("accepted") & F.col("sent"))
    return M.sustained_rates(v, ["sensor"], "ts_us", 0.0004)


@query("agg_54_stage_ledger", "WITH t AS (SELECT event_type, event_id % 500 AS i, value FROM events), p AS (SELECT i, sum(value) AS total FROM t GROUP BY i) SELECT event_type, count(*) AS n, median(value) AS median, quantile_cont(value, 0.95) AS p95 FROM t GROUP BY event_type UNION ALL SELECT 'total', count(*), median(total), quantile_cont(total, 0.95) FROM p")
def agg_54(s, d):
    t = s.read.parquet(f"{d}/events.parquet").select("event_type", (F.col("event_id") % 500).alias("i"), "value")
    total = t.groupBy("i").agg(F.sum("value").alias("value")).withColumn("event_type", F.lit("total"))
    return M.describe(t.select("event_type", "value").unionByName(total.select("event_type", "value")), "value", ["event_type"]).select("event_type", "n", "median", "p95")


@query("src_18_layout_rules", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'dimensions' WHEN event_id % 11 = 0 THEN 'length' END AS problem FROM events")
def src_18(s, d):
    from sweepframe.sources.binary import layout_problem

    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(4 * i).alias("offset"), F.lit(7).alias("datatype"), F.lit(1).alias("count")) for i, n in enumerate("xyz")))
    m = s.read.parquet(f"{d}/events.parquet").select("event_id", F.lit(1).alias("height"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(2).alias("width"), fields.alias("fields"), F.lit(12).alias("point_step"), F.lit(24).alias("row_step"), F.lit(False).alias("is_bigendian"), F.repeat(F.lit("x"), F.when(F.col("event_id") % 11 == 0, 23).otherwise(24)).cast("binary").alias("data"))
    return layout_problem(m).select("event_id", "problem")


@query("src_21_telemetry_rows", "SELECT event_id, event_id % 5 <> 0 AS valid, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS temperature, CAST(NULL AS DOUBLE) AS power_limit FROM events")
def src_21(s, d):
    from sweepframe.sources.text import telemetry_rows

    t = (F.col("event_id") % 90).cast("string")
    full = F.concat(F.lit("gpu, 1.2, P0, "), t, F.lit(", 49.2, N/A, 2250, 8001, 98, 14"))
    lines = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("gpu, "), t)).otherwise(full).alias("value"))
    return telemetry_rows(lines).select("event_id", "valid", "temperature", "power_limit")
