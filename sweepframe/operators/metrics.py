"""Detection metrics and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_metrics(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """precision, recall and f1; 0 where a denominator is 0."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": ratio0(t, t + p), "recall": ratio0(t, t + n), "f1": ratio0(2 * t, 2 * t + p + n)})


def average_precision(records: DataFrame, truths: DataFrame, keys: list[str], order: list[str], slices: int = 1000) -> DataFrame:
    """All-points average precision per keys for records (keys, score in 0..1, tp) and truths (keys, n_truths); 0 without either.

    Ranks are computed in two steps, so that a class's predictions never meet in one task: scores are cut into slices, totals of slices before and the best
    precision of slices after are carried into windows over single slices.
    """
    r = records.withColumn("slice", F.least(F.lit(slices - 1), F.floor((1 - F.col("score")) * slices)).cast("int"))
    sums = r.groupBy(*keys, "slice").agg(F.sum(F.col("tp").cast("long")).alias("_t"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*keys, "slice").orderBy(F.desc("score"), *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*keys, "slice").orderBy("_rank_desc")
    ranked = r.join(sums, [*keys, "slice"]).withColumn("_hits", F.col("_t0") + F.sum(F.col("tp").cast("long")).over(upto)).withColumn("_rank", F.col("_n0") + F.count("*").over(upto)).withColumn("_rank_desc", -F.col("_rank"))
    ranked = ranked.withColumn("_precision", F.col("_hits") / F.col("_rank"))
    best = ranked.groupBy(*keys, "slice").agg(F.max("_precision").alias("_best"))
    after = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_later", F.coalesce(F.max("_best").over(after), F.lit(0.0))).drop("_best")
    envelope = F.greatest(F.max("_precision").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_later"))
    # Recall grows by 1 / n_truths at each hit.
    total = ranked.join(best, [*keys, "slice"]).withColumn("_envelope", envelope).groupBy(*keys).agg(F.sum(F.when(F.col("tp"), F.col("_envelope")).otherwise(0.0)).alias("_sum"))
    return truths.join(total, keys, "left").select(*keys, ratio0(F.coalesce("_sum", F.lit(0.0)), F.col("n_truths")).alias("ap"))


def longest_runs(df: DataFrame, keys: list[str], index: str, hit: str) -> DataFrame:
    """Longest runs of hits and of misses per keys; a run ends where the value changes or an index is missing."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce((F.col(hit) != F.lag(hit).over(w)) | (F.col(index) != F.lag(index).over(w) + 1), F.lit(True))
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(w)).groupBy(*keys, "_run", hit).agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(hit), F.col("n"))), F.lit(0)).alias("longest_hit"), F.coalesce(F.max(F.when(~F.col(hit), F.col("n"))), F.lit(0)).alias("longest_miss"))


def describe(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, median, p90, p95, smallest, largest and population deviation."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"), F.percentile(v, F.lit(0.95)).alias("p95"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def range_slice(distance: Column) -> Column:
    """[0, 20), [20, 35), [35, 50]; null elsewhere."""
    return F.when((distance >= 0) & (distance < 20), "0-20").when((distance >= 20) & (distance < 35), "20-35").when((distance >= 35) & (distance <= 50), "35-50")


def correlation(a: str, b: str) -> Column:
    """Pearson's r; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def sustained_rates(messages: DataFrame, keys: list[str], ts: str, rate_hz: float, share: float = 0.95) -> DataFrame:
    """Per keys: offered and output rate, (n - 1) over the elapsed time, messages lost between the stages received, accepted and published (booleans), and a verdict."""

    def rate(fits: Column) -> Column:
        at = F.when(fits, F.col(ts))
        return F.try_divide(F.count_if(fits) - 1, (F.max(at) - F.min(at)) / 1e6)

    out = messages.groupBy(*keys).agg(
        rate(F.lit(True)).alias("offered_hz"), rate(F.col("published")).alias("output_hz"), F.count_if(~F.col("received")).alias("input_loss"),
        F.count_if(F.col("received") & ~F.col("accepted")).alias("rejected"), F.count_if(F.col("accepted") & ~F.col("published")).alias("backlog"),
    )
    lossy = F.greatest("input_loss", "rejected", "backlog") > 0
    verdict = F.when(lossy, "lossy").when(F.col("offered_hz") < share * rate_hz, "not_offered").when(F.col("output_hz") < share * rate_hz, "not_sustained").otherwise("sustained")
    return out.withColumn("verdict", verdict)
