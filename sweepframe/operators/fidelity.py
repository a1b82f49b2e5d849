"""Comparison of two datasets by key: sets, multisets, first differences and tolerance gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.numeric import fraction


def compare_sets(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], content: str) -> DataFrame:
    """Per keys: coordinates in both and in one only, and the share of common ones with equal content (1.0 without any)."""
    both = a.select(*on, F.col(content).alias("_a")).join(b.select(*on, F.col(content).alias("_b")), on, "full")
    has_a, has_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    out = both.groupBy(*keys).agg(F.count_if(has_a & has_b).alias("common"), F.count_if(~has_b).alias("only_a"), F.count_if(~has_a).alias("only_b"), F.count_if(F.col("_a") == F.col("_b")).alias("_equal"))
    return out.withColumn("equal_fraction", F.col("_equal") / F.greatest(F.lit(1), F.col("common"))).drop("_equal")


def first_mismatch(a: DataFrame, b: DataFrame, on: list[str], columns: list[str], keys: list[str]) -> DataFrame:
    """Per keys: compared and differing rows, and the first differing place in the order of `on`. Null equals null.

    Both sides are dealt into a fixed number of parts: sorted rows shrink so much in a shuffle that parts put together by their bytes are large in memory.
    """
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32 * spark.sparkContext.defaultParallelism)
    left = a.select(*on, F.struct(*columns).alias("_a")).repartition(parts, *on)
    right = b.select(*on, F.struct(*columns).alias("_b")).repartition(parts, *on)
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    both = left.join(right, on, "full")
    return both.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(differs).alias("mismatches"), F.min(F.when(differs, F.struct(*[c for c in on if c not in keys]))).alias("first"))


def tolerance(df: DataFrame, value: str, limit: float, keys: list[str], least: float = 0.99) -> DataFrame:
    """Count, passes (<= limit), their share (1.0 on empty input) and acceptance."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value) <= limit).alias("passed"))
    return out.withColumn("pass_fraction", fraction(F.col("passed"), F.col("n"), 1.0)).withColumn("accepted", F.col("pass_fraction") >= least)
