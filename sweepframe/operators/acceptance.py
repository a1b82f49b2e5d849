"""Acceptance of one backend's detections against another's: counts per sample, coverage, error limits and pass fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.operators.boxes import pair_errors

EXPORTED, HIGH = 0.25, 0.3
BOX = ("cx", "cy", "cz", "len", "wid", "hgt", "yaw", "score", "object_type")


def matched_errors(reference: DataFrame, candidate: DataFrame, keys: list[str], matches: DataFrame) -> DataFrame:
    """One row per matched pair (det_id, other_id): both scores and all errors; high: either side is of high confidence. matches: as parity_matches gives them."""
    a, b = reference.alias("a"), candidate.alias("b")
    side = {p: {c: F.col(f"{p}.{c}") for c in BOX} for p in "ab"}
    m = matches.where("kind = 'match'").select(F.col("det_id").alias("_a"), F.col("other_id").alias("_b"))
    both = a.join(m, F.col("a.det_id") == F.col("_a")).join(b, F.col("_b") == F.col("b.det_id"))
    out = both.select(*(F.col(f"a.{k}") for k in keys), "a.det_id", F.col("_b").alias("other_id"), "a.object_type", F.col("a.score").alias("score"), F.col("b.score").alias("other_score"), *(v.alias(k) for k, v in pair_errors(side["a"], side["b"]).items()))
    return out.withColumn("size_error", F.greatest("length_error", "width_error", "height_error")).withColumn("high", (F.col("score") >= HIGH) | (F.col("other_score") >= HIGH))


def threshold_edges(reference: DataFrame, candidate: DataFrame, matches: DataFrame, exported: float = EXPORTED, band: tuple[float, float] = (0.2, 0.3)) -> DataFrame:
    """(kind, det_id, other_id): matched pairs of which one side alone is exported and either is near the threshold (in the band), and exported detections near it that have no match."""
    pairs = matches.join(reference.select("det_id", "score"), "det_id", "left").join(candidate.select(F.col("det_id").alias("other_id"), F.col("score").alias("other_score")), "other_id", "left")
    a, b = (F.coalesce(F.col(c) >= exported, F.lit(False)) for c in ("score", "other_score"))
    near_a, near_b = (F.coalesce(F.col(c).between(*band), F.lit(False)) for c in ("score", "other_score"))
    kind = F.when((F.col("kind") == "match") & (a != b) & (near_a | near_b), "matched_crossing").when((F.col("kind") == "missing") & a & near_a, "reference_only").when((F.col("kind") == "extra") & b & near_b, "candidate_only")
    return pairs.select(kind.alias("kind"), "det_id", "other_id").where("kind is not null")


def sample_parity(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample: detections of either side in all, exported and of high confidence, exported ones per class, and whether the exported counts are near enough."""

    def counted(df: DataFrame, p: str) -> DataFrame:
        per = df.groupBy(*keys, "object_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= EXPORTED).alias("e"), F.count_if(F.col("score") >= HIGH).alias("h"))
        classes = F.array_join(F.sort_array(F.collect_list(F.when(F.col("e") > 0, F.concat("object_type", F.lit("="), F.col("e").cast("string"))))), ",")
        return per.groupBy(*keys).agg(F.sum("n").alias(f"raw_{p}"), F.sum("e").alias(f"exported_{p}"), F.sum("h").alias(f"high_{p}"), classes.alias(f"classes_{p}"))

    both = counted(reference, "a").join(counted(candidate, "b"), keys, "full")
    both = both.fillna(0).fillna("", ["classes_a", "classes_b"])
    both = both.withColumn("difference", F.abs(F.col("exported_a") - F.col("exported_b"))).withColumn("allowed", F.greatest(F.lit(1), F.ceil(F.col("exported_a") * 0.05)).cast("long"))
    return both.withColumn("within", F.col("difference") <= F.col("allowed"))


def _together(samples: DataFrame, errors: DataFrame, columns: list[Column]) -> DataFrame:
    """One row: totals of samples beside aggregates of the errors of high-confidence pairs."""
    totals = samples.agg(F.bool_and("within").alias("per_sample"), *(F.sum(f"{k}_{p}").alias(f"{k}_{p}") for k in ("exported", "high") for p in "ab"))
    cover = [F.count_if(F.col(c) >= HIGH).alias(n) for c, n in (("score", "matched_a"), ("other_score", "matched_b"))]
    return totals.withColumn("_", F.lit(1)).join(errors.agg(*cover, *columns).withColumn("_", F.lit(1)), "_").drop("_")


def _counts(min_coverage: float, max_relative: float) -> dict[str, Column]:
    def cover(p: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"matched_{p}"), F.col(f"high_{p}")), F.lit(1.0)) >= min_coverage

    off = F.abs(F.col("exported_b") - F.col("exported_a"))
    return {
        "coverage_a": cover("a"), "coverage_b": cover("b"), "sample_counts": F.col("per_sample"),
        "total_counts": F.when(F.col("exported_a") > 0, off / F.col("exported_a") <= max_relative).otherwise(off == 0),
    }


def by_largest_error(samples: DataFrame, errors: DataFrame, limits: dict[str, float], min_coverage: float = 0.99, max_relative: float = 0.02) -> DataFrame:
    """One row of ten checks: coverage both ways, the largest xy, z, size, yaw and score error, equal classes, and counts per sample and in all."""
    e = {"xy": "xy_error", "z": "z_error", "size": "size_error", "yaw": "yaw_degrees", "score": "score_error"}
    high = F.col("high")
    row = _together(samples, errors, [F.coalesce(F.max(F.when(high, F.col(c))), F.lit(0.0)).alias(f"_{n}") for n, c in e.items()] + [F.count_if(high & ~F.col("class_equal")).alias("_classes")])
    counts = _counts(min_coverage, max_relative)
    checks = {k: counts[k] for k in ("coverage_a", "coverage_b")} | {n: F.col(f"_{n}") <= limits[n] for n in e} | {"classes": F.col("_classes") == 0} | {k: counts[k] for k in ("sample_counts", "total_counts")}
    out = row.select(*(v.alias(k) for k, v in checks.items()))
    return out.withColumn("accepted", F.forall(F.array(*checks), lambda x: x))


def outliers(errors: DataFrame, limits: dict[str, float]) -> DataFrame:
    """High-confidence pairs beyond any limit, and which limits: size is the largest of a detection's three, axis the direction modulo half a turn."""
    e = {"xy": "xy_error", "z": "z_error", "size": "size_error", "score": "score_error", "axis": "axis_degrees"}
    failed = F.array_compact(F.array(*(F.when(F.col(c) > limits[n], F.lit(n)) for n, c in e.items())))
    return errors.where("high").withColumn("failed", failed).where("size(failed) > 0")


def by_pass_fraction(samples: DataFrame, errors: DataFrame, limits: dict[str, float], min_fraction: float = 0.95, min_direction: float = 0.99, min_coverage: float = 0.99, max_relative: float = 0.02) -> DataFrame:
    """One row of eleven checks, most of them on the share of high-confidence pairs within a limit; the failed ones by name, the number of outliers and what follows.

    What follows: accept, review (only shares of continuous errors fail) or reject.
    """
    e = {"xy": "xy_error", "z": "z_error", "size": "size_error", "score": "score_error", "axis": "axis_degrees"}
    high = F.col("high")

    def share(fits: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(high & fits), F.count_if(high)), F.lit(1.0))

    any_out = F.array_max(F.array(*(F.col(c) > limits[n] for n, c in e.items())))
    row = _together(samples, errors, [share(F.col(c) <= limits[n]).alias(f"_{n}") for n, c in e.items()] + [share(~F.col("flip")).alias("_direction"), F.count_if(high & ~F.col("class_equal")).alias("_classes"), F.count_if(high & any_out).alias("n_outliers")])
    counts = _counts(min_coverage, max_relative)
    checks = {k: counts[k] for k in ("sample_counts", "total_counts", "coverage_a", "coverage_b")} | {n: F.col(f"_{n}") >= min_fraction for n in e}
    checks |= {"direction": F.col("_direction") >= min_direction, "classes": F.col("_classes") == 0}
    failed = F.array_compact(F.array(*(F.when(~v, F.lit(k)) for k, v in checks.items())))
    out = row.select(*(v.alias(k) for k, v in checks.items()), failed.alias("_failed"), "n_outliers")
    hard = F.size(F.array_except("_failed", F.array(*(F.lit(n) for n in e)))) > 0
    return out.withColumn("failed", F.array_join("_failed", ",")).withColumn("next", F.when(F.size("_failed") == 0, "accept").when(hard, "reject").otherwise("review")).drop("_failed")


def review_flags(native: Column, native_network: Column, native_p95: Column, fast: Column, fast_network: Column, fast_p95: Column, history: float) -> Column:
    """Names of the rules that suspicious latencies (all above 0) break."""
    rules = {
        "native_over_2x_history": native > 2 * history, "end_to_end_over_10x": native / fast > 10, "network_over_10x": native_network / fast_network > 10,
        "native_p95_over_2x": native_p95 > 2 * native, "fast_p95_over_2x": fast_p95 > 2 * fast, "native_below_network": native < native_network, "fast_below_network": fast < fast_network,
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))


def divergence(same_class: Column, overlap: Column, survivors: Column, order: Column, other: Column) -> Column:
    """A swap is confirmed by all four kinds of evidence only."""
    return F.when(same_class & overlap & survivors & order, "confirmed_swap").when(other, "other_divergence").otherwise("unexplained")
