"""Comparing two runs: per-scenario deltas, key counts, slices and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import check_options, mean_intervals

BAND = 0.001


def direction(delta: Column) -> Column:
    """improved or regressed beyond the band, unchanged within it, missing without a delta."""
    return F.when(delta.isNull(), "missing").when(delta > BAND, "improved").when(delta < -BAND, "regressed").otherwise("unchanged")


def scenario_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("scenario_id").agg(F.avg("value").alias("mean"))


def scenario_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """scenario_id, mean_a, mean_b, delta, direction for the scenarios of either run."""
    left, right = scenario_means(a).withColumnRenamed("mean", "mean_a"), scenario_means(b).withColumnRenamed("mean", "mean_b")
    both = left.join(right, "scenario_id", "full_outer").withColumn("delta", F.col("mean_b") - F.col("mean_a"))
    return both.withColumn("direction", direction(F.col("delta")))


def missing_scenarios(a: DataFrame, b: DataFrame) -> DataFrame:
    """scenario_id, missing_from: scenarios that only one run has."""
    one, two = a.select("scenario_id").distinct(), b.select("scenario_id").distinct()
    return one.join(two, "scenario_id", "left_anti").withColumn("missing_from", F.lit("b")).unionByName(two.join(one, "scenario_id", "left_anti").withColumn("missing_from", F.lit("a")))


def key_count_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """scenario_id, axis, n_a, n_b where the runs have different numbers of scores."""
    count = lambda df, name: df.groupBy("scenario_id", "axis").agg(F.count(F.lit(1)).alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), ["scenario_id", "axis"], "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.where("n_a <> n_b")


def summary_deltas(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys and, for each metric, its two values and their difference; a missing side makes it null."""
    left, right = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics]), b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = left.join(right, keys, "full_outer") if keys else left.crossJoin(right)
    return both.select(*keys, *[c for m in metrics for c in (f"{m}_a", f"{m}_b", (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta"))])


def slice_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """slice, composite_a, composite_b, composite_delta, direction; from two slice tables (slice, composite)."""
    return summary_deltas(a, b, ["slice"], ["composite"]).withColumn("direction", direction(F.col("composite_delta")))


def paired_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """scenario_id, value: b's mean less a's, for the scenarios of both."""
    left, right = scenario_means(a).withColumnRenamed("mean", "x"), scenario_means(b).withColumnRenamed("mean", "y")
    return left.join(right, "scenario_id").select("scenario_id", (F.col("y") - F.col("x")).alias("value"))


def composite_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, delta: the mean of the paired deltas."""
    return paired_deltas(a, b).agg(F.count("value").alias("n"), F.avg("value").alias("delta"))


def paired_comparison(a: DataFrame, b: DataFrame, iterations: int = 1000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """n, mean, lower, upper of the paired deltas, resampled in the order of scenario ids."""
    return mean_intervals(paired_deltas(a, b).withColumn("pair", F.lit("b-a")), ["pair"], "scenario_id", iterations, confidence, seed)


def interval_eligibility(a: DataFrame, b: DataFrame, hash_a: str | None, hash_b: str | None, iterations: int, confidence: float, seed: float) -> DataFrame:
    """One row: whether the runs may carry an interval, and each condition."""
    status = "unverified" if not hash_a or not hash_b else "match" if hash_a == hash_b else "mismatch"
    counts = missing_scenarios(a, b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(key_count_differences(a, b).agg(F.count(F.lit(1)).alias("keys"))).crossJoin(paired_deltas(a, b).agg(F.count(F.lit(1)).alias("n")))
    fine = not check_options(iterations, confidence, seed)
    ok = F.lit(status == "match" and fine) & (F.col("missing") == 0) & (F.col("keys") == 0) & (F.col("n") > 0)
    return counts.select(F.lit(status).alias("hash_status"), "missing", F.col("keys").alias("key_mismatches"), F.lit(fine).alias("options_valid"), "n", ok.alias("eligible"))
