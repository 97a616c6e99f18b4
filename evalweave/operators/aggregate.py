"""Score aggregation: axes, composites, reliability, operations and slices.

Scores are rows (runner_id, scenario_id, axis, value, score_ord); score_ord is a
number or struct that puts them in their recorded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axis_summary(scores: DataFrame) -> DataFrame:
    """runner_id, axis, mean, variance (of the population), n."""
    return scores.groupBy("runner_id", "axis").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count("value").alias("n"))


def requested_weight(axis: Column, weights: Mapping[str, float] | None) -> Column:
    """A requested weight, or 1."""
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        out = F.when(axis == name, F.lit(float(w))).otherwise(out)
    return out


def weighted_axes(axes: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """axis_summary with each runner's weights over the axes that it has; weights that add up to nothing stay raw."""
    raw = requested_weight(F.col("axis"), weights)
    total = F.sum(raw).over(Window.partitionBy("runner_id"))
    return axes.withColumn("weight", F.when(total == 0, raw).otherwise(raw / F.nullif(total, F.lit(0.0))))


def leaderboard(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """runner_id, composite, rank; the best first, ties as first seen."""
    composite = weighted_axes(axis_summary(scores), weights).groupBy("runner_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("composite"))
    first = scores.groupBy("runner_id").agg(F.min("score_ord").alias("first_ord"))
    # One row for each runner: a single partition is what ranking them needs.
    place = Window.orderBy(F.col("composite").desc(), F.col("first_ord"))
    return composite.join(first, "runner_id").withColumn("rank", F.row_number().over(place)).drop("first_ord")


def reliability(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """runner_id, pass_at_k, pass_hat_k, mean_samples, repeated: over groups of samples of a scenario on an axis."""
    groups = scores.groupBy("runner_id", "scenario_id", "axis").agg(
        F.max((F.col("value") >= threshold).cast("int")).alias("some"), F.min((F.col("value") >= threshold).cast("int")).alias("every"), F.count(F.lit(1)).alias("samples")
    )
    return groups.groupBy("runner_id").agg(
        F.avg("some").alias("pass_at_k"), F.avg("every").alias("pass_hat_k"), F.avg("samples").alias("mean_samples"),
        F.sum((F.col("samples") > 1).cast("int")).alias("repeated"), F.count(F.lit(1)).alias("groups"),
    )


def nearest_rank(values: Column, share: float) -> Column:
    """The value at rank round(share * (n - 1)), halves up, of collected values; null of none."""
    at = F.floor(F.lit(share) * (F.size(values) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))


def ranked_percentile(df: DataFrame, keys: list[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles of a group of any size: ranks by a window, so no group is held in memory."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    picks = [F.max(F.when(F.col("pos") == F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col(value))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*keys).agg(*picks)


def refused(extra_refusal: Column, finish: Column, stop: Column) -> Column:
    """A stated refusal counts; else a finish (or stop) reason that speaks of one; never null."""
    return F.coalesce(extra_refusal, F.lower(F.coalesce(finish, stop)).rlike("refusal|content_filter"), F.lit(False))


def first_finite(*values: Column) -> Column:
    return F.coalesce(*[F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])


def operational(responses: DataFrame, runners: DataFrame | None = None) -> DataFrame:
    """Latency, token, cost and refusal figures for each runner.

    responses: runner_id, latency_ms, prompt_tokens, completion_tokens, cost_usd, refusal.
    Runners without a response have a row of nulls and zeros.
    """
    facts = responses.groupBy("runner_id").agg(
        F.count(F.lit(1)).alias("responses"), F.avg("latency_ms").alias("mean_latency"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.avg(F.col("refusal").cast("int")).alias("refusal_rate"),
        F.count_if(F.col("prompt_tokens").isNull()).alias("missing_prompt_tokens"), F.count_if(F.col("cost_usd").isNull()).alias("missing_cost"),
    )
    p = ranked_percentile(responses, ["runner_id"], "latency_ms", {"p50_latency": 0.5, "p95_latency": 0.95})
    out = facts.join(p, "runner_id", "left")
    return out if runners is None else runners.select("runner_id").distinct().join(out, "runner_id", "left").na.fill(0, ["responses"])


def slice_labels(slices: Column) -> Column:
    """Labels ``dim=value`` of map<string, array<string>>; one placeholder for an unsliced score. Repeats stay."""
    labels = F.flatten(F.transform(F.map_entries(slices), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v))))
    return F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0, F.array(F.lit("__unsliced__"))).otherwise(labels)


def merged_slices(scenario: Column, score: Column) -> Column:
    """A scenario's slices overlaid by the score's own."""
    none = F.create_map().cast("map<string,array<string>>")
    return F.map_zip_with(F.coalesce(scenario, none), F.coalesce(score, none), lambda _, a, b: F.coalesce(b, a))


def slice_summary(scores: DataFrame, weights: Mapping[str, float] | None = None, slices: DataFrame | None = None) -> DataFrame:
    """runner_id, slice, axis, mean, variance, n, composite; the composite uses the runner's weights as they are.

    slices: scenario_id, slices (map<string, array<string>>) of the scenarios;
    without it scores has a column slices of its own. Scores of one scenario (or of
    equal slices) are folded to their number, mean and variance before they are
    spread over their labels, so what moves follows the label sets, not the scores.
    """
    key = F.col("scenario_id") if slices is not None else F.map_entries("slices")
    folded = scores.groupBy("runner_id", "axis", key.alias("key")).agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    if slices is not None:
        folded = folded.join(slices.select(F.col("scenario_id").alias("key"), "slices"), "key", "left")
    else:
        folded = folded.withColumn("slices", F.map_from_entries("key"))
    square = F.col("v") + F.col("m") * F.col("m")
    parts = folded.select("runner_id", "axis", F.explode(slice_labels(F.col("slices"))).alias("slice"), "k", (F.col("k") * F.col("m")).alias("s1"), (F.col("k") * square).alias("s2"))
    sums = parts.groupBy("runner_id", "slice", "axis").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("k").alias("n"))
    n = F.nullif(F.col("n"), F.lit(0))
    mean = F.col("s1") / n
    axes = sums.select("runner_id", "slice", "axis", mean.alias("mean"), F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean)).alias("variance"), "n")
    runner_weights = weighted_axes(axis_summary(scores), weights).select("runner_id", "axis", "weight")
    whole = F.sum(F.col("weight") * F.col("mean")).over(Window.partitionBy("runner_id", "slice"))
    return axes.join(runner_weights, ["runner_id", "axis"]).withColumn("composite", whole).drop("weight")
