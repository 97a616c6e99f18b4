"""Queries: aggregation, intervals and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, bootstrap, compare
from ..sources import tables as t
from .catalog import NUDGE, query


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    nudge = NUDGE if places == 9 else 0.0
    return df.withColumns({c: F.round(F.col(c) + nudge, places) for c in columns})


_AXES = f"""
scores AS ({t.SCORES_SQL}),
axes AS (SELECT runner_id, axis, avg(value) AS mean, var_pop(value) AS variance, count(*) AS n, min(score_ord) AS first_ord FROM scores GROUP BY ALL),
weighted AS (SELECT *, w / sum(w) OVER (PARTITION BY runner_id) AS weight FROM (SELECT *, CASE axis WHEN 'A' THEN 2.0 ELSE 1.0 END AS w FROM axes))
"""
WEIGHTS = {"A": 2.0}


@query("leaderboard", f"WITH {_AXES} SELECT runner_id, round(composite, 9) AS composite, row_number() OVER (ORDER BY composite DESC, first_ord) AS rank FROM (SELECT runner_id, sum(weight * mean) AS composite, min(first_ord) AS first_ord FROM weighted GROUP BY runner_id)")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.leaderboard(t.scores(spark, sf_dir), WEIGHTS), "composite").withColumn("rank", F.col("rank").cast("long"))


@query("axis_summary", f"WITH {_AXES} SELECT runner_id, axis, round(mean, 9) AS mean, round(variance, 9) AS variance, n, round(weight, 9) AS weight FROM weighted")
def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.weighted_axes(aggregate.axis_summary(t.scores(spark, sf_dir)), WEIGHTS), "mean", "variance", "weight")


@query(
    "reliability",
    f"""WITH scores AS ({t.SCORES_SQL}), g AS (SELECT runner_id, scenario_id, axis, max(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS some_pass, min(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS every_pass, count(*) AS samples FROM scores GROUP BY ALL)
    SELECT runner_id, round(avg(some_pass), 9) AS pass_at_k, round(avg(every_pass), 9) AS pass_hat_k, round(avg(samples), 9) AS mean_samples, CAST(sum(CASE WHEN samples > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, count(*) AS groups FROM g GROUP BY runner_id""",
)
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.reliability(t.scores(spark, sf_dir)), "pass_at_k", "pass_hat_k", "mean_samples")


_RANK = "list_sort(list(latency_ms))[CAST(floor({p} * (count(latency_ms) - 1) + 0.5) AS INT) + 1]"


@query(
    "operational",
    f"""WITH responses AS ({t.RESPONSES_SQL}), runners AS (SELECT concat('r', x) AS runner_id FROM range(0, 5) t(x)),
    m AS (SELECT runner_id, count(*) AS responses, avg(latency_ms) AS mean_latency, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, sum(cost_usd) AS cost_usd,
      avg(CAST(refusal AS INT)) AS refusal_rate, count_if(prompt_tokens IS NULL) AS missing_prompt_tokens, count_if(cost_usd IS NULL) AS missing_cost,
      {_RANK.format(p="0.5::DOUBLE")} AS p50_latency, {_RANK.format(p="0.95::DOUBLE")} AS p95_latency FROM responses GROUP BY runner_id)
    SELECT runner_id, coalesce(responses, 0) AS responses, round(mean_latency, 7) AS mean_latency, prompt_tokens, completion_tokens, round(cost_usd, 6) AS cost_usd, round(refusal_rate, 9) AS refusal_rate,
      CAST(missing_prompt_tokens AS BIGINT) AS missing_prompt_tokens, CAST(missing_cost AS BIGINT) AS missing_cost, p50_latency, p95_latency FROM runners LEFT JOIN m USING (runner_id)""",
)
def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    runners = spark.range(5).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("runner_id"))
    out = aggregate.operational(t.responses(spark, sf_dir), runners)
    return rounded(rounded(rounded(out, "refusal_rate"), "mean_latency", places=7), "cost_usd", places=6)


@query(
    "slice_summary",
    f"""WITH {_AXES}, slices AS ({t.SLICES_SQL}),
    l AS (SELECT s.runner_id, s.axis, s.value, coalesce(x.slice, '__unsliced__') AS slice FROM scores s LEFT JOIN slices x USING (scenario_id)),
    g AS (SELECT runner_id, slice, axis, avg(value) AS mean, var_pop(value) AS variance, count(*) AS n FROM l GROUP BY ALL)
    SELECT runner_id, axis, slice, round(mean, 9) AS mean, round(variance, 9) AS variance, n, round(composite, 9) AS composite FROM (
      SELECT g.*, sum(w.weight * g.mean) OVER (PARTITION BY g.runner_id, g.slice) AS composite FROM g JOIN weighted w ON g.runner_id = w.runner_id AND g.axis = w.axis)""",
)
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.slice_summary(t.scores(spark, sf_dir), WEIGHTS, t.slices(spark, sf_dir)), "mean", "variance", "composite").select("runner_id", "axis", "slice", "mean", "variance", "n", "composite")


@query(
    "latency_percentiles",
    f"""WITH responses AS ({t.RESPONSES_SQL}) SELECT runner_id, scenario_id, {_RANK.format(p="0.05::DOUBLE")} AS p05, {_RANK.format(p="0.5::DOUBLE")} AS p50, {_RANK.format(p="0.99::DOUBLE")} AS p99 FROM responses GROUP BY ALL""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.ranked_percentile(t.responses(spark, sf_dir), ["runner_id", "scenario_id"], "latency_ms", {"p05": 0.05, "p50": 0.5, "p99": 0.99})


ITERATIONS = 60


@query(
    "bootstrap_intervals",
    f"""WITH RECURSIVE scores AS ({t.SCORES_SQL}),
    means AS (SELECT runner_id, scenario_id, avg(value) AS value FROM scores GROUP BY ALL),
    v AS (SELECT runner_id, row_number() OVER (PARTITION BY runner_id ORDER BY scenario_id) - 1 AS i, count(*) OVER (PARTITION BY runner_id) AS n, value FROM means),
    lcg(k, s) AS (SELECT 0, 7::BIGINT UNION ALL SELECT k + 1, (1664525 * s + 1013904223) % 4294967296 FROM lcg WHERE k < (SELECT max(n) FROM v) * {ITERATIONS}),
    draws AS (SELECT r.runner_id, (l.k - 1) // r.n AS round, (l.s * r.n) // 4294967296 AS i FROM lcg l JOIN (SELECT DISTINCT runner_id, n FROM v) r ON l.k >= 1 AND l.k <= r.n * {ITERATIONS}),
    resampled AS (SELECT d.runner_id, d.round, avg(v.value) AS m FROM draws d JOIN v ON v.runner_id = d.runner_id AND v.i = d.i GROUP BY ALL)
    SELECT r.runner_id, x.n, round(x.mean, 9) AS mean,
      round(list_sort(list(r.m))[CAST(floor(0.025::DOUBLE * ({ITERATIONS} - 1) + 0.5) AS INT) + 1], 9) AS lower,
      round(list_sort(list(r.m))[CAST(floor(0.975::DOUBLE * ({ITERATIONS} - 1) + 0.5) AS INT) + 1], 9) AS upper
    FROM resampled r JOIN (SELECT runner_id, count(*) AS n, avg(value) AS mean FROM means GROUP BY runner_id) x USING (runner_id) GROUP BY r.runner_id, x.n, x.mean""",
)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = t.scores(spark, sf_dir).groupBy("runner_id", "scenario_id").agg(F.avg("value").alias("value"))
    return rounded(bootstrap.mean_intervals(means, ["runner_id"], "scenario_id", ITERATIONS, 0.95, 7), "mean", "lower", "upper")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t.scores(spark, sf_dir).where("runner_id = 'r0'"), t.second_run(spark, sf_dir)


_RUNS = f"a AS (SELECT * FROM ({t.SCORES_SQL}) WHERE runner_id = 'r0'), b AS ({t.SECOND_SQL}), ma AS (SELECT scenario_id, avg(value) AS mean_a FROM a GROUP BY 1), mb AS (SELECT scenario_id, avg(value) AS mean_b FROM b GROUP BY 1)"
_DIRECTION = "CASE WHEN {d} IS NULL THEN 'missing' WHEN {d} > 0.001 THEN 'improved' WHEN {d} < -0.001 THEN 'regressed' ELSE 'unchanged' END"


@query("compare_scenarios", f"WITH {_RUNS} SELECT scenario_id, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(mean_b - mean_a, 9) AS delta, {_DIRECTION.format(d='(mean_b - mean_a)')} AS direction FROM ma FULL JOIN mb USING (scenario_id)")
def compare_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.scenario_deltas(*_runs(spark, sf_dir)), "mean_a", "mean_b", "delta")


@query("missing_scenarios", f"WITH {_RUNS} SELECT scenario_id, 'b' AS missing_from FROM ma ANTI JOIN mb USING (scenario_id) UNION ALL SELECT scenario_id, 'a' FROM mb ANTI JOIN ma USING (scenario_id)")
def missing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing_scenarios(*_runs(spark, sf_dir))


@query("score_key_counts", f"WITH {_RUNS}, ca AS (SELECT scenario_id, axis, count(*) AS n_a FROM a GROUP BY ALL), cb AS (SELECT scenario_id, axis, count(*) AS n_b FROM b GROUP BY ALL) SELECT * FROM (SELECT scenario_id, axis, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM ca FULL JOIN cb USING (scenario_id, axis)) WHERE n_a <> n_b")
def score_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.key_count_differences(*_runs(spark, sf_dir))


@query("composite_delta", f"WITH {_RUNS} SELECT count(*) AS n, round(avg(mean_b - mean_a), 9) AS delta FROM ma JOIN mb USING (scenario_id)")
def composite_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.composite_delta(*_runs(spark, sf_dir)), "delta")


@query(
    "paired_comparison",
    f"""WITH RECURSIVE {_RUNS}, v AS (SELECT row_number() OVER (ORDER BY scenario_id) - 1 AS i, mean_b - mean_a AS value FROM ma JOIN mb USING (scenario_id)),
    lcg(k, s) AS (SELECT 0, 1::BIGINT UNION ALL SELECT k + 1, (1664525 * s + 1013904223) % 4294967296 FROM lcg WHERE k < (SELECT count(*) FROM v) * {ITERATIONS}),
    m AS (SELECT (k - 1) // (SELECT count(*) FROM v) AS round, avg(v.value) AS m FROM lcg l JOIN v ON v.i = (l.s * (SELECT count(*) FROM v)) // 4294967296 WHERE k >= 1 GROUP BY 1)
    SELECT 'b-a' AS pair, (SELECT count(*) FROM v) AS n, (SELECT round(avg(value), 9) FROM v) AS mean, round(list_sort(list(m))[CAST(floor(0.025::DOUBLE * ({ITERATIONS} - 1) + 0.5) AS INT) + 1], 9) AS lower,
    round(list_sort(list(m))[CAST(floor(0.975::DOUBLE * ({ITERATIONS} - 1) + 0.5) AS INT) + 1], 9) AS upper FROM m""",
)
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.paired_comparison(*_runs(spark, sf_dir), iterations=ITERATIONS), "mean", "lower", "upper")


@query(
    "interval_eligibility",
    f"""WITH {_RUNS}, ca AS (SELECT scenario_id, axis, count(*) AS n_a FROM a GROUP BY ALL), cb AS (SELECT scenario_id, axis, count(*) AS n_b FROM b GROUP BY ALL)
    SELECT 'match' AS hash_status, (SELECT count(*) FROM ma ANTI JOIN mb USING (scenario_id)) + (SELECT count(*) FROM mb ANTI JOIN ma USING (scenario_id)) AS missing,
    (SELECT count(*) FROM ca FULL JOIN cb USING (scenario_id, axis) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)) AS key_mismatches, true AS options_valid, (SELECT count(*) FROM ma JOIN mb USING (scenario_id)) AS n, false AS eligible""",
)
def interval_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.interval_eligibility(*_runs(spark, sf_dir), "h", "h", 1000, 0.95, 1)


_REL = "(SELECT '{r}' AS run, avg(p) AS pass_at_k, avg(q) AS pass_hat_k FROM (SELECT max(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS p, min(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS q FROM {r} GROUP BY runner_id, scenario_id, axis))"


@query(
    "reliability_deltas",
    f"WITH {_RUNS} SELECT round(x.pass_at_k, 9) AS pass_at_k_a, round(y.pass_at_k, 9) AS pass_at_k_b, round(y.pass_at_k - x.pass_at_k, 9) AS pass_at_k_delta, round(x.pass_hat_k, 9) AS pass_hat_k_a, round(y.pass_hat_k, 9) AS pass_hat_k_b, round(y.pass_hat_k - x.pass_hat_k, 9) AS pass_hat_k_delta FROM {_REL.format(r='a')} x, {_REL.format(r='b')} y",
)
def reliability_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (aggregate.reliability(x).drop("runner_id") for x in _runs(spark, sf_dir))
    out = compare.summary_deltas(a, b, [], ["pass_at_k", "pass_hat_k"])
    return rounded(out, *out.columns)


@query(
    "slice_deltas",
    f"""WITH {_AXES}, slices AS ({t.SLICES_SQL}),
    l AS (SELECT s.runner_id, s.axis, s.value, coalesce(x.slice, '__unsliced__') AS slice FROM scores s LEFT JOIN slices x USING (scenario_id)),
    c AS (SELECT g.runner_id, slice, sum(w.weight * g.mean) AS composite FROM (SELECT runner_id, slice, axis, avg(value) AS mean FROM l GROUP BY ALL) g JOIN weighted w ON g.runner_id = w.runner_id AND g.axis = w.axis GROUP BY ALL)
    SELECT slice, round(x.composite, 9) AS composite_a, round(y.composite, 9) AS composite_b, round(y.composite - x.composite, 9) AS composite_delta, {_DIRECTION.format(d='(y.composite - x.composite)')} AS direction
    FROM (SELECT * FROM c WHERE runner_id = 'r0') x FULL JOIN (SELECT * FROM c WHERE runner_id = 'r1') y USING (slice)""",
)
def slice_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = t.scores(spark, sf_dir).join(t.slices(spark, sf_dir), "scenario_id", "left")
    by = aggregate.slice_summary(scored, WEIGHTS).select("runner_id", "slice", "composite").groupBy("runner_id", "slice").agg(F.first("composite").alias("composite"))
    out = compare.slice_deltas(by.where("runner_id = 'r0'").drop("runner_id"), by.where("runner_id = 'r1'").drop("runner_id"))
    return rounded(out, "composite_a", "composite_b", "composite_delta")
