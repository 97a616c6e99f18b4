"""Queries: tasks and exports, ledgers, human labels, gates, caches, environments and streams."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, environment, export, gates, human, identity, ledger, proof, scoring
from ..sources import sinks
from ..session import shared_dir
from ..sources import tables as t
from ..streaming import ledger as streams
from .catalog import query
from .stats import WEIGHTS, rounded


def _task_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scores = t.scores(spark, sf_dir)
    responses = t.table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("runner_id"), F.concat(F.lit("s"), (F.col("event_id") % 520).cast("string")).alias("scenario_id"),
        F.col("event_type").alias("output"), F.col("value").alias("latency_ms"), F.col("event_id").alias("response_ord"),
    )
    scenarios = spark.range(515).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scenario_id"), F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"), F.element_at(F.array(F.lit("public"), F.lit("private_holdout"), F.lit("holdout")), (F.col("id") % 3 + 1).cast("int")).alias("tier"))
    return scores, responses, scenarios


_TASKS = f"""scores AS ({t.SCORES_SQL}), responses AS (SELECT concat('r', user_id % 4) AS runner_id, concat('s', event_id % 520) AS scenario_id, event_type AS output, value AS latency_ms, event_id AS response_ord FROM events),
scenarios AS (SELECT concat('s', x) AS scenario_id, concat('prompt ', x) AS prompt, ['public', 'private_holdout', 'holdout'][CAST(x % 3 + 1 AS INT)] AS tier FROM range(0, 515) r(x)),
k AS (SELECT runner_id, scenario_id FROM scores UNION SELECT runner_id, scenario_id FROM responses),
r AS (SELECT runner_id, scenario_id, arg_max(output, response_ord) AS output, arg_max(latency_ms, response_ord) AS latency_ms FROM responses GROUP BY ALL),
s AS (SELECT runner_id, scenario_id, count(*) AS n, avg(value) AS mean_score FROM scores GROUP BY ALL)"""


@query(
    "tasks",
    f"""WITH {_TASKS}, x AS (SELECT runner_id, scenario_id, CASE WHEN tier LIKE 'private%' OR tier LIKE 'holdout%' THEN 'private' ELSE 'public' END AS privacy, prompt, r.output, r.latency_ms, s.n, s.mean_score, r.runner_id IS NULL AS gone
      FROM k LEFT JOIN r USING (runner_id, scenario_id) LEFT JOIN s USING (runner_id, scenario_id) LEFT JOIN scenarios USING (scenario_id))
    SELECT runner_id, scenario_id, privacy, CASE WHEN privacy = 'public' THEN prompt END AS prompt, CASE WHEN privacy = 'public' THEN output END AS output, CASE WHEN gone THEN 'omitted-missing' WHEN privacy = 'private' THEN 'omitted-private' ELSE 'included' END AS output_state,
      latency_ms, coalesce(n, 0) AS n_scores, round(mean_score, 9) AS mean_score, CAST(gone AS INT) + CAST(n IS NULL AS INT) + CAST(privacy = 'private' AS INT) AS n_notes FROM x""",
)
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = export.counted_tasks(*_task_inputs(spark, sf_dir)).withColumn("n_notes", F.size("lossiness"))
    return rounded(out, "mean_score").select("runner_id", "scenario_id", "privacy", "prompt", "output", "output_state", "latency_ms", "n_scores", "mean_score", "n_notes")


@query(
    "experiment_spans",
    f"""WITH {_TASKS} SELECT 'trace:run-1' AS trace_id, 'span:run:run-1' AS span_id, NULL::VARCHAR AS parent_id, 'run' AS name, NULL::DOUBLE AS duration_ms, 'unknown' AS status, NULL::VARCHAR AS privacy
    UNION ALL SELECT 'trace:run-1', concat('span:task:run-1:', runner_id, ':', scenario_id), 'span:run:run-1', 'task', r.latency_ms, CASE WHEN s.n IS NULL THEN 'unknown' ELSE 'ok' END, CASE WHEN tier LIKE 'private%' OR tier LIKE 'holdout%' THEN 'private' ELSE 'public' END
      FROM k LEFT JOIN r USING (runner_id, scenario_id) LEFT JOIN s USING (runner_id, scenario_id) LEFT JOIN scenarios USING (scenario_id)""",
)
def experiment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = export.spans(export.tasks(*_task_inputs(spark, sf_dir)), "run-1", "1970-01-01T00:00:00Z")
    return out.select("trace_id", "span_id", "parent_id", "name", "duration_ms", "status", F.try_element_at("attributes", F.lit("privacy")).alias("privacy"))


@query(
    "inspect_samples",
    f"""WITH {_TASKS} SELECT scenario_id AS id, CASE WHEN tier = 'public' THEN prompt ELSE '{export.WITHHELD}' END AS input, NULL::VARCHAR AS target, CASE WHEN tier = 'public' THEN 'public' ELSE 'private' END AS privacy, ['x', 'y'] AS axes FROM scenarios""",
)
def inspect_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.inspect_samples(_task_inputs(spark, sf_dir)[2].withColumn("axes", F.array(F.lit("x"), F.lit("y"))))


_REFS = [("everywhere", None, None), ("of-s3", "s3", None), ("of-r1-s4", "s4", "r1"), ("of-s999", "s999", None)]


@query("task_references", f"WITH {_TASKS}, refs(ref, s, n) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in x) + ')' for x in _REFS)}) SELECT runner_id, scenario_id, ref FROM k JOIN refs ON s IS NULL OR (s = scenario_id AND (n IS NULL OR n = runner_id))")
def task_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, responses, _ = _task_inputs(spark, sf_dir)
    keys = scores.select("runner_id", "scenario_id").union(responses.select("runner_id", "scenario_id")).distinct()
    return export.matching_references(spark.createDataFrame(_REFS, "ref string, scenario_id string, runner_id string"), keys)


@query("runner_metadata", f"WITH responses AS ({t.RESPONSES_SQL}) SELECT runner_id, list_sort(list(DISTINCT provider)) AS providers, list_sort(list(DISTINCT model)) AS models, count(*) AS responses, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency, round(avg(latency_ms), 3) AS mean_latency, min(accessed_at) AS first_access, max(accessed_at) AS last_access FROM responses GROUP BY runner_id")
def runner_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.runner_metadata(t.responses(spark, sf_dir))


@query("harness_summary", f"WITH scores AS ({t.SCORES_SQL}) SELECT concat('corpus:', runner_id) AS task, axis, round(avg(value), 9) AS mean FROM scores GROUP BY runner_id, axis")
def harness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.harness_summary(t.scores(spark, sf_dir), "corpus").select("task", F.explode("metrics").alias("axis", "mean")), "mean")


@query("axis_table", f"WITH scores AS ({t.SCORES_SQL}), m AS (SELECT runner_id, axis, avg(value) AS mean FROM scores WHERE NOT (runner_id = 'r2' AND axis = 'N') GROUP BY ALL) SELECT runner_id, " + ", ".join(f"coalesce(printf('%.3f', max(mean) FILTER (WHERE axis = '{a}')), 'N/A') AS \"{a}\"" for a in "ANR") + " FROM m GROUP BY runner_id")
def axis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.axis_table(aggregate.axis_summary(t.scores(spark, sf_dir).where("not (runner_id = 'r2' and axis = 'N')")))


@query("junit_cases", f"WITH scores AS ({t.SCORES_SQL}) SELECT runner_id, count(*) AS tests, count_if(value < 0.5)::BIGINT AS failures, CAST(sum(length(concat('<testcase classname=\"', runner_id, '\" name=\"', scenario_id, ' [', axis, ']\">', CASE WHEN value < 0.5 THEN concat('<failure message=\"score ', rtrim(rtrim(printf('%.6f', value), '0'), '.'), ' is under 0.5\"/>') ELSE '' END, '</testcase>'))) AS BIGINT) AS chars FROM scores GROUP BY runner_id")
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = export.junit_cases(t.scores(spark, sf_dir), 0.5)
    return c.groupBy("runner_id").agg(F.count(F.lit(1)).alias("tests"), F.count_if("failed").alias("failures"), F.sum(F.length("case")).alias("chars"))


@query("workflow_annotations", f"WITH scores AS ({t.SCORES_SQL}) SELECT 0 AS ord, concat('::notice title=evaluation::', count(*), ' scores, ', count_if(value < 0.05)::BIGINT, ' under threshold') AS command FROM scores UNION ALL SELECT 1, concat('::error title=', runner_id, '/', scenario_id, '::', axis, ' scored ', rtrim(rtrim(printf('%.6f', value), '0'), '.')) FROM scores WHERE value < 0.05")
def workflow_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.workflow_annotations(t.scores(spark, sf_dir), 0.05)


@query("experiment_metrics", f"WITH scores AS ({t.SCORES_SQL}), m AS (SELECT runner_id, axis, avg(value) AS mean FROM scores GROUP BY ALL) SELECT runner_id, concat('score/', axis) AS name, row_number() OVER (PARTITION BY runner_id, axis ORDER BY score_ord) - 1 AS step, round(value, 9) AS value FROM scores UNION ALL SELECT runner_id, 'composite', 0, round(avg(mean), 9) FROM m GROUP BY 1 UNION ALL SELECT runner_id, concat('mean/', axis), 0, round(mean, 9) FROM m")
def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.scores(spark, sf_dir)
    return rounded(export.experiment_metrics(s, aggregate.leaderboard(s), aggregate.axis_summary(s)), "value")


@query("result_lines")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, responses, scenarios = _task_inputs(spark, sf_dir)
    return export.result_lines(export.tasks(scores, responses, scenarios), aggregate.axis_summary(scores))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").where("not (user_id % 4 = 3 and event_type = 'signup')").select(
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("runner_id"), F.col("event_type").alias("scenario_id"),
        F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"), F.col("event_id").alias("line_no"),
    )


_CELLS = "SELECT concat('r', user_id % 4) AS runner_id, event_type AS scenario_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, event_id AS line_no FROM events WHERE NOT (user_id % 4 = 3 AND event_type = 'signup')"
_LATEST = f"cells AS ({_CELLS}), latest AS (SELECT runner_id, scenario_id, arg_max(status, line_no) AS status, max(line_no) AS line_no FROM cells GROUP BY ALL)"


@query("ledger_latest", f"WITH {_LATEST} SELECT * FROM latest")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(_cells(spark, sf_dir))


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runners = spark.range(5).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("runner_id"))
    return runners, t.table(spark, sf_dir, "events").select(F.col("event_type").alias("scenario_id")).distinct()


_WANTED = "w AS (SELECT concat('r', x) AS runner_id, scenario_id FROM range(0, 5) r(x), (SELECT DISTINCT event_type AS scenario_id FROM events))"


@query("ledger_incomplete", f"WITH {_LATEST}, {_WANTED} SELECT runner_id, scenario_id, coalesce(status, 'missing') AS problem FROM w LEFT JOIN latest USING (runner_id, scenario_id) WHERE status IS NULL OR status = 'failed'")
def ledger_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.incomplete(_cells(spark, sf_dir), *_wanted(spark, sf_dir))


@query("ledger_pending", f"WITH {_LATEST}, {_WANTED} SELECT runner_id, scenario_id FROM w ANTI JOIN (SELECT * FROM latest WHERE status = 'completed') d USING (runner_id, scenario_id)")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    runners, scenarios = _wanted(spark, sf_dir)
    return ledger.pending(_cells(spark, sf_dir), runners.crossJoin(scenarios))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evalweave-stream-{uuid.uuid4().hex}"


@query("stream_ledger_latest", f"WITH {_LATEST} SELECT * FROM latest")
def stream_ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _stream(spark, sf_dir).where("not (user_id % 4 = 3 and event_type = 'signup')").select(
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("runner_id"), F.col("event_type").alias("scenario_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"), F.col("event_id").alias("line_no")
    )
    return streams.run_to_table(streams.latest_cells(cells), _folder(spark))


@query("stream_windowed_operations", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, concat('r', user_id % 4) AS runner_id, count(*) AS responses, round(avg(value), 7) AS mean_latency, round(avg(CAST(event_type = 'error' AS INT)), 9) AS refusal_rate FROM events GROUP BY 1, 2")
def stream_windowed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _stream(spark, sf_dir).select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("runner_id"), F.col("ts").cast("timestamp").alias("accessed_at"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("refusal"))
    out = streams.run_to_table(streams.windowed_operations(r), _folder(spark))
    return rounded(rounded(out, "refusal_rate"), "mean_latency", places=7)


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reviewers' labels from the driver's labels; ten documents make an item."""
    labels = t.table(spark, sf_dir, "labels").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    d, k = F.col("doc_id"), F.col("k")
    status = F.when(k == 2, F.when(d % 4 == 0, "adjudicated").otherwise("pending")).otherwise("agreed")
    at = F.concat(F.lit("2026-01-"), F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.lit("T0"), k.cast("string"), F.lit(":00:00Z"))
    return labels.select(
        F.concat(F.lit("i"), F.floor(d / 10).cast("string")).alias("item_id"), d.cast("string").alias("response_id"),
        F.when(F.when(k == 1, F.col("quality") * (1 - F.col("toxic"))).otherwise(F.col("quality")) == 1, "pass").otherwise("fail").alias("label"),
        (((d * 7 + k * 3) % 100) / 100).alias("score"), F.concat(F.lit("reviewer"), k.cast("string")).alias("reviewer"), F.lit("h").alias("scenario_hash"), F.when(d % 50 == 0, F.lit("")).otherwise(F.lit("v1")).alias("rubric_version"),
        at.alias("annotated_at"), status.alias("status"), F.when(status == "adjudicated", at).alias("adjudicated_at"), (d * 3 + k).alias("annotation_ord"),
    )


_ANN = """a AS (SELECT concat('i', doc_id // 10) AS item_id, CAST(doc_id AS VARCHAR) AS response_id, CASE WHEN (CASE WHEN k = 1 THEN quality * (1 - toxic) ELSE quality END) = 1 THEN 'pass' ELSE 'fail' END AS label,
((doc_id * 7 + k * 3) % 100) / 100 AS score, CASE WHEN doc_id % 50 = 0 THEN '' ELSE 'v1' END AS rubric_version, CASE WHEN k = 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'adjudicated' ELSE 'pending' END ELSE 'agreed' END AS status, doc_id * 3 + k AS annotation_ord
FROM labels, (SELECT unnest([0, 1, 2]) AS k)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, response_id ORDER BY CASE WHEN status = 'adjudicated' THEN 0 ELSE 1 END, score DESC, annotation_ord) AS pos FROM a WHERE status IN ('adjudicated', 'agreed')) WHERE pos = 1)"""


@query("terminal_labels", f"WITH {_ANN} SELECT item_id, response_id, label, score, status, annotation_ord FROM t")
def terminal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.terminal(_annotations(spark, sf_dir)).select("item_id", "response_id", "label", "score", "status", "annotation_ord")


@query("label_conflicts", f"WITH {_ANN} SELECT item_id, response_id, list_sort(list(DISTINCT label) FILTER (WHERE status <> 'adjudicated')) AS labels FROM a GROUP BY ALL HAVING count(DISTINCT label) FILTER (WHERE status <> 'adjudicated') > 1 AND count_if(status = 'adjudicated') = 0")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.conflicts(_annotations(spark, sf_dir))


@query("annotation_errors", f"WITH {_ANN} SELECT annotation_ord, 'rubric_version is empty' AS error FROM a WHERE rubric_version = ''")
def annotation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.validate(_annotations(spark, sf_dir))


@query("preference_pairs", f"WITH {_ANN}, p AS (SELECT item_id, arg_max(response_id, struct_pack(s := score, o := -annotation_ord)) FILTER (WHERE label = 'pass') AS chosen, max(score) FILTER (WHERE label = 'pass') AS chosen_score, arg_min(response_id, struct_pack(s := score, o := annotation_ord)) FILTER (WHERE label = 'fail') AS rejected, min(score) FILTER (WHERE label = 'fail') AS rejected_score FROM t GROUP BY item_id) SELECT * FROM p WHERE chosen_score IS NOT NULL AND rejected_score IS NOT NULL")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human.preference_pairs(_annotations(spark, sf_dir))


@query("stratification", "WITH o AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'fn-guard' ELSE ['tp', 'tn', 'fp-guard', 'other'][CAST(doc_id % 4 + 1 AS INT)] END AS k FROM documents), c AS (SELECT k, count(*) AS n FROM o GROUP BY k) SELECT x AS outcome_type, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM o) AS share, coalesce(n, 0) / (SELECT count(*) FROM o) >= 0.05 AS ok FROM (SELECT unnest(['tp', 'tn', 'fp-guard', 'fn-guard']) AS x) LEFT JOIN c ON k = x")
def stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("tp"), F.lit("tn"), F.lit("fp-guard"), F.lit("other"))
    o = t.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 50 == 0, "fn-guard").otherwise(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("outcome_type"))
    return gates.stratification(o)


@query("identity_collisions", "SELECT version, count(DISTINCT (k, h)) AS n FROM (SELECT concat('v', doc_id % 40) AS version, CASE WHEN doc_id % 120 < 40 THEN 1 ELSE 2 END AS k, lang AS h FROM documents WHERE doc_id % 40 < 3 OR doc_id = 5) GROUP BY version HAVING count(DISTINCT (k, h)) > 1")
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents").where("doc_id % 40 < 3 or doc_id = 5")
    return gates.identity_collisions(d.select(F.concat(F.lit("v"), (F.col("doc_id") % 40).cast("string")).alias("version"), F.when(F.col("doc_id") % 120 < 40, 1).otherwise(2).alias("scenario_count"), F.col("lang").alias("hash")))


@query("score_errors", f"WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i, l_discount * 10 + CASE WHEN l_partkey % 97 = 0 THEN 2 ELSE 0 END AS v, l_partkey FROM lineitem) SELECT l_orderkey, 'value' AS field, 'lies outside 0..1' AS error FROM lineitem WHERE l_partkey % 97 = 0")
def score_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = t.scores(spark, sf_dir).withColumn("value", F.col("value") + F.when(F.col("score_ord.l_partkey") % 97 == 0, 2).otherwise(0))
    return gates.score_errors(bad).select(F.col("score_ord.l_orderkey").alias("l_orderkey"), "field", "error")


@query("judge_cache", "WITH c AS (SELECT concat('doc', doc_id % 300) AS k, doc_id * 1000 AS saved, lang AS answer FROM documents), live AS (SELECT k, arg_max(answer, saved) AS answer FROM c WHERE 1000000 - saved < 900000 GROUP BY k) SELECT DISTINCT concat('doc', doc_id) AS request, answer FROM documents LEFT JOIN live ON k = concat('doc', doc_id)")
def judge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents")
    key = lambda c: sinks.cache_key(F.lit("judge"), c, F.lit(None).cast("string"), F.lit("output"))
    cache = d.select(key(F.concat(F.lit("doc"), (F.col("doc_id") % 300).cast("string"))).alias("key"), F.col("lang").alias("answer"), (F.col("doc_id") * 1000).alias("saved_at_ms"))
    requests = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("request")).distinct().withColumn("key", key(F.col("request")))
    return sinks.cached(requests, cache, 1_000_000, 900).select("request", "answer")


@query("quorum_states", "SELECT 'p' || x AS provider, CASE WHEN x = 5 THEN 'no-cell' WHEN x = 1 THEN 'wrong-hash' WHEN x IN (2, 3) THEN 'not-verified' ELSE 'verified' END AS state FROM range(0, 6) r(x)")
def quorum_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers = spark.range(6).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("provider"))
    cells = spark.createDataFrame([("p0", "h", "verified", None), ("p1", "x", "verified", None), ("p2", "h", "failed", None), ("p3", "h", "verified", "2020-01-01T00:00:00Z"), ("p4", "h", "verified", "2999-01-01T00:00:00Z"), ("p4", "x", "failed", None)], "provider string, scenario_set_hash string, status string, expires_at string")
    return gates.quorum_table(providers, cells, "h", datetime(2026, 1, 1, tzinfo=UTC).isoformat())


@query("digests", "SELECT doc_id, concat('sha256:', sha256(text)) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as tx

    return t.table(spark, sf_dir, "documents").select("doc_id", tx.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("canonical_json", "SELECT event_id, concat('{\"a\":[1,2],\"k\":', json_extract_string(props, '$.k'), ',\"token\":\"[REDACTED]\"}') AS canonical FROM events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"token": "x", "k": '), F.get_json_object("props", "$.k"), F.lit('.0, "a": [1.0, 2]}'))
    return t.table(spark, sf_dir, "events").select("event_id", identity.over_rows(lambda x: identity.without_secrets(x)[0], raw).alias("canonical"))


class Counter:
    """A small environment: adding to a number until it reaches ten."""

    def reset(self, scenario):
        return {"n": 0}

    def step(self, state, tool, argument):
        n = state["n"] + (argument if tool == "add" else 0)
        return {"n": n}, str(n), n >= 10

    def validate(self, state, name):
        return state["n"] >= 10 if name == "reached" else state["n"] / 20


_ENVIRONMENT = [{"id": f"s{i}", "environment": {"maxSteps": 6, "toolPolicy": {"denied": ["drop"]}, "validators": ["reached", "share"]}} for i in range(5)]


@query("environment_scores")
def environment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded tool calls played against a small environment."""
    e = t.table(spark, sf_dir, "events").where("event_id < 2000")
    actions = e.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("runner_id"), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("scenario_id"), F.col("event_id").cast("int").alias("step"),
        F.when(F.col("event_type") == "error", "drop").otherwise("add").alias("tool"), (F.col("event_id") % 5).cast("string").alias("argument"),
    )
    return environment.final_scores(environment.run(actions, _ENVIRONMENT, Counter()), _ENVIRONMENT, Counter())


_REPLAY = [{"id": f"s{i}", "axes": ["recall"], "rubric": {"kind": "programmatic", "checker": "contains", "params": {"expected": ["the", "tion"], "smokeTestOnly": True}}} for i in range(3)]


@query("proof_replay", "WITH d AS (SELECT doc_id, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'tion') AS INT)) / 2 AS v FROM documents) SELECT 'score differs' AS problem, concat('r', doc_id) AS runner_id, concat('s', doc_id % 4) AS scenario_id, 'recall' AS axis, v + 0.25 AS recorded, v AS replayed FROM d WHERE doc_id % 4 <> 3 AND doc_id % 10 = 0 UNION ALL SELECT 'unknown scenario', concat('r', doc_id), 's3', NULL, NULL, NULL FROM d WHERE doc_id % 4 = 3")
def proof_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents")
    responses = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("runner_id"), F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("scenario_id"), F.col("text").alias("output"), "doc_id")
    recorded = scoring.score_responses(responses, _REPLAY).withColumn("value", F.col("value") + F.when(F.substring("runner_id", 2, 20).cast("long") % 10 == 0, 0.25).otherwise(0.0))
    return proof.replay_scores(responses, _REPLAY, recorded)
