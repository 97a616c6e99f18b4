"""Export views: tasks, result lines, test reports, annotations, metrics and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

PASS = 1.0


def tasks(scores: DataFrame, responses: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """One row for each (runner_id, scenario_id) that has a score or a response.

    The last response of a key counts; scores are in their order; mean_score is
    null without any. scenarios: scenario_id, prompt, tier. A key's scores are
    gathered in one list, but only where the column scores is read.
    """
    return counted_tasks(scores, responses, scenarios).drop("n_scores")


def counted_tasks(scores: DataFrame, responses: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """As ``tasks``, and n_scores (0 without any), which is counted without the lists."""
    keys = ["runner_id", "scenario_id"]
    wanted = scores.select(*keys).union(responses.select(*keys)).distinct()
    answer = responses.groupBy(*keys).agg(F.max_by(F.struct("output", "latency_ms"), "response_ord").alias("r"))
    scored = scores.groupBy(*keys).agg(in_order("score_ord", "axis", "value").alias("scores"), F.avg("value").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    out = wanted.join(answer, keys, "left").join(scored, keys, "left")
    n_scores = F.coalesce("n", F.lit(0)).alias("n_scores")
    if scenarios is None:
        return out.select(*keys, "r.output", "r.latency_ms", "scores", "mean_score", n_scores)
    out = out.join(scenarios.select("scenario_id", "prompt", "tier"), "scenario_id", "left")
    shown = privacy(F.col("tier"))
    state = F.when(F.col("r").isNull(), "omitted-missing").when(shown == "private", "omitted-private").otherwise("included")
    notes = F.array_compact(F.array(F.when(F.col("r").isNull(), F.lit("no response was recorded")), F.when(F.col("n").isNull(), F.lit("no score was recorded")), F.when(shown == "private", F.lit("prompt and output are withheld"))))
    public = shown == "public"
    return out.select(*keys, shown.alias("privacy"), F.when(public, F.col("prompt")).alias("prompt"), F.when(public, F.col("r.output")).alias("output"), state.alias("output_state"), "r.latency_ms", "scores", "mean_score", notes.alias("lossiness"), n_scores)


def in_order(order: str, *fields: str) -> Column:
    """An aggregate: the rows' fields as a list of structs, in order. ``sort_array`` compares as ``array_sort`` does, but in compiled code."""
    rows = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return F.arrays_zip(*[rows[x].alias(x) for x in fields])


def privacy(tier: Column) -> Column:
    """private for private and holdout tiers (and any name that begins so: unknown private tiers aren't given away), else public."""
    t = F.lower(F.coalesce(tier, F.lit("")))
    return F.when(t.startswith("private") | t.startswith("holdout"), "private").otherwise("public")


def matching_references(references: DataFrame, task_keys: DataFrame) -> DataFrame:
    """task_keys with their references (ref, scenario_id, runner_id; null matches anything): three equi-joins instead of a theta join."""
    r = references.select(F.col("ref"), F.col("scenario_id").alias("s"), F.col("runner_id").alias("n"))
    everywhere = task_keys.crossJoin(F.broadcast(r.where("s is null").select("ref")))
    scenario = task_keys.join(r.where("s is not null and n is null"), F.col("scenario_id") == F.col("s")).select(*task_keys.columns, "ref")
    both = task_keys.join(r.where("s is not null and n is not null"), (F.col("scenario_id") == F.col("s")) & (F.col("runner_id") == F.col("n"))).select(*task_keys.columns, "ref")
    return reduce(DataFrame.unionByName, [everywhere, scenario, both])


def result_lines(task_rows: DataFrame, aggregates: DataFrame) -> DataFrame:
    """line_ord, line: tasks, then aggregates, as JSON text."""
    a = task_rows.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("task").alias("type"), *task_rows.columns)).alias("line"))
    b = aggregates.select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("aggregate").alias("type"), *aggregates.columns)).alias("line"))
    return a.unionByName(b)


def junit_cases(scores: DataFrame, threshold: float = PASS) -> DataFrame:
    """runner_id, scenario_id, axis, failed, case: an XML element for each score."""
    failed = F.col("value") < threshold
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), tx.xml(c), F.lit('"'))
    head = F.concat(F.lit("<testcase"), attr("classname", F.col("runner_id")), attr("name", F.concat("scenario_id", F.lit(" ["), "axis", F.lit("]"))), F.lit(">"))
    body = F.when(failed, F.concat(F.lit("<failure"), attr("message", F.concat(F.lit("score "), number(F.col("value")), F.lit(f" is under {threshold:g}"))), F.lit("/>"))).otherwise(F.lit(""))
    return scores.select("runner_id", "scenario_id", "axis", failed.alias("failed"), F.concat(head, body, F.lit("</testcase>")).alias("case"))


def junit(scores: DataFrame, name: str = "evaluation", threshold: float = PASS) -> DataFrame:
    """runner_id, suite: an XML test suite for each runner."""
    cases = junit_cases(scores, threshold)
    by = cases.groupBy("runner_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scenario_id", "axis", "case"))), lambda x: x["case"]), "\n").alias("body"))
    return by.select("runner_id", F.concat(F.lit(f'<testsuite name="{name}:'), tx.xml(F.col("runner_id")), F.lit('" tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("f").cast("string"), F.lit('">\n'), "body", F.lit("\n</testsuite>")).alias("suite"))


def number(x: Column) -> Column:
    """A short decimal: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", ""), r"\.$", "")


def workflow_annotations(scores: DataFrame, threshold: float = PASS) -> DataFrame:
    """ord, command: one notice, and an error for each score under the threshold."""
    total = scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < threshold).alias("bad"))
    notice = total.select(F.lit(0).alias("ord"), F.concat(F.lit("::notice title=evaluation::"), tx.workflow_message(F.concat(F.col("n").cast("string"), F.lit(" scores, "), F.col("bad").cast("string"), F.lit(" under threshold")))).alias("command"))
    title = tx.workflow_property(F.concat("runner_id", F.lit("/"), "scenario_id"))
    errors = scores.where(F.col("value") < threshold).select(F.lit(1).alias("ord"), F.concat(F.lit("::error title="), title, F.lit("::"), tx.workflow_message(F.concat("axis", F.lit(" scored "), number(F.col("value"))))).alias("command"))
    return notice.unionByName(errors)


def experiment_metrics(scores: DataFrame, board: DataFrame, axes: DataFrame) -> DataFrame:
    """runner_id, name, step, value: scores in order, composites and axis means."""
    step = F.row_number().over(Window.partitionBy("runner_id", "axis").orderBy("score_ord")) - 1
    a = scores.select("runner_id", F.concat(F.lit("score/"), "axis").alias("name"), step.cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    b = board.select("runner_id", F.lit("composite").alias("name"), F.lit(0).cast("long").alias("step"), F.col("composite").alias("value"))
    c = axes.select("runner_id", F.concat(F.lit("mean/"), "axis").alias("name"), F.lit(0).cast("long").alias("step"), F.col("mean").alias("value"))
    return a.unionByName(b).unionByName(c)


def spans(task_rows: DataFrame, run_id: str, started: str) -> DataFrame:
    """trace_id, span_id, parent_id, name, start_time, duration_ms, status, attributes: the run, and a span of it for each task.

    task_rows: runner_id, scenario_id, mean_score, latency_ms, and privacy and output_state if scenarios were given.
    """
    one = lambda *parts: tx.stable_id(F.concat_ws(":", *parts))
    run, trace = F.lit(run_id), one(F.lit("trace"), F.lit(run_id))
    root = one(F.lit("span"), F.lit("run"), run)
    told = [c for c in ("privacy", "output_state") if c in task_rows.columns]
    attributes = F.map_from_arrays(F.array(*[F.lit(c) for c in ("runner_id", "scenario_id", *told)]), F.array("runner_id", "scenario_id", *told))
    tasks_ = task_rows.select(
        trace.alias("trace_id"), one(F.lit("span"), F.lit("task"), run, F.col("runner_id"), F.col("scenario_id")).alias("span_id"), root.alias("parent_id"), F.lit("task").alias("name"), F.lit(started).alias("start_time"),
        F.col("latency_ms").cast("double").alias("duration_ms"), F.when(F.col("mean_score").isNull(), "unknown").otherwise("ok").alias("status"), attributes.alias("attributes"),
    )
    whole = task_rows.sparkSession.range(1).select(
        trace.alias("trace_id"), root.alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("run").alias("name"), F.lit(started).alias("start_time"), F.lit(None).cast("double").alias("duration_ms"), F.lit("unknown").alias("status"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    return whole.unionByName(tasks_)


WITHHELD = "[REDACTED: private scenario prompt omitted]"


def inspect_samples(scenarios: DataFrame) -> DataFrame:
    """id, input (withheld for private tiers), target (never given), privacy, axes of scenarios (scenario_id, prompt, tier, axes)."""
    shown = privacy(F.col("tier"))
    return scenarios.select(F.col("scenario_id").alias("id"), F.when(shown == "public", F.col("prompt")).otherwise(F.lit(WITHHELD)).alias("input"), F.lit(None).cast("string").alias("target"), shown.alias("privacy"), "axes")


def base_lossiness(has_dataset: bool) -> list[dict]:
    """What an export leaves out whatever the run."""
    out = [{"code": "no-trace-payloads", "detail": "Traces are named, not included."}]
    return out if has_dataset else [*out, {"code": "no-dataset", "detail": "Without the data set, prompts are missing and their privacy is unknown."}]


def portable(record: dict, task_rows: list[dict], has_dataset: bool) -> dict:
    """A run as one document: its identity, tasks, aggregates, and what was left out."""
    keep = ("id", "dataset", "createdAt", "runners", "scenarioSetHash", "scenarioSetHashSchemaVersion")
    run = {k: record[k] for k in keep if record.get(k) is not None} | {"harnessVersion": (record.get("meta") or {}).get("harnessVersion")}
    return {"schemaVersion": "portable-run.v1", "run": run, "tasks": task_rows, "aggregates": record.get("aggregates", []), "references": record.get("references", []), "lossiness": base_lossiness(has_dataset)}


def harness_summary(scores: DataFrame, dataset: str) -> DataFrame:
    """task (dataset:runner), metrics: map of axis to mean."""
    means = scores.groupBy("runner_id", "axis").agg(F.avg("value").alias("m"))
    return means.groupBy("runner_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "m")))).alias("metrics")).select(F.concat(F.lit(f"{dataset}:"), "runner_id").alias("task"), "metrics")


def axis_table(axes: DataFrame) -> DataFrame:
    """runner_id and a column of text for each axis: its mean, or N/A."""
    names = [r["axis"] for r in axes.select("axis").distinct().orderBy("axis").collect()]
    wide = axes.groupBy("runner_id").pivot("axis", names).agg(F.first("mean"))
    return wide.select("runner_id", *[F.when(F.col(f"`{n}`").isNull(), F.lit("N/A")).otherwise(F.format_string("%.3f", F.col(f"`{n}`"))).alias(n) for n in names]) if names else wide


def markdown(board: DataFrame, axes: DataFrame) -> str:
    """The leaderboard and the table of axes as text; both have a row for each runner only."""
    lines = ["| rank | runner | composite |", "|---|---|---|"] + [f"| {r['rank']} | {r['runner_id']} | {r['composite']:.3f} |" for r in board.orderBy("rank").collect()]
    wide = axis_table(axes).orderBy("runner_id")
    lines += ["", "| " + " | ".join(wide.columns) + " |", "|" + "---|" * len(wide.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in wide.collect()])


def runner_metadata(responses: DataFrame) -> DataFrame:
    """runner_id with sorted distinct providers and models, latency figures and the first and last access."""
    return responses.groupBy("runner_id").agg(
        F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.collect_set("model")).alias("models"), F.count(F.lit(1)).alias("responses"),
        F.min("latency_ms").alias("min_latency"), F.max("latency_ms").alias("max_latency"), F.round(F.avg("latency_ms"), 3).alias("mean_latency"), F.min("accessed_at").alias("first_access"), F.max("accessed_at").alias("last_access"),
    )
