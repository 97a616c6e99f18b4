"""Steps whose time or memory once grew faster than the input: what their plans and batches hold."""

from __future__ import annotations

import inspect
import json

import numpy as np
import pyarrow as pa
from evalweave.functions import scanning, shingling
from evalweave.functions import text as tx
from evalweave.operators import audit, export
from evalweave.plans import catalog
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_count_scores_without_gathering_them(spark, sf_dir):
    for name in ("tasks", "experiment_spans"):
        assert "collect_list" not in _plan(catalog.QUERIES[name](spark, sf_dir)), name
    scores = spark.createDataFrame([("r", "s", "A", 0.5, 1), ("r", "s", "B", 1.0, 2)], "runner_id string, scenario_id string, axis string, value double, score_ord int")
    responses = spark.createDataFrame([("r", "s", "x", 1.0, 1), ("r", "t", "y", 2.0, 2)], "runner_id string, scenario_id string, output string, latency_ms double, response_ord int")
    assert {r["scenario_id"]: (r["n_scores"], r["mean_score"]) for r in export.counted_tasks(scores, responses).collect()} == {"s": (2, 0.75), "t": (0, None)}
    assert "n_scores" not in export.tasks(scores, responses).columns


def test_result_lines_sort_scores_in_compiled_code(spark, sf_dir):
    assert "array_sort(" not in _plan(catalog.QUERIES["result_lines"](spark, sf_dir))
    scores = spark.createDataFrame([("r", "s", a, v, o) for a, v, o in (("C", 0.3, 3), ("A", None, 1), ("B", 0.2, 2), (None, 0.1, None))], "runner_id string, scenario_id string, axis string, value double, score_ord int")
    responses = spark.createDataFrame([("r", "t", "y", 2.0, 2)], "runner_id string, scenario_id string, output string, latency_ms double, response_ord int")
    aggregates = spark.createDataFrame([("r", 1)], "runner_id string, n int")
    lines = [json.loads(r["line"]) for r in export.result_lines(export.tasks(scores, responses), aggregates).collect()]
    assert {x["scenario_id"]: x.get("scores") for x in lines if x["type"] == "task"} == {"s": [{"value": 0.1}, {"axis": "A"}, {"axis": "B", "value": 0.2}, {"axis": "C", "value": 0.3}], "t": None}


def test_scenario_diff_reads_each_text_once_for_a_join(spark, sf_dir):
    plan = _plan(catalog.QUERIES["scenario_diff"](spark, sf_dir))
    assert plan.count("Join ") == 2 and plan.count("regexp_replace(") == 2 and "sha2(" in plan
    schema = "id string, prompt string, fingerprint string"
    before = spark.createDataFrame([("a", "One  two", "1"), ("b", "x", "2"), ("c", "y", "3"), (None, "z", "4"), ("d", None, None)], schema)
    after = spark.createDataFrame([("a", " one two\u2003", "1"), ("b", "x", "9"), ("e", "ONE TWO", "5"), (None, "q", "4"), ("d", None, None)], schema)
    got = {tuple(r) for r in audit.scenario_diff(before, after).collect()}
    assert got == {("added", "e", None), ("added", None, None), ("removed", "c", None), ("removed", None, None), ("changed", "b", None), ("overlap", "a", "e")}


def test_normalise_uses_one_pattern(spark):
    cases = {"": "", "  \t": "", "\ufeff A\u00a0\u2009B\n\x0bc ": "a b c", "a\x1cb": "a\x1cb"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", tx.normalise(F.col("t")).alias("n"))
    assert _plan(df).count("regexp_replace(") == 1
    assert {r["t"]: r["n"] for r in df.collect()} == cases | {None: None}


def test_shingles_go_through_workers_in_pieces(spark):
    batch = pa.record_batch({"i": list(range(6)), "t": ["a" * 10, None, "b" * 100, "", "c" * 20, "d" * 20]})
    sizes = [[r["i"] for r in p.to_pylist()] for p in shingling.pieces(batch, "t", 60)]
    assert sizes == [[0, 1], [2], [3, 4], [5]]
    texts = ["one two three four five six", "six\x1cone two three four five", "x\ufeffy", None, "", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    whole = {r["i"]: r["shingles"] for r in shingling.with_shingles(df, "t", 5).collect()}
    assert [len(whole[i]) for i in range(6)] == [2, 1, 2, 0, 0, 2]
    keys = np.array([whole[0][1], whole[5][0], 7], np.int64)
    some = {r["i"]: r["shingles"] for r in shingling.with_shingles(df, "t", 5, keys).collect()}
    assert some == {i: [x for x in v if x in keys] for i, v in whole.items()}
    assert all(r["shingles"] == [] for r in shingling.with_shingles(df, "t", 5, keys[:0]).collect())


def test_leakage_explodes_no_training_text(spark, sf_dir):
    """Few n-grams are looked up in the workers; a larger evaluation, whose n-grams move, finds the same."""
    prompts = spark.createDataFrame([(1, 1, "one two three four five six seven"), (2, 2, "Alpha  beta gamma delta epsilon"), (3, 3, None), (4, 4, "")], "id int, ord int, prompt string")
    training = spark.createDataFrame([(10, 10, None), (11, 11, "x one two three four five six seven y"), (12, 12, "alpha beta gamma delta epsilon "), (13, 13, "one two three four five six seven")], "id int, ord int, prompt string")
    want = {(1, "exact", 13, 1.0), (2, "exact", 12, 1.0)}
    assert {tuple(r) for r in audit.leakage(prompts.where("id <> 4"), training).collect()} == want
    grown = prompts.where("id = 1").withColumn("prompt", F.concat("prompt", F.lit(" z")))
    few = {tuple(r) for r in audit.leakage(grown, training).collect()}
    limit, audit.BROADCAST_ROWS = audit.BROADCAST_ROWS, 0
    try:
        assert {tuple(r) for r in audit.leakage(grown, training).collect()} == few == {(1, "ngram", 11, 0.75)}
    finally:
        audit.BROADCAST_ROWS = limit


def test_near_duplicates_writes_what_it_reads_again(spark, sf_dir):
    plan = _plan(catalog.QUERIES["near_duplicates"](spark, sf_dir))
    assert "MapInArrow" not in plan and "Window" not in plan and "regexp_replace" not in plan


def test_hits_take_arrow_batches(spark):
    df = spark.createDataFrame([("do not flag. the flag",), (None,), ("do not flag",), ("",)], "t string").coalesce(1).select(scanning.hits(F.col("t"), ["flag"], ["not"]).alias("h"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString() and "pandas" not in inspect.getsource(scanning)
    assert [r["h"] for r in df.collect()] == [[True, True], [False, False], [False, True], [False, False]]


def test_audit_findings_finds_before_it_numbers(spark, sf_dir):
    plan = _plan(catalog.QUERIES["audit_findings"](spark, sf_dir))
    assert "Relation [doc_id" not in plan and "MapInArrow" not in plan  # findings are written before they are numbered
