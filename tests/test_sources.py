"""Readers, writers, ledgers, human labels, audits, environments and streams on small inputs."""

from __future__ import annotations

import json

import pytest
from evalweave.operators import audit, environment, gates, human, ledger, persistence, proof, scoring
from evalweave.sources import datasets, sinks
from evalweave.streaming import ledger as streams
from pyspark.sql import functions as F

PLAIN = {"id": "b", "axes": ["x"], "input": {"messages": [{"role": "user", "content": "say hello"}]}, "rubric": {"kind": "programmatic", "checker": "exact-match", "params": {"expected": "hello"}}}


def test_datasets(spark, tmp_path):
    d = tmp_path / "corpus" / "scenarios"
    d.mkdir(parents=True)
    (d / "1.json").write_text(json.dumps(PLAIN))
    (d / "2.json").write_text(json.dumps(PLAIN | {"id": "a"}))
    (tmp_path / "corpus" / "dataset.json").write_text(json.dumps({"name": "n", "version": "1"}))
    data = datasets.load_dataset(str(tmp_path / "corpus"))
    assert data["name"] == "n" and [s["id"] for s in data["scenarios"]] == ["a", "b"]
    rows = datasets.scenarios(spark, data).select("id", "shape", datasets.prompt(F.col("messages")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("a", "plain", "say hello"), ("b", "plain", "say hello")]
    assert sorted(r["id"] for r in datasets.scenario_files(spark, str(tmp_path / "corpus")).collect()) == ["a", "b"]
    bundle = tmp_path / "bundle.json"
    bundle.write_text(json.dumps({"name": "n", "version": "1", "scenarios": [PLAIN, {"id": "m", "meta": {"multiTurn": True}}]}))
    with pytest.raises(gates.GateError) as e:
        datasets.load_dataset(str(bundle))
    assert any("meta.multiTurn" in x for x in e.value.errors)
    bundle.write_text("{}")
    with pytest.raises(gates.GateError, match="name is missing"):
        datasets.load_dataset(str(bundle))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "run.jsonl")
    head = ledger.header("r1", {"name": "n", "version": "1"}, "h", ["a", "b"], {"maxTokens": 5, "topP": None})
    w = sinks.LedgerWriter(path, head)
    w.cell(runId="r1", runnerId="a", scenarioId="s", status="failed", error="x")
    w.cell(runId="r1", runnerId="a", scenarioId="s", status="completed", outcome={"latencyMs": 3.0, "responses": [], "scores": []})
    with pytest.raises(FileExistsError):
        sinks.LedgerWriter(path, head)
    sinks.LedgerWriter(path, head, resume=True)
    got, cells = datasets.read_ledger(spark, path)
    assert got["runnerOptionsHash"] == head["runnerOptionsHash"]
    assert [r["status"] for r in ledger.latest(cells).collect()] == ["completed"]
    runners, scenarios = spark.createDataFrame([("a",), ("b",)], "runner_id string"), spark.createDataFrame([("s",)], "scenario_id string")
    assert [tuple(r) for r in ledger.incomplete(cells, runners, scenarios).collect()] == [("b", "s", "missing")]
    with pytest.raises(ledger.LedgerIncomplete, match="b/s: missing"):
        ledger.rebuild(cells, runners, scenarios)
    ledger.check_resume(head, head | {"runId": "other"})
    with pytest.raises(ledger.LedgerMismatch, match="scenarioSetHash"):
        ledger.check_resume(head, head | {"scenarioSetHash": "z"})
    assert datasets.read_ledger(spark, str(tmp_path / "none"))[0] is None


def test_traces_and_cache(spark, tmp_path):
    name = sinks.write_trace(str(tmp_path), {"apiKey": "x", "v": 1})
    assert name.startswith("sha256-") and json.loads((tmp_path / name).read_text())["apiKey"] == "[REDACTED]"
    answers = spark.createDataFrame([("k", "old", 10), ("k", "new", 500)], "key string, answer string, saved_at_ms long")
    sinks.remember(answers, str(tmp_path / "cache"))
    hit = sinks.cached(spark.createDataFrame([("k",), ("q",)], "key string"), spark.read.parquet(str(tmp_path / "cache")), 1400, 1)
    assert {r["key"]: r["answer"] for r in hit.collect()} == {"k": "new", "q": None}
    miss = sinks.cached(spark.createDataFrame([("k",)], "key string"), answers, 1500, 1)
    assert miss.first()["answer"] is None


def test_human(spark, tmp_path):
    base = {"itemId": "i", "scenarioHash": "h", "rubricVersion": "1", "annotatedAt": "2026-01-01T00:00:00Z", "reviewer": "x"}
    rows = [base | {"responseId": "p", "label": "pass", "score": 0.9, "status": "agreed"}, base | {"responseId": "q", "label": "fail", "score": 0.1, "status": "agreed"}, base | {"responseId": "q", "label": "pass", "score": 2, "status": "pending", "reviewer": ""}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"annotations": rows}))
    a = datasets.annotations(spark, str(path))
    assert sorted(r["error"] for r in human.validate(a).collect()) == ["reviewer is empty", "score lies outside 0..1"]
    assert [tuple(r) for r in human.preference_pairs(a).select("chosen", "rejected").collect()] == [("p", "q")]
    assert [tuple(r.labels) for r in human.conflicts(a).collect()] == [("fail", "pass")]
    d = spark.createDataFrame([("i", "q", "pass", 0.5, "judge", None, None, "2026-02-01T00:00:00Z", 1)], "item_id string, response_id string, label string, score double, adjudicator string, scenario_hash string, rubric_version string, adjudicated_at string, decision_ord long")
    settled = human.adjudicate(a, d)
    assert human.conflicts(settled).count() == 0
    assert {r["response_id"]: r["label"] for r in human.terminal(settled).collect()} == {"p": "pass", "q": "pass"}


def test_persistence(spark):
    turns = spark.createDataFrame([("c", 0, "I keep the budget at 40", "u0", 0), ("c", 1, "do not raise the budget", "push hard", 1), ("c", 2, "", "u2", 2)], "conv_id string, turn_index int, assistant_text string, user_message string, turn_ord int")
    conv = persistence.turn_map(turns, ["conv_id"])
    criteria = [
        {"id": "f", "kind": "fact-persistence", "targetTurnIndex": 1, "factPhrases": ["budget"]},
        {"id": "d", "kind": "disposition-persistence", "targetTurnIndex": 1, "disposition": "d", "holdPhrases": ["the budget"], "flipPhrases": ["raise the budget"]},
        {"id": "c", "kind": "constraint-persistence", "targetTurnIndex": 1, "establishedAtTurn": 0, "constraint": "c", "violationPhrases": ["raise"], "acknowledgePhrases": ["budget"]},
        {"id": "e", "kind": "fact-persistence", "targetTurnIndex": 2, "factPhrases": ["x"]},
        {"id": "g", "kind": "fact-persistence", "targetTurnIndex": 9, "factPhrases": ["x"]},
        {"id": "m", "kind": "mechanism-persistence", "targetTurnIndex": 1, "mechanism": "m", "pressureTurnIndex": 1, "pressurePhrases": ["push"], "retainedInvariantPhrases": ["budget"], "forbiddenReversalPhrases": ["raise"]},
        {"id": "u", "kind": "evidence-update", "targetTurnIndex": 1, "update": "u", "newEvidenceTurnIndex": 0, "newEvidencePhrases": ["u0"], "updatedDiagnosisPhrases": ["budget"], "staleDiagnosisPhrases": ["forty"]},
    ]
    got = {r["criterion_id"]: (r["verdict"], r["reason"]) for r in persistence.grade_all(conv, criteria).collect()}
    assert got == {"f": ("pass", "persisted"), "d": ("fail", "forgotten"), "c": ("pass", "persisted"), "e": ("fail", "target-turn-empty"), "g": ("fail", "target-turn-missing"), "m": ("pass", "persisted"), "u": ("pass", "persisted")}
    value = persistence.scenario_scores(conv, persistence.grade_all(conv, criteria), ["conv_id"]).first()["value"]
    assert value == pytest.approx(4 / 7)
    e = spark.createDataFrame([("persistence-grader-v1", "h", "t", "now", 2, 2), ("v0", "h", "t", "now", 2, 2), ("persistence-grader-v1", "x", "t", "now", 2, 2), ("persistence-grader-v1", "h", "", "now", 2, 2), ("persistence-grader-v1", "h", "t", "now", 2, 1)], "grader_version string, scenario_set_hash string, trace_ref string, recorded_at string, criteria_total int, criteria_passed int")
    assert [r[0] for r in e.select(persistence.evidence_validity("h")).collect()] == ["valid", "unsupported-grader-version", "scenario-set-hash-mismatch", "missing-trace-reference", "criteria-not-all-passed"]


def test_audit(spark):
    p = spark.createDataFrame([("a", 0, "one two three four five six seven"), ("b", 1, "One  two three four five six seven"), ("c", 2, "one two three four five six seven eight"), ("d", 3, "todo")], "id string, ord int, prompt string")
    found = audit.audit(p, spark.createDataFrame([(1, 1, "zero one two three four five six seven eight nine")], "id long, ord long, prompt string"), spark.createDataFrame([("a", 1.0)], "scenario_id string, value double"))
    rows = [(r["finding_id"], r["kind"], tuple(r["ids"])) for r in found.orderBy("finding_id").collect()]
    assert rows[0] == ("D001", "duplicate", ("a", "b"))
    assert {r[2] for r in rows if r[1] == "near-duplicate"} == {("a", "c"), ("b", "c")}
    assert {r[2] for r in rows if r[1] == "leakage"} == {("a",), ("b",), ("c",)}
    s = audit.summary(found).first()
    assert s["errors"] == 4 and s["blocking_kinds"] == ["duplicate", "leakage"]
    assert audit.adversarial_probes(p, 2).count() == 8
    drift = audit.release_drift(spark.createDataFrame([(5, "abcdef0123456789", None, "allowed")], "scenario_count int, hash string, quorum string, claim_state string"), spark.createDataFrame([("d", "7 scenarios, hash abcdef012345, claims are blocked")], "document_id string, text string"))
    assert sorted((r["fact"], r["found"]) for r in drift.collect()) == [("claim_state", "blocked"), ("scenario_count", "7")]
    facts = spark.createDataFrame([("a", "f", "2026-01-01T00:00:00Z", None), ("a", "g", None, 1), ("a", "h", "2026-06-01T00:00:00Z", 30)], "id string, fact_id string, observed_at string, max_age_days int")
    assert [(r["fact_id"], r["age_days"]) for r in audit.stale_facts(facts, "2026-06-02T00:00:00Z").collect()] == [("f", 152)]


def test_environment(spark):
    class Counter:
        def reset(self, scenario):
            return 0

        def step(self, state, tool, argument):
            return state + argument, str(state + argument), state + argument >= 3

        def validate(self, state, name):
            return state >= 3

    s = [{"id": "s", "environment": {"maxSteps": 5, "toolPolicy": {"denied": ["rm"]}, "validators": ["done"]}}]
    actions = spark.createDataFrame([("r", "s", 0, "add", "1"), ("r", "s", 1, "rm", "1"), ("r", "s", 2, "add", "2"), ("r", "s", 3, "add", "9")], "runner_id string, scenario_id string, step int, tool string, argument string")
    steps = environment.run(actions, s, Counter())
    assert [(r["observation"], r["error"] is None, r["done"]) for r in steps.orderBy("step").collect()] == [("1", True, False), ("", False, False), ("3", True, True)]
    assert environment.final_scores(steps, s, Counter()).first()["value"] == 1.0
    turns = environment.run_multi_turn(spark.createDataFrame([("m", None, ["a", "b"])], "scenario_id string, system_prompt string, user_turns array<string>"), lambda messages: f"{len(messages)}", "stub")
    assert [r["assistant_text"] for r in turns.orderBy("turn_index").collect()] == ["1", "3"]


def test_proof(spark):
    record = {"id": "r", "createdAt": "t", "dataset": {"name": "n", "version": "1"}, "scenarioSetHash": "h", "responses": [{"runnerId": "a", "scenarioId": "b", "output": "hello", "meta": {"provider": "p", "model": "m", "accessedAt": "t", "latencyMs": 3}}], "scores": [{"runnerId": "a", "scenarioId": "b", "axis": "x", "value": 1}], "aggregates": []}
    assert gates.record_errors(record) == [] and gates.record_errors({"id": ""})
    m = proof.build(record, {"name": "n"})
    assert proof.verify(m, record, {"name": "n"}) == []
    assert "scores: checksum differs" in proof.verify(m, record | {"scores": [record["scores"][0] | {"value": 0}]}, {"name": "n"})
    scores, responses = datasets.record_tables(spark, record)
    assert proof.replay_scores(responses, [PLAIN], scores).count() == 0
    assert proof.replay_board(responses, [PLAIN]).first()["composite"] == 1.0
    assert scoring.score_responses(responses, [PLAIN]).first()["claim_status"] == "programmatic"
    outcomes = spark.createDataFrame([("tp",), ("tn",)], "outcome_type string")
    errors = gates.claim_errors(record, scores, outcomes, ["duplicate"], None)
    assert "there is no claim card" in errors and "audit: duplicate" in errors
    with pytest.raises(gates.HashMismatch):
        gates.assert_same_set("a", "b")
    assert gates.unexpected_keys({"a": 1, "b": [{"c": 1, "z": 2}]}, {"a": None, "b": {"c": None}}) == ["$.b[0].z"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("r", "s", "failed", 1), ("r", "s", "completed", 2)], "runner_id string, scenario_id string, status string, line_no long").write.parquet(str(src))
    stream = spark.readStream.schema("runner_id string, scenario_id string, status string, line_no long").parquet(str(src))
    streams.merge_into(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert ledger.latest(spark.read.parquet(str(tmp_path / "out"))).first()["status"] == "completed"
