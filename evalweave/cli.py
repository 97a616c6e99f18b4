"""Command line: one command for each thing the engine does with files.

``python -m evalweave.cli COMMAND ...``; ``--help`` lists the commands.
"""

from __future__ import annotations

import argparse
import importlib
import json
import re
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import functions as F

from .operators import aggregate, audit, compare, diagnostics, export, gates, human, identity, persistence, proof, rubrics, scoring
from .session import local_session
from .sources import datasets, sinks


def fingerprint(spec: str) -> dict:
    """id[@version][#digest] as a document."""
    m = re.match(r"^([^@#]+)(?:@([^#]*))?(?:#(.*))?$", spec)
    if not m:
        raise ValueError(f"not a fingerprint: {spec}")
    return {k: v for k, v in zip(("id", "version", "digest"), m.groups(), strict=True) if v}


def share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1 is needed")
    return x


def _print(x: object) -> None:
    print(json.dumps(x, indent=2, ensure_ascii=False, default=str))


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _named(spec: str):
    """module:name as the object that it names."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _list(a, spark) -> None:
    data = datasets.load_dataset(a.dataset)
    _print({"name": data["name"], "version": data["version"], "scenarios": [{"id": s["id"], "axes": s.get("axes", [])} for s in data["scenarios"]]})


def _run(a, spark) -> None:
    """Answers by a stub runner, scored and aggregated into a run record."""
    data = datasets.load_dataset(a.dataset)
    judge = _named(a.judge) if a.judge else None
    plain = [s for s in data["scenarios"] if s.get("rubric") and s.get("environment") is None and not s.get("multiTurn")]
    if (others := [s["id"] for s in data["scenarios"] if s not in plain]) and not a.plain_only:
        raise SystemExit(f"multi-turn and environment scenarios need a model, which run hasn't: {', '.join(others)} (--plain-only leaves them out)")
    for s in plain:
        try:
            rubrics.checked(s["rubric"], judge)
        except ValueError as e:
            raise SystemExit(f"{s['id']}: {e}") from e
    table = datasets.scenarios(spark, data).where(F.col("id").isin([s["id"] for s in plain]))
    answers = None
    for kind in a.runner:
        one = table.select(F.lit(f"stub:{kind}").alias("runner_id"), F.col("id").alias("scenario_id"), persistence.stub_response(F.col("messages"), kind).alias("output"))
        answers = one if answers is None else answers.unionByName(one)
    scores = scoring.score_responses(answers, plain, judge).withColumn("score_ord", F.struct("runner_id", "scenario_id", "axis_ord"))
    board = aggregate.leaderboard(scores)
    axes = {}
    for r in _rows(aggregate.axis_summary(scores)):
        axes.setdefault(r["runner_id"], {})[r["axis"]] = {k: r[k] for k in ("mean", "variance", "n")}
    record = {
        "id": a.id, "createdAt": a.created, "dataset": {"name": data["name"], "version": data["version"]}, "scenarioSetHash": identity.scenario_set_hash(spark, data["name"], data["version"], data["scenarios"]),
        "responses": [{"runnerId": r["runner_id"], "scenarioId": r["scenario_id"], "output": r["output"], "meta": {"provider": "stub", "model": r["runner_id"], "accessedAt": a.created, "latencyMs": 0}} for r in _rows(answers.orderBy("runner_id", "scenario_id"))],
        "scores": [{"runnerId": r["runner_id"], "scenarioId": r["scenario_id"], "axis": r["axis"], "value": r["value"], "claimStatus": r["claim_status"]} for r in _rows(scores.orderBy("score_ord"))],
        "aggregates": [{"runnerId": r["runner_id"], "composite": r["composite"], "axes": axes[r["runner_id"]]} for r in _rows(board.orderBy("rank"))],
    }
    sinks.write_json(a.out, record) if a.out else _print(record)


def _tables(spark, path):
    return datasets.record_tables(spark, datasets.read_record(path))


def _compare(a, spark) -> None:
    one, two = datasets.read_record(a.a), datasets.read_record(a.b)
    x, y = datasets.record_tables(spark, one)[0], datasets.record_tables(spark, two)[0]
    eligible = compare.interval_eligibility(x, y, one.get("scenarioSetHash"), two.get("scenarioSetHash"), a.iterations, a.confidence, a.seed).first().asDict()
    out = {"scenarios": _rows(compare.scenario_deltas(x, y).orderBy("scenario_id")), "composite": compare.composite_delta(x, y).first().asDict(), "eligibility": eligible}
    if eligible["eligible"]:
        out["interval"] = compare.paired_comparison(x, y, a.iterations, a.confidence, a.seed).first().asDict()
    _print(out)


def _diagnostics(a, spark) -> None:
    data = datasets.load_dataset(a.dataset)
    prompts = datasets.scenarios(spark, data).select("id", F.col("scenario_ord").alias("ord"), datasets.prompt(F.col("messages")).alias("prompt"))
    training = datasets.training_prompts(spark, a.training) if a.training else None
    found = audit.audit(prompts, training, near=a.near)
    options = diagnostics.Options(now=a.now, required_outcomes=a.require_outcome, required_lanes=a.require_lane, near=a.near, plugins=diagnostics.load_plugins(a.plugin) if a.plugin else [])
    docs = datasets.scenario_documents(spark, data)
    whole = diagnostics.audit_set(docs, options, training)
    rows = _rows(whole.orderBy(F.length("finding_id"), "finding_id"))
    if a.report:
        tally = lambda values: {k: sum(k in v for v in values) for k in sorted({x for v in values for x in v})}
        outcomes, lanes = tally([[o] if (o := diagnostics.outcome_type(s)) else [] for s in data["scenarios"]]), tally([diagnostics.lanes(s) for s in data["scenarios"]])
        print(diagnostics.report(data["name"], data["version"], len(data["scenarios"]), outcomes, lanes, rows, [x for x in a.require_outcome if x not in outcomes], [x for x in a.require_lane if x not in lanes]), end="")
        return
    _print({"summary": audit.summary(found).first().asDict(), "findings": _rows(found.orderBy("finding_id")), "audit": {"summary": diagnostics.summary(whole).first().asDict(), "findings": rows}})


def _validate(a, spark) -> int:
    bad = _publish_errors(a, spark)
    _print({"ok": not bad, "errors": bad})
    return int(bool(bad))


def _publish_errors(a, spark) -> list[str]:
    data = datasets.load_dataset(a.dataset) if a.dataset else None
    own = identity.scenario_set_hash(spark, data["name"], data["version"], data["scenarios"]) if data else None
    return gates.publish_errors(json.loads(Path(a.record).read_text()), data, own, a.contract_hash)


def _publish(a, spark) -> int | None:
    if bad := _publish_errors(a, spark):
        print("not published:\n" + "\n".join(f"  - {e}" for e in bad), file=sys.stderr)
        return 1
    scores, _ = _tables(spark, a.record)
    print(export.markdown(aggregate.leaderboard(scores), aggregate.axis_summary(scores)))


def _export(a, spark) -> None:
    record = datasets.read_record(a.record)
    scores, responses = datasets.record_tables(spark, record)
    if a.format == "junit":
        print("\n".join(r["suite"] for r in export.junit(scores, threshold=a.threshold).orderBy("runner_id").collect()))
    elif a.format == "annotations":
        print("\n".join(r["command"] for r in export.workflow_annotations(scores, a.threshold).orderBy("ord", "command").collect()))
    elif a.format == "metrics":
        _print(_rows(export.experiment_metrics(scores, aggregate.leaderboard(scores), aggregate.axis_summary(scores))))
    elif a.format == "spans":
        _print(_rows(export.spans(export.tasks(scores, responses), record["id"], record["createdAt"]).orderBy("span_id")))
    elif a.format == "inspect":
        data = datasets.load_dataset(a.dataset)
        table = datasets.scenarios(spark, data).select(F.col("id").alias("scenario_id"), datasets.prompt(F.col("messages")).alias("prompt"), F.lit(None).cast("string").alias("tier"), "axes")
        tiers = spark.createDataFrame([(s["id"], (s.get("meta") or {}).get("tier")) for s in data["scenarios"]], "scenario_id string, t string")
        samples = export.inspect_samples(table.join(tiers, "scenario_id", "left").withColumn("tier", F.col("t")))
        _print({"schemaVersion": "inspect-export.v1", "runId": record["id"], "dataset": record["dataset"], "samples": _rows(samples.orderBy("id")), "lossiness": export.base_lossiness(True)})
    elif a.format == "portable":
        _print(export.portable(record, _rows(export.tasks(scores, responses).orderBy("runner_id", "scenario_id")), False))
    elif a.format == "summary":
        _print(_rows(export.harness_summary(scores, a.record)))
    else:
        print("\n".join(r["line"] for r in export.result_lines(export.tasks(scores, responses), aggregate.axis_summary(scores)).orderBy("part", "line").collect()))


def _proof(a, spark) -> int:
    record, data = datasets.read_record(a.record), datasets.load_dataset(a.dataset)
    if a.action == "build":
        sinks.write_json(a.manifest, proof.build(record, data, command=sys.argv[1:]))
        return 0
    if a.action == "verify":
        bad = proof.verify(json.loads(Path(a.manifest).read_text()), record, data)
    else:
        scores, responses = datasets.record_tables(spark, record)
        bad = _rows(proof.replay_scores(responses, [s for s in data["scenarios"] if s.get("rubric", {}).get("kind") in ("programmatic", "mechanism")], scores))
    _print({"ok": not bad, "problems": bad})
    return int(bool(bad))


def _frontier(a, spark) -> int:
    result = gates.verify_quorum(json.loads(Path(a.proof).read_text()), json.loads(Path(a.contract).read_text()), a.provider)
    _print(result)
    return int(not result["ok"])


def _human(a, spark) -> int:
    rows = datasets.annotations(spark, a.annotations)
    if a.action == "pairs":
        _print(_rows(human.preference_pairs(rows).orderBy("item_id")))
        return 0
    if a.action == "adjudicate":
        if not a.decisions:
            raise SystemExit("adjudicate needs --decisions")
        _print({"annotations": _rows(human.adjudicate(rows, datasets.decisions(spark, a.decisions)).orderBy("annotation_ord"))})
        return 0
    errors, conflicts = _rows(human.validate(rows)), _rows(human.conflicts(rows))
    _print({"errors": errors, "conflicts": conflicts})
    return int(bool(errors or conflicts))


def _hash(a, spark) -> None:
    data = datasets.load_dataset(a.dataset)
    if a.schema == "v2":
        _print(identity.scenario_set_hash_v2(spark, data["name"], data["version"], data["scenarios"], [fingerprint(x) for x in a.fingerprint]))
    else:
        print(identity.scenario_set_hash(spark, data["name"], data["version"], data["scenarios"]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalweave", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(required=True)

    def add(name: str, run, *arguments: tuple) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for flags, options in arguments:
            c.add_argument(*flags.split(), **options)

    add("list", _list, ("dataset", {}))
    add("run", _run, ("dataset", {}), ("--runner", {"action": "append", "choices": ["echo", "empty"]}), ("--id", {"default": "run"}), ("--judge", {"help": "module:callable from a prompt to value, rationale and provenance"}), ("--plain-only", {"action": "store_true"}), ("--created", {"default": "1970-01-01T00:00:00Z"}), ("--out", {}))
    add("compare", _compare, ("a", {}), ("b", {}), ("--iterations", {"type": int, "default": 1000}), ("--confidence", {"type": float, "default": 0.95}), ("--seed", {"type": float, "default": 1}))
    add("diagnostics", _diagnostics, ("dataset", {}), ("--training", {}), ("--near", {"type": share, "default": 0.8}), ("--now", {"default": datetime.now(UTC).isoformat()}), ("--require-outcome", {"action": "append", "default": []}), ("--require-lane", {"action": "append", "default": []}), ("--plugin", {"action": "append", "default": []}), ("--report", {"action": "store_true"}))
    add("validate", _validate, ("record", {}), ("--dataset", {}), ("--contract-hash", {}))
    add("publish", _publish, ("record", {}), ("--dataset", {}), ("--contract-hash", {}))
    add("export", _export, ("record", {}), ("--format", {"choices": ["jsonl", "junit", "annotations", "metrics", "spans", "inspect", "portable", "summary"], "default": "jsonl"}), ("--threshold", {"type": share, "default": 1.0}), ("--dataset", {}))
    add("proof", _proof, ("action", {"choices": ["build", "verify", "replay"]}), ("record", {}), ("dataset", {}), ("--manifest", {"default": "proof.json"}))
    add("frontier", _frontier, ("proof", {}), ("contract", {}), ("--provider", {"action": "append", "default": []}))
    add("human", _human, ("action", {"choices": ["validate", "pairs", "adjudicate"]}), ("annotations", {}), ("--decisions", {}))
    add("contract", _hash, ("dataset", {}), ("--schema", {"choices": ["v1", "v2"], "default": "v1"}), ("--fingerprint", {"action": "append", "default": []}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "runner", "x") is None:
        a.runner = ["echo"]
    return a.run(a, local_session("*")) or 0


if __name__ == "__main__":
    sys.exit(main())
