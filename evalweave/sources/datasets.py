"""Scenario data sets, run records, ledgers, annotations and release texts as DataFrames or documents."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError, record_errors


def _shape(s: Mapping) -> str:
    if s.get("environment") is not None:
        return "environment"
    if s.get("multiTurn") or "userTurns" in s:
        return "multi-turn"
    return "plain"


def scenario_errors(s: object) -> list[str]:
    """What is wrong with a scenario document."""
    if not isinstance(s, Mapping):
        return ["a scenario must be an object"]
    bad = []
    if not isinstance(s.get("id"), str) or not s["id"].strip():
        bad.append("id is missing")
    at = s.get("id") or "?"
    shape = _shape(s)
    if isinstance(s.get("meta"), Mapping) and s["meta"].get("multiTurn"):
        bad.append(f"{at}: meta.multiTurn is no longer read; use multiTurn")
    if shape == "multi-turn":
        if not s.get("userTurns") or not all(isinstance(t, str) and t for t in s["userTurns"]):
            bad.append(f"{at}: userTurns must be texts")
        if not s.get("persistenceCriteria"):
            bad.append(f"{at}: persistenceCriteria are missing")
        return bad
    if not s.get("axes") or not all(isinstance(a, str) for a in s["axes"]):
        bad.append(f"{at}: axes must be texts")
    messages = (s.get("input") or {}).get("messages") if isinstance(s.get("input"), Mapping) else None
    if not messages or not all(isinstance(m, Mapping) and m.get("role") in ("system", "user", "assistant") and isinstance(m.get("content"), str) for m in messages):
        bad.append(f"{at}: input.messages must be messages")
    if shape == "plain" and not isinstance(s.get("rubric"), Mapping):
        bad.append(f"{at}: rubric is missing")
    return bad


def load_dataset(source: str) -> dict:
    """name, version, scenarios of a bundle file (as authored), or of a directory of files (by id)."""
    path = Path(source)
    if path.is_dir():
        manifest = json.loads((path / "dataset.json").read_text()) if (path / "dataset.json").exists() else {}
        where = path / "scenarios" if (path / "scenarios").is_dir() else path
        found = [json.loads(p.read_text()) for p in sorted(where.glob("*.json")) if p.name != "dataset.json"]
        data = {"name": path.resolve().name, "version": "0.0.0"} | manifest | {"scenarios": sorted(found, key=lambda s: str(s.get("id")))}
    else:
        data = json.loads(path.read_text())
        if missing := [k for k in ("name", "version", "scenarios") if k not in data]:
            raise GateError([f"{k} is missing" for k in missing])
    bad = [e for s in data["scenarios"] for e in scenario_errors(s)]
    if bad:
        raise GateError(bad)
    return data


MESSAGES = "array<struct<role string, content string>>"


def scenarios(spark: SparkSession, data: Mapping) -> DataFrame:
    """scenario_ord, id, shape, axes, messages, meta, rubric, raw of a loaded data set; raw is the document as authored."""
    rows = [
        (i, s["id"], _shape(s), s.get("axes") or [], [(m["role"], m["content"]) for m in (s.get("input") or {}).get("messages", [])], json.dumps(s["meta"]) if "meta" in s else None, json.dumps(s["rubric"]) if "rubric" in s else None, json.dumps(s, ensure_ascii=False))
        for i, s in enumerate(data["scenarios"])
    ]
    return spark.createDataFrame(rows, f"scenario_ord long, id string, shape string, axes array<string>, messages {MESSAGES}, meta string, rubric string, raw string")


def scenario_files(spark: SparkSession, directory: str) -> DataFrame:
    """The same from a directory too large for one machine: one JSON file a scenario."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("file")).where("file <> 'dataset.json'")
    s = F.from_json("value", f"id string, axes array<string>, input struct<messages {MESSAGES}>")
    doc = lambda k: F.get_json_object("value", f"$.{k}")
    shape = F.when(doc("environment").isNotNull(), "environment").when(doc("userTurns").isNotNull(), "multi-turn").otherwise("plain")
    return raw.select(s["id"].alias("id"), shape.alias("shape"), s["axes"].alias("axes"), s["input"]["messages"].alias("messages"), doc("meta").alias("meta"), doc("rubric").alias("rubric"), F.col("value").alias("raw"))


def prompt(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def read_record(path: str) -> dict:
    """A run record, refused with every error if it isn't valid."""
    record = json.loads(Path(path).read_text())
    if bad := record_errors(record):
        raise GateError(bad)
    return record


def record_tables(spark: SparkSession, record: Mapping) -> tuple[DataFrame, DataFrame]:
    """scores and responses of a run record."""
    scores = [(s["runnerId"], s["scenarioId"], s["axis"], float(s["value"]), s.get("claimStatus"), i, {k: [str(x) for x in (v if isinstance(v, list) else [v]) if isinstance(x, (str, int, float, bool))] for k, v in ((s.get("meta") or {}).get("slices") or {}).items()}) for i, s in enumerate(record["scores"])]
    responses = [(r["runnerId"], r["scenarioId"], r["output"], float(r["meta"]["latencyMs"]), r["meta"]["accessedAt"], r["meta"]["provider"], r["meta"]["model"], i) for i, r in enumerate(record["responses"])]
    return (
        spark.createDataFrame(scores, "runner_id string, scenario_id string, axis string, value double, claim_status string, score_ord long, slices map<string,array<string>>"),
        spark.createDataFrame(responses, "runner_id string, scenario_id string, output string, latency_ms double, accessed_at string, provider string, model string, response_ord long"),
    )


CELL = "type string, runId string, scenarioId string, runnerId string, status string, startedAt string, completedAt string, error string, outcome struct<latencyMs double, responses array<struct<output string>>, scores array<struct<axis string, value double>>>"


def read_ledger(spark: SparkSession, path: str) -> tuple[dict | None, DataFrame]:
    """Header (None without a file) and cells (line_no, runner_id, scenario_id, status, outcome, error) of a ledger; blank lines don't count."""
    if not Path(path).exists():
        return None, spark.createDataFrame([], "line_no long, runner_id string, scenario_id string, status string, error string")
    with open(path) as f:
        head = json.loads(f.readline())
    if head.get("type") != "header":
        raise GateError(["the first line is no header"])
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line_no > 0 and trim(line) <> ''")
    c = F.from_json("line", CELL)
    cells = lines.select(F.col("line_no").cast("long"), c.alias("c")).select("line_no", F.col("c.runnerId").alias("runner_id"), F.col("c.scenarioId").alias("scenario_id"), F.col("c.status").alias("status"), F.col("c.outcome").alias("outcome"), F.col("c.error").alias("error"), F.col("c.runId").alias("run_id"))
    other = cells.where(F.col("run_id") != head["runId"]).limit(1).collect()
    if other:
        raise GateError([f"line {other[0]['line_no'] + 1} belongs to run {other[0]['run_id']}"])
    return head, cells.drop("run_id")


def read_list(path: str, wrapper: str) -> list[dict]:
    """A JSON array, alone or under a key."""
    x = json.loads(Path(path).read_text())
    x = x.get(wrapper) if isinstance(x, Mapping) else x
    if not isinstance(x, list):
        raise GateError([f"an array, or an object with {wrapper}, is needed"])
    return x


def annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = [tuple(a.get(k) for k in ("itemId", "responseId", "label")) + (float(a["score"]) if a.get("score") is not None else None,) + tuple(a.get(k) for k in ("reviewer", "scenarioHash", "rubricVersion", "annotatedAt", "status", "adjudicatedAt")) + (i,) for i, a in enumerate(read_list(path, "annotations"))]
    return spark.createDataFrame(rows, "item_id string, response_id string, label string, score double, reviewer string, scenario_hash string, rubric_version string, annotated_at string, status string, adjudicated_at string, annotation_ord long")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Adjudications: a JSON array, alone or under ``decisions``; each needs itemId, responseId, label and adjudicator."""
    found = read_list(path, "decisions")
    if bad := [f"decisions[{i}].{k} is missing" for i, d in enumerate(found) for k in ("itemId", "responseId", "label", "adjudicator") if not d.get(k)]:
        raise GateError(bad)
    rows = [(d["itemId"], d["responseId"], d["label"], float(d["score"]) if d.get("score") is not None else None, d["adjudicator"], d.get("scenarioHash"), d.get("rubricVersion"), d.get("adjudicatedAt"), i + 1) for i, d in enumerate(found)]
    return spark.createDataFrame(rows, "item_id string, response_id string, label string, score double, adjudicator string, scenario_hash string, rubric_version string, adjudicated_at string, decision_ord long")


def scenario_documents(spark: SparkSession, data: Mapping) -> DataFrame:
    """ord, id, doc (JSON) of a data set's scenarios."""
    return spark.createDataFrame([(i, s["id"], json.dumps(s)) for i, s in enumerate(data["scenarios"])], "ord long, id string, doc string")


def training_prompts(spark: SparkSession, path: str) -> DataFrame:
    """id, ord, prompt from a JSON array, {prompts: [...]}, or a text of one prompt a line."""
    text = Path(path).read_text()
    try:
        x = json.loads(text)
        x = x.get("prompts", []) if isinstance(x, Mapping) else x
        found = [p if isinstance(p, str) else p.get("prompt", p.get("text", "")) for p in x]
    except ValueError:
        found = [line for line in text.splitlines() if line.strip()]
    return spark.createDataFrame([(i, i, p) for i, p in enumerate(found)], "id long, ord long, prompt string")


def release_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """document_id, text of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), F.col("value").alias("text"))
