"""Run ledgers: latest cells, completeness, resume checks and the record rebuilt from cells."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import identity


class LedgerMismatch(ValueError):
    """A ledger that doesn't fit the run that would resume it."""


class LedgerIncomplete(ValueError):
    """A ledger in which cells are missing or failed."""


HEADER_FIELDS = ["schemaVersion", "runId", "dataset", "scenarioSetHash", "scenarioSetHashSchemaVersion", "runnerIds", "runnerOptionsHash", "aggregate", "harnessVersion"]


def latest(cells: DataFrame) -> DataFrame:
    """The last line of each (runner_id, scenario_id)."""
    w = Window.partitionBy("runner_id", "scenario_id").orderBy(F.col("line_no").desc())
    return cells.withColumn("pos", F.row_number().over(w)).where("pos = 1").drop("pos")


def incomplete(cells: DataFrame, runners: DataFrame, scenarios: DataFrame) -> DataFrame:
    """runner_id, scenario_id, problem for every cell of runners x scenarios that is missing or failed."""
    want = runners.select("runner_id").distinct().crossJoin(scenarios.select("scenario_id").distinct())
    state = latest(cells).select("runner_id", "scenario_id", "status")
    return want.join(state, ["runner_id", "scenario_id"], "left").where("status is null or status = 'failed'").select("runner_id", "scenario_id", F.coalesce("status", F.lit("missing")).alias("problem"))


def pending(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells of wanted that no completed one covers: what a resumed run has left to do."""
    done = latest(cells).where("status = 'completed'").select("runner_id", "scenario_id")
    return wanted.join(done, ["runner_id", "scenario_id"], "left_anti")


def header(run_id: str, dataset: Mapping, scenario_set_hash: str, runner_ids: list[str], runner_options: Mapping | None = None, aggregate: Mapping | None = None, version: str = "1", hash_schema: str = "v1") -> dict:
    """A ledger's first line."""
    options = {k: v for k, v in (runner_options or {}).items() if v is not None}
    return {
        "schemaVersion": "1", "type": "header", "runId": run_id, "dataset": dict(dataset), "scenarioSetHash": scenario_set_hash, "scenarioSetHashSchemaVersion": hash_schema,
        "runnerIds": list(runner_ids), "runnerOptions": options, "runnerOptionsHash": hashlib.sha256(identity.canonical(options).encode()).hexdigest(), "aggregate": dict(aggregate or {}), "harnessVersion": version,
    }


def check_resume(have: Mapping, want: Mapping) -> None:
    """Raises for the fields in which a ledger's header differs from the run that would go on with it."""
    bad = [k for k in HEADER_FIELDS if identity.canonical(have.get(k)) != identity.canonical(want.get(k)) and k != "runId"]
    if bad:
        raise LedgerMismatch("the ledger differs in " + ", ".join(bad))


def rebuild(cells: DataFrame, runners: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Latest completed cells, once all are there; raises LedgerIncomplete with the first problems otherwise."""
    problems = incomplete(cells, runners, scenarios).orderBy("runner_id", "scenario_id").limit(20).collect()
    if problems:
        raise LedgerIncomplete("; ".join(f"{r['runner_id']}/{r['scenario_id']}: {r['problem']}" for r in problems))
    return latest(cells).where("status = 'completed'")
