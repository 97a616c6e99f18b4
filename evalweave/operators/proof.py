"""Proof manifests: digests over a run's artifacts, their verification, and the replay of its scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, identity, scoring
from .gates import record_errors

TOLERANCE = 1e-9


def build(record: Mapping, dataset: Mapping, contract: Mapping | None = None, command: list[str] | None = None) -> dict:
    """A manifest of a run: digests of its parts, the scenario set's hash and the claim gate; the record is redacted first."""
    redacted, paths = identity.without_secrets(dict(record))
    parts = {"record": redacted, "dataset": dataset, "scores": record.get("scores", []), "responses": record.get("responses", [])}
    if contract is not None:
        parts["contract"] = contract
    body = {
        "schemaVersion": "1", "runId": record.get("id"), "scenarioSetHash": record.get("scenarioSetHash"), "checksums": {k: identity.digest(v) for k, v in sorted(parts.items())},
        "redactedPaths": paths, "claimGate": (contract or {}).get("claimGate"), "command": identity.without_secrets(list(command or []))[0],
        "selfTest": {"recordValid": not record_errors(record), "hashConsistent": contract is None or contract.get("scenarioSetHash") == record.get("scenarioSetHash"), "hasScores": bool(record.get("scores")), "hasResponses": bool(record.get("responses"))},
    }
    return body | {"manifestChecksum": identity.digest(body)}


def verify(manifest: Mapping, record: Mapping, dataset: Mapping, contract: Mapping | None = None) -> list[str]:
    """What doesn't fit between a manifest and the artifacts."""
    bad = []
    body = {k: v for k, v in manifest.items() if k != "manifestChecksum"}
    if identity.digest(body) != manifest.get("manifestChecksum"):
        bad.append("the manifest's own checksum differs")
    now = build(record, dataset, contract)
    for k in sorted({*manifest.get("checksums", {}), *now["checksums"]}):
        if manifest.get("checksums", {}).get(k) != now["checksums"].get(k):
            bad.append(f"{k}: checksum differs")
    bad += [f"self-test: {k}" for k, ok in now["selfTest"].items() if not ok]
    return bad


def replay_scores(responses: DataFrame, scenarios: list[Mapping], recorded: DataFrame) -> DataFrame:
    """problem, runner_id, scenario_id, axis, recorded, replayed: scores that a second scoring of the outputs doesn't give again.

    A response without its scenario is a row of its own.
    """
    known = [s["id"] for s in scenarios]
    lost = responses.where(~F.col("scenario_id").isin(known)).select(F.lit("unknown scenario").alias("problem"), "runner_id", "scenario_id", F.lit(None).cast("string").alias("axis"), F.lit(None).cast("double").alias("recorded"), F.lit(None).cast("double").alias("replayed"))
    again = scoring.score_responses(responses, scenarios).groupBy("runner_id", "scenario_id", "axis").agg(F.avg("value").alias("replayed"))
    had = recorded.groupBy("runner_id", "scenario_id", "axis").agg(F.avg("value").alias("recorded"))
    both = had.join(again, ["runner_id", "scenario_id", "axis"], "full_outer")
    differ = both.where(F.col("recorded").isNull() | F.col("replayed").isNull() | (F.abs(F.col("recorded") - F.col("replayed")) > TOLERANCE))
    return differ.select(F.lit("score differs").alias("problem"), "runner_id", "scenario_id", "axis", "recorded", "replayed").unionByName(lost)


def replay_board(responses: DataFrame, scenarios: list[Mapping], weights: Mapping[str, float] | None = None) -> DataFrame:
    """The leaderboard from the outputs alone."""
    scores = scoring.score_responses(responses, scenarios).withColumn("score_ord", F.struct("scenario_id", "axis_ord"))
    return aggregate.leaderboard(scores, weights)
