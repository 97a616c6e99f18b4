"""Validators and publication gates. Every gate names all that is wrong, not just the first."""

from __future__ import annotations

import math
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ["tp", "tn", "fp-guard", "fn-guard"]
FLOOR = 0.05
QUORUM_MINIMUM = 2


class GateError(ValueError):
    """A gate that isn't passed; errors has every reason."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class ClaimNotEligible(GateError):
    """A run that can't carry a claim."""


class HashMismatch(GateError):
    """Two runs over different scenario sets."""


class QuorumNotMet(GateError):
    """A proof that too few providers bear out."""


def stratification(outcomes: DataFrame) -> DataFrame:
    """outcome_type, n, share, ok for the four types; a type needs a share of FLOOR. Other types count in the whole."""
    counts = outcomes.groupBy("outcome_type").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    kinds = outcomes.sparkSession.createDataFrame([(k,) for k in TYPES], "outcome_type string")
    share = F.coalesce(F.try_divide(F.col("n"), F.col("whole")), F.lit(0.0))
    return kinds.join(counts, "outcome_type", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(whole)).select("outcome_type", "n", share.alias("share"), (share >= FLOOR).alias("ok"))


def assert_stratified(outcomes: DataFrame) -> None:
    bad = [f"{r['outcome_type']} has a share of {r['share']:.3f}" for r in stratification(outcomes).where("not ok").orderBy("outcome_type").collect()]
    if bad:
        raise GateError(bad)


def identity_collisions(contracts: DataFrame) -> DataFrame:
    """version, n of corpus versions that name more than one (scenario_count, hash)."""
    return contracts.groupBy("version").agg(F.count_distinct(F.struct("scenario_count", "hash")).alias("n")).where("n > 1")


def score_errors(scores: DataFrame) -> DataFrame:
    """score_ord, field, error: a row for each thing wrong with a score."""
    text = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.struct(F.lit(c).alias("field"), F.lit("is empty").alias("error")))
    value = F.when(F.col("value").isNull() | F.isnan("value") | ~F.col("value").between(0, 1), F.struct(F.lit("value").alias("field"), F.lit("lies outside 0..1").alias("error")))
    return scores.select("score_ord", F.explode(F.array_compact(F.array(text("runner_id"), text("scenario_id"), text("axis"), value))).alias("e")).select("score_ord", "e.field", "e.error")


def record_errors(record: Mapping) -> list[str]:
    """Everything that is wrong with a run record, with paths."""
    bad: list[str] = []

    def need(x: Mapping, at: str, key: str, kind: type | tuple) -> object:
        v = x.get(key) if isinstance(x, Mapping) else None
        if not isinstance(v, kind) or isinstance(v, bool) or (isinstance(v, str) and not v.strip()) or (isinstance(v, float) and not math.isfinite(v)):
            bad.append(f"{at}{key}: {getattr(kind, '__name__', 'number')} needed")
            return None
        return v

    need(record, "", "id", str)
    need(record, "", "createdAt", str)
    dataset = need(record, "", "dataset", dict)
    if dataset is not None:
        need(dataset, "dataset.", "name", str)
        need(dataset, "dataset.", "version", str)
    for i, r in enumerate(need(record, "", "responses", list) or []):
        for k in ("runnerId", "scenarioId"):
            need(r, f"responses[{i}].", k, str)
        meta = need(r, f"responses[{i}].", "meta", dict)
        if meta is not None:
            for k in ("provider", "model", "accessedAt"):
                need(meta, f"responses[{i}].meta.", k, str)
            need(meta, f"responses[{i}].meta.", "latencyMs", (int, float))
    for i, s in enumerate(need(record, "", "scores", list) or []):
        for k in ("runnerId", "scenarioId", "axis"):
            need(s, f"scores[{i}].", k, str)
        v = need(s, f"scores[{i}].", "value", (int, float))
        if v is not None and not 0 <= v <= 1:
            bad.append(f"scores[{i}].value: outside 0..1")
    for i, a in enumerate(need(record, "", "aggregates", list) or []):
        need(a, f"aggregates[{i}].", "runnerId", str)
        need(a, f"aggregates[{i}].", "composite", (int, float))
        for axis, m in (need(a, f"aggregates[{i}].", "axes", dict) or {}).items():
            for k in ("mean", "variance", "n"):
                need(m, f"aggregates[{i}].axes.{axis}.", k, (int, float))
    return bad


def publish_errors(record: Mapping, dataset: Mapping | None = None, dataset_hash: str | None = None, contract_hash: str | None = None) -> list[str]:
    """Why a record may not be published: its own errors; a data set or contract that it doesn't belong to.

    dataset: name, version, scenarios; dataset_hash: the data set's own v1 hash.
    A v2 record is held against its metadata, as its hash covers more than the data set.
    """
    bad = record_errors(record)
    own, known = record.get("scenarioSetHash"), record.get("scenarioSetHashSchemaVersion")
    if known not in (None, "v1", "v2"):
        bad.append(f"scenarioSetHashSchemaVersion: unknown version {known}")
    if dataset is not None:
        said = record.get("dataset") or {}
        bad += [f"dataset.{k}: {said.get(k)!r} isn't the data set's {dataset[k]!r}" for k in ("name", "version") if said.get(k) != dataset[k]]
        if known == "v2":
            bad += hash_metadata_errors(record.get("scenarioSetHashMetadata"), dataset)
        else:
            if contract_hash and dataset_hash != contract_hash:
                bad.append(f"the data set's hash {dataset_hash!r} isn't the contract's {contract_hash!r}")
            bad += _hash_errors(own, contract_hash or dataset_hash, "the data set's hash")
    if contract_hash and (dataset is None or known == "v2"):
        bad += _hash_errors(own, contract_hash, "the contract's hash")
    return bad


def _hash_errors(own: object, expected: str | None, what: str) -> list[str]:
    if not own:
        return [f"scenarioSetHash: needed; {what} is {expected!r}"]
    return [] if own == expected else [f"scenarioSetHash: {own!r} isn't {what} {expected!r}"]


def hash_metadata_errors(metadata: object, dataset: Mapping) -> list[str]:
    """Why the metadata of a v2 hash don't fit a data set."""
    if not isinstance(metadata, Mapping) or metadata.get("hashSchemaVersion") != "v2":
        return ["scenarioSetHashMetadata: v2 metadata needed"]
    said = metadata.get("dataset") or {}
    bad = [f"scenarioSetHashMetadata.dataset.{k}: {said.get(k)!r} isn't the data set's {dataset[k]!r}" for k in ("name", "version") if said.get(k) != dataset[k]]
    if metadata.get("scenarioCount") != len(dataset["scenarios"]):
        bad.append(f"scenarioSetHashMetadata.scenarioCount: {metadata.get('scenarioCount')} isn't {len(dataset['scenarios'])}")
    return bad


def claim_card_errors(card: object, now: str) -> list[str]:
    """What is wrong with a claim card."""
    from .diagnostics import moment

    if not isinstance(card, Mapping):
        return ["a claim card must be an object"]
    bad: list[str] = []

    def text(x: Mapping, at: str, key: str) -> None:
        if not isinstance(x.get(key), str) or not x[key].strip():
            bad.append(f"{at}{key}: text needed")

    for key in ("schemaVersion", "scenarioSetHash"):
        text(card, "", key)
    if isinstance(card.get("dataset"), Mapping):
        for key in ("name", "version"):
            text(card["dataset"], "dataset.", key)
    else:
        bad.append("dataset: object needed")
    if card.get("hashSchemaVersion") not in ("v1", "v2"):
        bad.append("hashSchemaVersion: v1 or v2 needed")
    if card.get("status") not in ("allowed", "blocked"):
        bad.append("status: allowed or blocked needed")
    if not isinstance(card.get("leaderboardClaimsAllowed"), bool):
        bad.append("leaderboardClaimsAllowed: true or false needed")
    for key in ("generatedAt", "expiresAt"):
        if card.get(key) is not None and moment(card[key]) is None:
            bad.append(f"{key}: a date needed")
    if card.get("expiresAt") is not None and (ends := moment(card["expiresAt"])) is not None and ends <= moment(now):
        bad.append("expiresAt: the card has expired")
    for key in ("allowedClaimText", "blocker"):
        if card.get(key) is not None and not isinstance(card[key], str):
            bad.append(f"{key}: text needed")
    for key in ("implementationFingerprints", "scorerFingerprints"):
        if card.get(key) is None:
            continue
        if not isinstance(card[key], list):
            bad.append(f"{key}: a list needed")
            continue
        for i, f in enumerate(card[key]):
            if not isinstance(f, Mapping) or not isinstance(f.get("id"), str) or not f["id"].strip():
                bad.append(f"{key}[{i}].id: text needed")
    for i, cell in enumerate(card.get("providerCells") or []):
        if not isinstance(cell, Mapping) or not isinstance(cell.get("provider"), str):
            bad.append(f"providerCells[{i}].provider: text needed")
    quorum = card.get("quorum")
    if quorum is not None and (not isinstance(quorum, Mapping) or not all(isinstance(quorum.get(k), int) for k in ("required", "observed") if k in quorum)):
        bad.append("quorum: numbers needed")
    return bad


def unexpected_keys(x: Mapping, allowed: Mapping, at: str = "$") -> list[str]:
    """Paths of keys that a strict contract doesn't know; allowed nests as the document does, None for anything."""
    out = []
    for k, v in x.items():
        if k not in allowed:
            out.append(f"{at}.{k}")
        elif isinstance(allowed[k], Mapping):
            for i, item in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(item, Mapping):
                    out += unexpected_keys(item, allowed[k], f"{at}.{k}" + (f"[{i}]" if isinstance(v, list) else ""))
    return out


def _time(x: object) -> datetime | None:
    try:
        t = datetime.fromisoformat(str(x).replace("Z", "+00:00"))
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def expired(x: object, now: datetime, unparsable: bool) -> bool:
    """Whether a time has come; what can't be read counts as the caller says."""
    t = _time(x)
    return unparsable if t is None else t <= now


def verify_quorum(proof: Mapping, contract: Mapping, providers: list[str], now: datetime | None = None, max_age_days: float | None = None) -> dict:
    """ok, errors, warnings, verified: whether enough providers bear out the contract's scenario set.

    Problems of single providers are warnings once the quorum is met without them.
    """
    now = now or datetime.now(UTC)
    errors, single, verified = [], [], []
    want = contract.get("scenarioSetHash")
    if proof.get("scenarioSetHash") != want:
        errors.append("hash-mismatch")
    if proof.get("hashSchemaVersion") not in ("v1", "v2"):
        errors.append("hash-schema-unknown")
    if "expiresAt" in proof and expired(proof["expiresAt"], now, True):
        errors.append("proof-expired")
    made = _time(proof.get("generatedAt"))
    if max_age_days is not None and (made is None or (now - made).total_seconds() > max_age_days * 86400):
        errors.append("proof-too-old")
    gate = (contract.get("claimGate") or {}).get("status")
    if gate != "allowed":
        errors.append("claim-gate-" + (gate or "missing"))
    quorum = proof.get("quorum") or {}
    required = quorum.get("required", QUORUM_MINIMUM)
    if required < QUORUM_MINIMUM:
        errors.append("quorum-below-minimum")
    cells: dict[str, list[Mapping]] = {}
    for c in proof.get("providerCells") or []:
        cells.setdefault(c.get("provider"), []).append(c)
    for p in dict.fromkeys(x.strip() for x in providers if x.strip()):
        mine = cells.get(p, [])
        fit = [c for c in mine if c.get("scenarioSetHash") == want]
        live = [c for c in fit if c.get("status") == "verified" and not ("expiresAt" in c and expired(c["expiresAt"], now, True))]
        if live:
            verified.append(p)
        else:
            single.append(f"{p}: " + ("no cell" if not mine else "cell of another hash" if not fit else "cell not verified or expired"))
    if len(verified) < max(required, QUORUM_MINIMUM):
        errors.append(f"quorum-not-met: {len(verified)} of {max(required, QUORUM_MINIMUM)}")
        errors += single
        single = []
    return {"ok": not errors, "errors": errors, "warnings": single, "verified": verified}


def assert_quorum(*args, **kwargs) -> dict:
    result = verify_quorum(*args, **kwargs)
    if not result["ok"]:
        raise QuorumNotMet(result["errors"])
    return result


def quorum_table(providers: DataFrame, cells: DataFrame, scenario_set_hash: str, now: str) -> DataFrame:
    """provider, state over many proofs' cells (provider, scenario_set_hash, status, expires_at)."""
    ok_hash = F.col("scenario_set_hash") == scenario_set_hash
    live = ok_hash & (F.col("status") == "verified") & (F.col("expires_at").isNull() | F.coalesce(F.try_to_timestamp("expires_at") > F.to_timestamp(F.lit(now)), F.lit(False)))
    by = cells.groupBy("provider").agg(F.bool_or(ok_hash).alias("hash_ok"), F.bool_or(live).alias("live"))
    state = F.when(F.col("hash_ok").isNull(), "no-cell").when(~F.col("hash_ok"), "wrong-hash").when(~F.col("live"), "not-verified").otherwise("verified")
    return providers.join(by, "provider", "left").select("provider", state.alias("state"))


def claim_errors(record: Mapping, scores: DataFrame, outcomes: DataFrame, blocking_kinds: list[str], card: Mapping | None, now: datetime | None = None) -> list[str]:
    """Why a run can't carry a benchmark claim; empty when it can."""
    now = now or datetime.now(UTC)
    bad = []
    for a in record.get("aggregates", []):
        bad += [f"{a['runnerId']}/{axis}: no confidence interval" for axis, m in a.get("axes", {}).items() if not m.get("confidenceInterval")]
    if not record.get("scenarioSetHash"):
        bad.append("the scenario set has no hash")
    for r in scores.where("claim_status = 'analysis-only'").select("runner_id").distinct().orderBy("runner_id").collect():
        bad.append(f"{r['runner_id']}: scores are for analysis only")
    bad += [f"audit: {k}" for k in blocking_kinds]
    bad += [f"{r['outcome_type']}: share {r['share']:.3f} is under the floor" for r in stratification(outcomes).where("not ok").orderBy("outcome_type").collect()]
    if card is None:
        bad.append("there is no claim card")
    else:
        if card.get("scenarioSetHash") != record.get("scenarioSetHash"):
            bad.append("the claim card is for another scenario set")
        good = {c["provider"] for c in card.get("providerCells", []) if c.get("status") == "verified" and not ("expiresAt" in c and expired(c["expiresAt"], now, False))}
        asked = set(card.get("quorum", {}).get("providers", [])) or good
        if len(good & asked) < max(card.get("quorum", {}).get("required", QUORUM_MINIMUM), QUORUM_MINIMUM):
            bad.append("the claim card's quorum isn't met")
    return bad


def assert_claim(*args, **kwargs) -> None:
    if bad := claim_errors(*args, **kwargs):
        raise ClaimNotEligible(bad)


def assert_same_set(a: str | None, b: str | None) -> None:
    if not a or not b or a != b:
        raise HashMismatch([f"scenario sets {a} and {b} differ"])
