"""Deterministic scorers as column expressions, and the score fan-out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scanning
from ..functions import text as tx
from . import rubrics
from .rubrics import BINGO_CAP, BINGO_MESSAGE, GATE_NAMES, GATE_WEIGHTS, PASS, SMOKE_CAP


def exact_match(output: Column, expected: str | None = "", case_insensitive: bool = True) -> Column:
    want = tx.trim(F.lit(expected if isinstance(expected, str) else ""))
    got = tx.trim(output)
    same = F.lower(got) == F.lower(want) if case_insensitive else got == want
    return same.cast("double")


def contains(output: Column, expected: list[str], smoke_test_only: bool = False) -> Column:
    """Share of terms that occur; sign-blind, so capped unless it is a smoke test."""
    if not expected:
        return F.lit(1.0) if smoke_test_only else F.lit(SMOKE_CAP)
    low = F.lower(output)
    missing = sum(((~low.contains(F.lower(F.lit(t)))).cast("int") for t in expected), F.lit(0))
    share = 1 - missing / len(expected)
    return share if smoke_test_only else F.least(F.lit(SMOKE_CAP), share)


def keyword(output: Column, expected: list[str]) -> Column:
    """Share of terms that occur where nothing negates them."""
    if not expected:
        return F.lit(1.0)
    return 1 - F.size(F.filter(scanning.hits(output, expected), lambda h: ~h)) / len(expected)


def non_empty(output: Column, min_chars: int = 1) -> Column:
    return (tx.utf16_length(tx.trim(output)) >= min_chars).cast("double")


def mechanism(output: Column, criteria: Mapping) -> Column:
    """struct value, passed, bingo_guard_tripped, rationale of a mechanism rubric.

    Gates of three groups weigh .45, .35 and .2; vocabulary alone is capped, and
    without a quantitative or disambiguating gate the value is 0. A text is
    scanned once for the matchers of all gates; a null text has no hits.
    """
    matchers = list(dict.fromkeys(x for g in GATE_WEIGHTS for gate in criteria[g] for x in gate["matchers"]))
    bingo = list(criteria["bingoTokens"])
    found = scanning.hits(output, matchers, bingo)

    def any_of(places: list[int]) -> Column:
        return F.array_contains(F.array(*[F.element_at(found, i + 1) for i in places]), True) if places else F.lit(False)

    groups = {g: [any_of([matchers.index(x) for x in gate["matchers"]]) for gate in criteria[g]] for g in GATE_WEIGHTS}
    count = {g: sum((h.cast("int") for h in hits), F.lit(0)) for g, hits in groups.items()}
    share = {g: F.lit(1.0) if not hits else count[g] / len(hits) for g, hits in groups.items()}
    grounded = (count["quantitative"] > 0) | (count["disambiguation"] > 0)
    tripped = any_of([len(matchers) + i for i in range(len(bingo))]) & ~grounded
    total = sum((share[g] * w for g, w in GATE_WEIGHTS.items()), F.lit(0.0))
    value = F.when(tripped, F.lit(BINGO_CAP)).when(~grounded, F.lit(0.0)).otherwise(total)
    missed = [F.when(~h, F.lit(f"{GATE_NAMES[g]}[{gate['label']}]")) for g, hits in groups.items() for gate, h in zip(criteria[g], hits, strict=True)]
    missed.append(F.when(tripped, F.lit(BINGO_MESSAGE)))
    missing = F.array_compact(F.array(*missed))
    head = F.format_string(
        ", ".join(f"{GATE_NAMES[g]}=%d/{len(hits)}" for g, hits in groups.items()) + ", bingo_guard=%s, score=%.2f",
        *[count[g] for g in groups], tripped.cast("string"), value,
    )
    rationale = F.concat(head, F.when(F.size(missing) > 0, F.concat(F.lit(" | missing: "), F.array_join(missing, "; "))).otherwise(F.lit("")))
    return F.struct(value.alias("value"), (value >= PASS).alias("passed"), tripped.alias("bingo_guard_tripped"), rationale.alias("rationale"))


Checker = Callable[[Column, Mapping], Column]
_checkers: dict[str, Checker] = {
    "exact-match": lambda out, p: exact_match(out, p.get("expected"), p.get("caseInsensitive") is not False),
    "contains": lambda out, p: contains(out, rubrics.terms(p), p.get("smokeTestOnly") is True),
    "keyword": lambda out, p: keyword(out, rubrics.terms(p)),
    "non-empty": lambda out, p: non_empty(out, p.get("minChars", 1)),
}


def register_checker(name: str, checker: Checker) -> None:
    """Adds a programmatic checker: (output column, params) -> value column."""
    if name in _checkers:
        raise ValueError(f"checker {name} is registered already")
    _checkers[name] = checker


def apply_rubric(output: Column, rubric: Mapping) -> Column:
    """struct value, rationale, claim_status of a programmatic or mechanism rubric."""
    if rubric["kind"] == "programmatic":
        if rubric["checker"] not in _checkers:
            raise ValueError(f"unknown checker: {rubric['checker']}")
        value = _checkers[rubric["checker"]](output, rubric.get("params") or {})
        return F.struct(value.alias("value"), F.lit(rubric["checker"]).alias("rationale"), F.lit("programmatic").alias("claim_status"))
    if rubric["kind"] == "mechanism":
        s = mechanism(output, rubric)
        return F.struct(s["value"].alias("value"), s["rationale"].alias("rationale"), F.lit("programmatic").alias("claim_status"))
    raise ValueError(f"a {rubric['kind']} rubric is scored from its judgements, not from text alone")


def score_responses(responses: DataFrame, scenarios: list[Mapping], judge: Callable[[str], Mapping] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, runner_id, scenario_id, axis_ord, axis, value, rationale, claim_status: one row for each axis of each response's scenario.

    Scenarios are plan-time documents. Their rubrics travel as data, so the plan is
    the same for any number of them: each text meets its own scenario's rubric in
    an Arrow batch. Checkers that were registered as columns are columns of the
    plan. A response without a scenario has no rows. A rubric that can't be scored
    raises: an llm-judge without judge, calibration or bias evidence; a human panel.
    """
    own = [s for s in scenarios if s["rubric"]["kind"] == "programmatic" and s["rubric"]["checker"] not in rubrics.CHECKERS and s["rubric"]["checker"] in _checkers]
    plain = {s["id"]: s["rubric"] for s in scenarios if all(s is not o for o in own)}
    for r in plain.values():
        rubrics.checked(r, judge)

    @F.pandas_udf("value double, rationale string, claim_status string")
    def score(ids: pd.Series, outputs: pd.Series) -> pd.DataFrame:
        none = (None, None, None)
        return pd.DataFrame([rubrics.score_text(t, plain[i], judge) if i in plain else none for i, t in zip(ids, outputs, strict=True)], columns=["value", "rationale", "claim_status"])

    wanted = responses.join(responses.sparkSession.createDataFrame([(s["id"], list(s["axes"])) for s in scenarios], "scenario_id string, axes array<string>"), "scenario_id")
    result = score(F.col("scenario_id"), F.col("output"))
    for s in own:
        result = F.when(F.col("scenario_id") == s["id"], apply_rubric(F.col("output"), s["rubric"])).otherwise(result)
    named = wanted.withColumn("s", result)
    return named.select(*keep, "runner_id", "scenario_id", F.posexplode("axes").alias("axis_ord", "axis"), tx.clamp(F.col("s.value")).alias("value"), "s.rationale", "s.claim_status")


def judge_prompt(template: str, response: Column, reference: Column | None = None) -> Column:
    """A judge's prompt with {response} and {reference} filled in."""
    out = F.replace(F.lit(template), F.lit("{response}"), response)
    return F.replace(out, F.lit("{reference}"), F.coalesce(reference if reference is not None else F.lit(None).cast("string"), F.lit("")))


def judge_result(answer: Column) -> Column:
    """struct score, rationale of a judge's structured answer: from the first brace to the last; null unless the score lies in [0, 1]."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "score double, value double, rationale string")
    value = F.coalesce(parsed["score"], parsed["value"])
    return F.when((value >= 0) & (value <= 1), F.struct(value.alias("score"), parsed["rationale"].alias("rationale")))


def judge_status(calibration: Column, minimum: Column, bias_checked: Column, bias_failed: Column, provenance_hash: Column, prompt_hash: Column, policy: Column) -> Column:
    """struct claim_status, error: what a judged score may be claimed as."""
    eligible = policy == "benchmark-eligible"
    error = (
        F.when(eligible & (calibration.isNull() | (calibration < minimum)), "calibration is missing or under its minimum")
        .when(eligible & ~F.coalesce(bias_checked, F.lit(False)), "bias evidence is missing")
        .when(F.coalesce(bias_failed, F.lit(False)), "a bias check failed")
        .when(eligible & (provenance_hash.isNull() | (provenance_hash != prompt_hash)), "provenance doesn't fit the prompt")
    )
    return F.struct(F.when(eligible, F.lit("benchmark-eligible")).otherwise(F.lit("analysis-only")).alias("claim_status"), error.alias("error"))


def judged(df: DataFrame, judge: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """df with the judge's answer to each prompt; the judge is any Python callable, called in Arrow batches."""

    @F.pandas_udf("string")
    def ask(prompts):
        return prompts.map(judge)

    return df.withColumn("judgement", judge_result(ask(F.col(prompt))))
