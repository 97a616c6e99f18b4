"""Hand cases of matching, text, number and interval functions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from evalweave.functions import matching as m
from evalweave.functions import scanning
from evalweave.functions import text as tx
from evalweave.operators import bootstrap, compare, environment, gates, identity, rubrics, scoring
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

MATCHES = [
    ("this is NOT invalid traffic, do NOT flag", "flag", False), ("café here", "caf", True), ("I cannot approve", "approve", True), ("do not 😀 flag", "flag", True), ("don't flag", "flag", False),
    ("don’t flag", "flag", True), ("not only flag", "flag", True), ("never — flag", "flag", True), ("no evidence of any real flag", "flag", False), ("no a b c d e flag", "flag", True),
    ("do not wait but flag", "flag", True), ("", "flag", False), ("anything", "", True), ("ÉTAT", "état", True), ("w" * 10 + "cannot " + "a" * 43 + " flag it", "flag", False),
    ("w" * 10 + "cannot " + "a" * 42 + " flag it", "flag", True), ("keeper", "keep", False), ("rather than flag", "flag", False), ("flag. do not flag", "flag", True), (None, "flag", False), ("Flag 24 single  24", "/single\\s+24/", True),
]


def test_unnegated(spark):
    for text, phrase, want in MATCHES:
        got = spark.createDataFrame([(text,)], "t string").select(m.unnegated(F.col("t"), phrase)).first()[0]
        assert got is want, (text, phrase)


def test_both_matchers_agree(spark):
    """The Arrow scan and the JVM expression, on the same texts."""
    phrases = ["flag", "a_b", "single 24", "/single\\s+\\d+/", "/^no\\b/", "/[\\w.]+$/", "é", "instead of", "-", "Single", "\n"]
    parts = ["flag", "Flag", "keeper", "not", "do", "don't", "never", "no", "only", "but", ".", "instead of", "rather than", "é", "24", "single", "—", "\n", "a_b", "evidence", "ſingle", "İ", "É"]
    rng = np.random.default_rng(5)
    texts = [rng.choice([" ", "  ", "\t", "-"]).join(rng.choice(parts, rng.integers(0, 15))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", *[m.unnegated(F.col("t"), p) for p in phrases], *[m.present(F.col("t"), p) for p in phrases]).collect():
        # What a case-blind class holds beyond ASCII differs between the engines, for letters that no phrase has.
        some = [i for i, p in enumerate(phrases) if p[0] != "/" or not set("ſİ") & set(r[0])]
        got = [scanning.unnegated(r[0], p) for p in phrases] + [scanning.present(r[0], p) for p in phrases]
        assert all(got[i + k] == r[1 + i + k] for i in some for k in (0, len(phrases))), r[0]


def test_scanning_cases(spark):
    for text, phrase, want in MATCHES:
        got = spark.createDataFrame([(text,)], "t string").select(scanning.hits(F.col("t"), [phrase])).first()[0]
        assert got == [want], (text, phrase)


def test_rubrics():
    """Lists of terms only, rationales, and what can't be scored."""
    rubric = {"kind": "programmatic", "checker": "contains", "params": {"expected": "the"}}
    assert rubrics.score_text("nothing here", rubric) == (0.2, "all terms present [contains capped at 0.2; use keyword/mechanism for benchmark scoring]", "programmatic")
    assert rubrics.score_text("x", rubric | {"checker": "keyword"})[:2] == (1.0, "no terms required")
    assert rubrics.score_text("do not flag. it", rubric | {"checker": "keyword", "params": {"expected": ["flag", "it"]}})[:2] == (0.5, "missing or negated: flag")
    assert rubrics.score_text(" A ", rubric | {"checker": "exact-match", "params": {"expected": "a"}})[:2] == (1.0, "exact-match")
    assert rubrics.score_text("😀", rubric | {"checker": "non-empty", "params": {"minChars": 3}})[:2] == (0.0, "length=2, min=3")
    assert rubrics.score_text(None, rubric | {"checker": "non-empty", "params": {}})[0] == 0.0
    for bad in ({"kind": "human"}, {"kind": "llm-judge"}, {"kind": "programmatic", "checker": "none"}):
        with pytest.raises(ValueError):
            rubrics.checked(bad)


def test_judged_rubrics(spark):
    provenance = {"promptHash": "h", "provider": "p", "model": "m", "rubricVersion": "1", "parserVersion": "1", "judgedAt": "2026-01-02T03:04:05Z"}
    rubric = {"kind": "llm-judge", "judge": "j", "prompt": "{response} against {reference}", "reference": "ref", "claimPolicy": "benchmark-eligible",
              "calibration": {"observedAgreement": 0.9, "minimumAgreement": 0.8, "promptHash": "h"}, "biasChecks": [{"kind": "order", "passed": True}]}
    scenario = {"id": "s", "axes": ["x", "y"], "rubric": rubric}
    responses = spark.createDataFrame([("r", "s", "hello"), ("r", "other", "hello"), ("r", "s", None)], "runner_id string, scenario_id string, output string")
    judge = lambda prompt: {"value": 2.0 if prompt.startswith("hello") else 0.25, "rationale": prompt, "provenance": provenance}
    rows = scoring.score_responses(responses, [scenario], judge).collect()
    assert sorted((r["axis"], r["value"], r["rationale"], r["claim_status"]) for r in rows) == sorted((a, v, w, "benchmark-eligible") for a in "xy" for v, w in ((1.0, "hello against ref"), (0.25, " against ref")))
    for change in ({"calibration": None}, {"calibration": rubric["calibration"] | {"observedAgreement": 0.5}}, {"biasChecks": []}, {"biasChecks": [{"kind": "order", "passed": False}]}):
        with pytest.raises(rubrics.JudgeRefused):
            scoring.score_responses(responses, [scenario | {"rubric": rubric | change}], judge)
    for change in ({"promptHash": "other"}, {"model": ""}, {"judgedAt": "yesterday"}):
        with pytest.raises(rubrics.JudgeRefused):
            rubrics.judged("x", rubric, lambda _, c=change: {"value": 1, "provenance": provenance | c})
    with pytest.raises(ValueError, match="judge"):
        scoring.score_responses(responses, [scenario])


def test_unsupported_flags():
    with pytest.raises(ValueError, match="flags"):
        m.pattern("/a/y")


def _one(spark, column, *values, schema="x string"):
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_text(spark):
    x = F.col("x")
    assert _one(spark, tx.normalise(x), "  A b\n C﻿") == "a b c"
    assert _one(spark, tx.tokens(x), "(Hello), wörld! -- 42.") == ["hello", "wörld", "42"]
    assert _one(spark, tx.ngrams(tx.tokens(x), 3), "a b") == ["a", "b"]
    assert _one(spark, tx.ngrams(tx.tokens(x), 3), "a b c d") == ["a b c", "b c d"]
    assert _one(spark, tx.utf16_length(x), "a😀") == 3
    assert _one(spark, tx.redact(x), "Bearer abc.def and sk-12 xoxb-1-2") == "[REDACTED] and [REDACTED] [REDACTED]"
    assert _one(spark, tx.redact_command(x), 'run --api-key "a b" --token=x --secret --y') == "run --api-key [REDACTED] --token=[REDACTED] --secret --y"
    assert _one(spark, tx.redact_argv(F.split(x, " ")), "run --token abc --password=x sk-1 --secret --y") == "run --token [REDACTED] --password=[REDACTED] [REDACTED] --secret --y"
    assert _one(spark, tx.xml(x), "<a b=\"c\">&") == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert _one(spark, tx.workflow_property(x), "a:b,c%\n") == "a%3Ab%2Cc%25%0A"
    facts = _one(spark, tx.doc_facts(x), "We ship 1,344 public scenarios; quorum 2/3; claims are blocked. sha256:abcdef012345")
    assert facts.scenario_counts == [1344] and facts.quorums == ["2/3"] and facts.claim_states == ["blocked"] and facts.hashes == ["abcdef012345"]


def test_clamps(spark):
    x = F.col("x")
    for v, want in ((2.0, 1.0), (-1.0, 0.0), (0.25, 0.25), (None, None)):
        assert _one(spark, tx.clamp(x), v, schema="x double") == want
    assert _one(spark, tx.clamp_finite(x), float("nan"), schema="x double") == 0.0
    assert _one(spark, tx.clamp_finite(x), None, schema="x double") == 0.0


@pytest.mark.parametrize(
    ("values", "seed", "iterations", "want"), [([1, 0, 1, 1], 11, 250, (0.25, 1.0)), ([0.8, 0.6, 0.9], 7, 500, (0.6, 0.9))]
)
def test_intervals(values, seed, iterations, want):
    low, high = bootstrap.interval(np.array(values, dtype=float), iterations, 0.95, seed)
    assert low == pytest.approx(want[0], abs=1e-12) and high == pytest.approx(want[1], abs=1e-12)


def test_interval_against_the_loop():
    rng = np.random.default_rng(0)
    for n, iterations, seed in ((257, 40, -5), (13, 100, 123456789)):
        values = rng.random(n)
        state, means = seed & 0xFFFFFFFF, []
        for _ in range(iterations):
            total = 0.0
            for _ in range(n):
                state = (1664525 * state + 1013904223) % 2**32
                total += values[math.floor(state / 2**32 * n)]
            means.append(total / n)
        assert bootstrap.sample_means(values, iterations, seed).tolist() == means


def test_bootstrap_options():
    assert bootstrap.check_options(0, 1.0, float("nan")) and not bootstrap.check_options(10, 0.9, 1)


def test_direction(spark):
    df = spark.createDataFrame([(0.001,), (0.0011,), (-0.002,), (None,)], "d double")
    assert [r[0] for r in df.select(compare.direction(F.col("d"))).collect()] == ["unchanged", "improved", "regressed", "missing"]


@pytest.mark.parametrize(
    ("x", "want"), [(1.0, "1"), (-0.0, "0"), (1e21, "1e+21"), (1e-7, "1e-7"), (123456789012345680000.0, "123456789012345680000"), (0.000001, "0.000001"), (1.5e300, "1.5e+300"), (0.1, "0.1"), (100, "100"), (-2.5, "-2.5")]
)
def test_numbers(x, want):
    assert identity.number(x) == want


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=200, deadline=None)
def test_numbers_come_back(x):
    assert float(identity.number(x)) == x


def test_canonical():
    assert identity.canonical({"b": 1, "10": 2, "9": 3, "a": [None, True, {"z": 1.0, "y": "é"}]}) == '{"9":3,"10":2,"a":[null,true,{"y":"é","z":1}],"b":1}'
    assert identity.without_private({"a": {"goldAnswer": 1}, "b": [{"heldOutAnswerKey": 2, "c": 3}], "d": {}}) == {"b": [{"c": 3}], "d": {}}
    clean, paths = identity.without_secrets({"apiKey": "x", "n": [{"v": "Bearer abc"}], "tokens": 5})
    assert clean == {"apiKey": "[REDACTED]", "n": [{"v": "[REDACTED]"}], "tokens": 5} and paths == ["$.apiKey", "$.n[0].v"]
    assert identity.references({"sourceUrl": "u", "x": {"docId": "d", "name": "n"}}) == [("sourceUrl", "u"), ("x.docId", "d")]


def test_scenario_set_hash(spark):
    ids = ["a", "B", "_x", "10", "9", "a-b", "ab"]
    scenarios = [{"id": i, "axes": ["b", "a"], "input": {"messages": [{"role": "user", "content": f"p {i}"}]}, "rubric": {"kind": "programmatic", "checker": "non-empty"}} for i in ids]
    one = identity.scenario_set_hash(spark, "x", "1", scenarios)
    assert one == identity.scenario_set_hash(spark, "x", "1", scenarios[::-1])
    assert one != identity.scenario_set_hash(spark, "x", "2", scenarios)
    assert one == "683780dc927aa837b2c9e8593fc56f40f5aa2f6cb7e3c3171c69e1fb06227d7c"
    v2 = identity.scenario_set_hash_v2(spark, "x", "1", scenarios)
    assert v2 == identity.scenario_set_hash_v2(spark, "x", "1", scenarios[::-1]) and v2["scenarioCount"] == 7


def test_mechanism(spark):
    c = {"quantitative": [{"label": "q", "matchers": ["forty"]}], "disambiguation": [{"label": "d", "matchers": ["rather slow"]}], "actions": [{"label": "a", "matchers": ["pause it"]}], "bingoTokens": ["traffic"]}
    for text, value, tripped in (("forty and rather slow, pause it", 1.0, False), ("traffic", 0.2, True), ("nothing", 0.0, False), ("forty traffic", 0.45, False)):
        s = _one(spark, scoring.mechanism(F.col("x"), c), text)
        assert s.value == pytest.approx(value) and s.bingo_guard_tripped is tripped and s.passed == (value >= 0.5)


def test_judges(spark):
    r = _one(spark, scoring.judge_result(F.col("x")), 'Here: ```{"score": 0.5, "rationale": "ok"}```')
    assert (r.score, r.rationale) == (0.5, "ok")
    assert _one(spark, scoring.judge_result(F.col("x")), '{"score": 3}') is None
    with pytest.raises(ValueError, match="already"):
        scoring.register_checker("keyword", lambda o, p: o)


def test_quorum():
    contract = {"scenarioSetHash": "h", "claimGate": {"status": "allowed"}}
    cell = {"scenarioSetHash": "h", "status": "verified", "expiresAt": "2999-01-01T00:00:00Z"}
    proof = {"scenarioSetHash": "h", "hashSchemaVersion": "v1", "quorum": {"required": 2}, "providerCells": [cell | {"provider": "a"}, cell | {"provider": "b"}, cell | {"provider": "c", "status": "failed"}]}
    ok = gates.verify_quorum(proof, contract, ["a", "b", "c"])
    assert ok["ok"] and ok["warnings"] == ["c: cell not verified or expired"]
    bad = gates.verify_quorum(proof | {"quorum": {"required": 1}}, contract | {"scenarioSetHash": "x"}, ["a"])
    assert not bad["ok"] and "hash-mismatch" in bad["errors"] and "quorum-below-minimum" in bad["errors"]
    with pytest.raises(gates.QuorumNotMet):
        gates.assert_quorum(proof, contract, ["a"])


def test_tools():
    assert environment.check_tool({"denied": ["x"]}, "x", 0) and environment.check_tool({"allowed": ["y"]}, "x", 0) and environment.check_tool({"maxCalls": 1}, "x", 1)
    assert environment.check_tool(None, "x", 0) is None
    assert [environment.validator_value(v) for v in (True, 0.5, {"value": 7}, {"passed": False}, "no", float("nan"))] == [1.0, 0.5, 1.0, 0.0, 0.0, 0.0]
