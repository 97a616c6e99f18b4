"""Multi-turn persistence: criteria graded against captured turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as m
from ..functions import text as tx

GRADER = "persistence-grader-v1"


def turn_map(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turns: map of turn index to struct(assistant, user); the first of several rows of a turn counts."""
    first = turns.groupBy(*keys, "turn_index").agg(F.min_by(F.struct("assistant_text", "user_message"), "turn_ord").alias("t"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("turn_index", F.struct(F.col("t.assistant_text").alias("assistant"), F.col("t.user_message").alias("user"))))).alias("turns"))


def _said(turns: Column, index: int | None) -> Column:
    return F.coalesce(F.try_element_at(turns, F.lit(index))["assistant"], F.lit(""))


def _exchange(turns: Column, index: int) -> Column:
    t = F.try_element_at(turns, F.lit(index))
    return F.concat(F.coalesce(t["user"], F.lit("")), F.lit("\n"), F.coalesce(t["assistant"], F.lit("")))


def _verdict(verdict: str, reason: str, matched: Column | None = None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), (matched if matched is not None else F.lit(None).cast("string")).alias("matched"))


def _first_unnegated(text: Column, phrases: list[str]) -> Column:
    return m.first_of(phrases, [m.unnegated(text, p) for p in phrases])


def _first_present(text: Column, phrases: list[str]) -> Column:
    return m.first_of(phrases, [m.present(text, p) for p in phrases])


def _groups_met(text: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & m.any_present(text, g)
    return out


def _established(c: Mapping, text: Column) -> Column:
    kind = c["kind"]
    if kind == "fact-persistence":
        return m.any_present(text, c["factPhrases"])
    if kind == "disposition-persistence":
        return m.any_unnegated(text, c["holdPhrases"])
    if kind == "constraint-persistence":
        return m.any_present(text, c.get("acknowledgePhrases") or c["violationPhrases"])
    if kind == "mechanism-persistence":
        return m.any_present(text, c["retainedInvariantPhrases"])
    return m.any_present(text, c["updatedDiagnosisPhrases"]) | m.any_present(text, c["staleDiagnosisPhrases"])


def grade(turns: Column, criterion: Mapping) -> Column:
    """struct verdict, reason, matched of one criterion over a map of turns.

    What is missing fails: first the target turn, then its text, then what should
    have been established, then what the kind of criterion asks for, in order.
    """
    c = criterion
    target = F.try_element_at(turns, F.lit(int(c["targetTurnIndex"])))
    text = F.coalesce(target["assistant"], F.lit(""))
    steps: list[tuple[Column, Column]] = [
        (target.isNull(), _verdict("fail", "target-turn-missing")),
        (tx.trim(text) == "", _verdict("fail", "target-turn-empty")),
    ]
    if c.get("establishedAtTurn") is not None:
        steps.append((~_established(c, _said(turns, int(c["establishedAtTurn"]))), _verdict("fail", "establishment-missing")))
    kind = c["kind"]
    last = _verdict("fail", "forgotten")
    if kind == "fact-persistence":
        hit = _first_present(text, c["factPhrases"])
        steps.append((hit.isNotNull(), _verdict("pass", "persisted", hit)))
    elif kind == "disposition-persistence":
        flip, hold = _first_unnegated(text, c["flipPhrases"]), _first_unnegated(text, c["holdPhrases"])
        steps += [(flip.isNotNull(), _verdict("fail", "flipped", flip)), (hold.isNotNull(), _verdict("pass", "persisted", hold))]
    elif kind == "constraint-persistence":
        broken = _first_unnegated(text, c["violationPhrases"])
        steps.append((broken.isNotNull(), _verdict("fail", "violated", broken)))
        if c.get("acknowledgePhrases"):
            said = _first_present(text, c["acknowledgePhrases"])
            steps.append((said.isNotNull(), _verdict("pass", "persisted", said)))
        else:
            last = _verdict("pass", "persisted")
    elif kind == "mechanism-persistence":
        if c.get("pressureTurnIndex") is not None and c.get("pressurePhrases"):
            steps.append((~m.any_present(_exchange(turns, int(c["pressureTurnIndex"])), c["pressurePhrases"]), _verdict("fail", "pressure-missing")))
        back, kept = _first_unnegated(text, c["forbiddenReversalPhrases"]), _first_present(text, c["retainedInvariantPhrases"])
        steps += [
            (back.isNotNull(), _verdict("fail", "flipped", back)),
            (kept.isNull() | ~_groups_met(text, [*(c.get("requiredMechanismPhrases") or []), *(c.get("requiredDetailPhrases") or [])]), _verdict("fail", "mechanism-missing")),
        ]
        last = _verdict("pass", "persisted", kept)
    elif kind == "evidence-update":
        stale, new = _first_unnegated(text, c["staleDiagnosisPhrases"]), _first_present(text, c["updatedDiagnosisPhrases"])
        steps += [
            (~m.any_present(_exchange(turns, int(c["newEvidenceTurnIndex"])), c["newEvidencePhrases"]), _verdict("fail", "evidence-missing")),
            (stale.isNotNull(), _verdict("fail", "stale-diagnosis", stale)),
            (new.isNull(), _verdict("fail", "mechanism-missing")),
        ]
        last = _verdict("pass", "persisted", new)
    else:
        last = _verdict("fail", "malformed-criterion")
    out = F.when(*steps[0])
    for condition, verdict in steps[1:]:
        out = out.when(condition, verdict)
    return out.otherwise(last)


def grade_all(conversations: DataFrame, criteria: list[Mapping]) -> DataFrame:
    """conversations (with a map column turns) with a row for each criterion: criterion_id, verdict, reason, matched."""
    graded = F.array(*[F.struct(F.lit(c["id"]).alias("criterion_id"), grade(F.col("turns"), c).alias("g")) for c in criteria])
    return conversations.withColumn("x", F.explode(graded)).select(*[c for c in conversations.columns if c != "turns"], "x.criterion_id", "x.g.verdict", "x.g.reason", "x.g.matched")


def scenario_scores(conversations: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: share of criteria passed; 0 for a conversation without any."""
    passed = graded.groupBy(*keys).agg(F.avg((F.col("verdict") == "pass").cast("int")).alias("value"))
    return conversations.select(*keys).distinct().join(passed, keys, "left").na.fill(0.0, ["value"])


def evidence_validity(hash_expected: str | None = None, grader: str = GRADER) -> Column:
    """The first reason why an evidence row doesn't hold, or ``valid``.

    Columns: grader_version, scenario_set_hash, trace_ref, recorded_at, criteria_total, criteria_passed.
    """
    has = lambda c: tx.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    total, passed = F.col("criteria_total"), F.col("criteria_passed")
    out = F.when(~has("grader_version"), "missing-grader-version").when(F.col("grader_version") != grader, "unsupported-grader-version").when(~has("scenario_set_hash"), "missing-scenario-set-hash")
    if hash_expected:
        out = out.when(F.col("scenario_set_hash") != hash_expected, "scenario-set-hash-mismatch")
    return (
        out.when(~has("trace_ref"), "missing-trace-reference")
        .when(~has("recorded_at"), "missing-recorded-at")
        .when(total.isNull() | (total <= 0), "criteria-total-not-positive")
        .when(passed.isNull() | (passed != total), "criteria-not-all-passed")
        .otherwise("valid")
    )


def history(turns: DataFrame, key: str, order: str) -> DataFrame:
    """turns with history: all messages of the conversation up to and with each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def collapse(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, output (of the last turn), turns, latency_ms in all."""
    return turns.groupBy(*keys).agg(F.max_by("assistant_text", order).alias("output"), F.count(F.lit(1)).alias("turns"), F.sum("latency_ms").alias("latency_ms"))


def stub_response(messages: Column, kind: str = "echo") -> Column:
    """What the built-in stub runners say: the last user message, or nothing."""
    if kind == "empty":
        return F.lit("")
    user = F.filter(messages, lambda x: x["role"] == "user")
    return F.coalesce(F.try_element_at(user, F.lit(-1))["content"], F.lit(""))


def split_messages(messages: Column, fallback_system: str | None = None) -> Column:
    """struct system, turns: system messages joined by blank lines (or the fallback), and the other messages."""
    system = F.array_join(F.transform(F.filter(messages, lambda x: x["role"] == "system"), lambda x: x["content"]), "\n\n")
    return F.struct(F.when(system != "", system).otherwise(F.lit(fallback_system)).alias("system"), F.filter(messages, lambda x: x["role"] != "system").alias("turns"))
