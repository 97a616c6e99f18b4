"""Environment and multi-turn runs: sequential loops, one group for each (runner, scenario)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .identity import canonical, without_secrets


class EnvironmentAdapter(Protocol):
    """What an environment has to offer; state is any JSON value."""

    def reset(self, scenario: Mapping) -> object: ...
    def step(self, state: object, tool: str, argument: object) -> tuple[object, str, bool]: ...
    def validate(self, state: object, name: str) -> object: ...


_adapters: dict[str, EnvironmentAdapter] = {}


def register(name: str, adapter: EnvironmentAdapter) -> None:
    if name in _adapters:
        raise ValueError(f"environment {name} is registered already")
    _adapters[name] = adapter


def resolve(name: str) -> EnvironmentAdapter:
    if name not in _adapters:
        raise KeyError(f"unknown environment: {name}")
    return _adapters[name]


def check_tool(policy: Mapping | None, tool: str, used: int) -> str | None:
    """Why a tool call is refused, or None."""
    policy = policy or {}
    if tool in policy.get("denied", ()):
        return f"tool {tool} is denied"
    if "allowed" in policy and tool not in policy["allowed"]:
        return f"tool {tool} isn't allowed"
    if used >= policy.get("maxCalls", float("inf")):
        return "no tool calls are left"
    return None


def validator_value(result: object) -> float:
    """A validator's result as a value in 0..1: a truth, a number or {value} or {passed}."""
    if isinstance(result, Mapping):
        result = result.get("value", result.get("passed"))
    if isinstance(result, bool):
        return float(result)
    try:
        x = float(result)
    except (TypeError, ValueError):
        return 0.0
    return min(1.0, max(0.0, x)) if x == x and abs(x) != float("inf") else 0.0


def run(actions: DataFrame, scenarios: list[Mapping], adapter: EnvironmentAdapter) -> DataFrame:
    """runner_id, scenario_id, step, tool, observation, error, state, done for recorded actions (runner_id, scenario_id, step, tool, argument as JSON)."""
    by_id = {s["id"]: s for s in scenarios}

    def episode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        scenario = by_id[pdf["scenario_id"].iloc[0]]
        state, done, out = adapter.reset(scenario), False, []
        limit = scenario.get("environment", {}).get("maxSteps", len(pdf))
        for used, row in enumerate(pdf.itertuples(index=False)):
            if done or used >= limit:
                break
            error = check_tool(scenario.get("environment", {}).get("toolPolicy"), row.tool, used)
            seen = ""
            if error is None:
                state, seen, done = adapter.step(state, row.tool, json.loads(row.argument or "null"))
            out.append((row.runner_id, row.scenario_id, row.step, row.tool, seen, error, canonical(without_secrets(state)[0]), done))
        return pd.DataFrame(out, columns=["runner_id", "scenario_id", "step", "tool", "observation", "error", "state", "done"])

    return actions.groupBy("runner_id", "scenario_id").applyInPandas(episode, "runner_id string, scenario_id string, step int, tool string, observation string, error string, state string, done boolean")


def final_scores(steps: DataFrame, scenarios: list[Mapping], adapter: EnvironmentAdapter) -> DataFrame:
    """runner_id, scenario_id, value: the plain mean of the scenario's validators over the last state."""
    by_id = {s["id"]: s for s in scenarios}
    last = steps.groupBy("runner_id", "scenario_id").agg(F.max_by("state", "step").alias("state"))

    @F.pandas_udf("double")
    def judge(ids: pd.Series, states: pd.Series) -> pd.Series:
        def one(i: str, s: str) -> float:
            names = by_id[i].get("environment", {}).get("validators", [])
            values = [validator_value(adapter.validate(json.loads(s), n if isinstance(n, str) else n["id"])) for n in names]
            return sum(values) / len(values) if values else 0.0

        return pd.Series([one(i, s) for i, s in zip(ids, states, strict=True)])

    return last.select("runner_id", "scenario_id", tx.clamp_finite(judge("scenario_id", "state")).alias("value"))


def run_multi_turn(scenarios: DataFrame, runner: Callable[[list[dict]], str], runner_id: str) -> DataFrame:
    """runner_id, scenario_id, turn_index, user_message, assistant_text, turn_ord: one call a turn, with the history so far.

    scenarios: scenario_id, system_prompt, user_turns; runner is any callable on messages.
    """

    def play(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                messages = [{"role": "system", "content": row.system_prompt}] if row.system_prompt else []
                for i, said in enumerate(row.user_turns):
                    messages.append({"role": "user", "content": said})
                    answer = runner(list(messages))
                    messages.append({"role": "assistant", "content": answer})
                    out.append((runner_id, row.scenario_id, i, said, answer, i))
            yield pd.DataFrame(out, columns=["runner_id", "scenario_id", "turn_index", "user_message", "assistant_text", "turn_ord"])

    return scenarios.select("scenario_id", "system_prompt", "user_turns").mapInPandas(play, "runner_id string, scenario_id string, turn_index int, user_message string, assistant_text string, turn_ord int")
