"""Canonical JSON, digests, redaction of private fields and scenario-set hashes.

These documents are small and their bytes matter, so they are handled on the
driver; over many rows the same functions run in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INDEX = re.compile(r"^(?:0|[1-9]\d{0,9})$")


def number(x: float | int) -> str:
    """A number as JSON authors' tools write it: 1.0 as 1, exponents from 1e21 and below 1e-6, no negative zero."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        x = float(x) if abs(x) >= 1 << 53 else x
        if isinstance(x, int):
            return str(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    digits, exponent = _shortest(abs(x))
    sign, n, k = "-" if x < 0 else "", exponent, len(digits)
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = f"{digits[:n]}.{digits[n:]}"
    elif -6 < n <= 0:
        out = "0." + "0" * -n + digits
    else:
        e = n - 1
        out = f"{digits[0]}{'.' + digits[1:] if k > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"
    return sign + out


def _shortest(x: float) -> tuple[str, int]:
    """Shortest digits that give x back, and where the point stands after the first ones."""
    mantissa, _, e = f"{x!r}".lower().partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    lead = len(whole + part) - len(digits)
    point = len(whole) - lead + (int(e) if e else 0)
    return digits.rstrip("0") or "0", point


def _keys(keys: Iterable[str], authored: bool) -> list[str]:
    """Index-like keys come first, by number; the others as authored or by UTF-16 units."""
    index = sorted((k for k in keys if _INDEX.match(k) and int(k) < 2**32 - 1), key=int)
    rest = [k for k in keys if k not in set(index)]
    return index + (rest if authored else sorted(rest, key=lambda k: k.encode("utf-16-be")))


def dump(x: object, authored: bool = False) -> str:
    """Compact JSON text; keys sorted, or as authored."""
    if x is None:
        return "null"
    if isinstance(x, (bool, int, float)):
        return number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, Mapping):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x[k], authored)}" for k in _keys(x, authored)) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(dump(v, authored) for v in x) + "]"
    return "null"


def canonical(x: object) -> str:
    return dump(x)


def digest(x: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(x).encode()).hexdigest()


#: Fields that never enter a public digest.
PRIVATE = frozenset(
    [f"{when}AnswerKey{s}" for when in ("heldOut", "private") for s in ("", "s")] + [f"gold{what}" for what in ("Label", "Answers", "Answer")]
    + ["mechanismAliasDictionary", "mechanismAliases", "privateScoringData"]
)


def without_private(x: object, private: frozenset[str] = PRIVATE) -> object:
    """x without private fields at any depth; objects that are left empty go too."""
    if isinstance(x, list):
        return [without_private(v, private) for v in x]
    if isinstance(x, Mapping):
        kept = {k: without_private(v, private) for k, v in x.items() if k not in private}
        return {k: v for k, v in kept.items() if v != {} or x[k] == {}} if kept else {}
    return x


_SENSITIVE = re.compile(r"(?i)(api[_-]?key|token|secret|password|authorization|credential|cookie)")
_SECRET = re.compile(r"(?i)^(sk-|Bearer\s|gh[ps]_|xox[baprs]-)")


def without_secrets(x: object, path: str = "$") -> tuple[object, list[str]]:
    """x with sensitive keys' values and secret-looking texts blanked, and the paths of what was."""
    if isinstance(x, Mapping):
        out, paths = {}, []
        for k, v in x.items():
            if _SENSITIVE.search(k) and not isinstance(v, (int, float)) and v is not None:
                out[k] = "[REDACTED]"
                paths.append(f"{path}.{k}")
            else:
                out[k], more = without_secrets(v, f"{path}.{k}")
                paths += more
        return out, paths
    if isinstance(x, list):
        each = [without_secrets(v, f"{path}[{i}]") for i, v in enumerate(x)]
        return [v for v, _ in each], [p for _, ps in each for p in ps]
    if isinstance(x, str) and _SECRET.match(x):
        return "[REDACTED]", [path]
    return x, []


_REFERENCE = re.compile(r"(ref|url|uri|path|id)$", re.I)


def references(x: object, depth: int = 6, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of values under keys that name references, to a depth."""
    if depth < 0:
        return []
    out: list[tuple[str, str]] = []
    items = x.items() if isinstance(x, Mapping) else ((str(i), v) for i, v in enumerate(x)) if isinstance(x, list) else ()
    for k, v in items:
        here = f"{path}.{k}" if path else str(k)
        if isinstance(v, str) and v and _REFERENCE.search(str(k)):
            out.append((here, v))
        else:
            out += references(v, depth - 1, here)
    return list(dict.fromkeys(out))


def over_rows(f: Callable[[object], object], column: Column) -> Column:
    """f over a column of JSON text, as canonical JSON; text that isn't JSON gives null."""

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            try:
                return canonical(f(json.loads(t)))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(column)


def _collation_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.collate(F.col("id"), "UNICODE"), "id")


def scenario_member(scenario: Mapping) -> dict:
    """What a scenario contributes to its set's identity; key order is part of it, absent keys stay out."""
    out = {"id": scenario["id"], "axes": sorted(scenario.get("axes", []))}
    if scenario.get("multiTurn") and scenario.get("environment") is None:
        system = scenario.get("systemPrompt")
        past = next((scenario[k] for k in ("conversationHistory", "seedHistory") if scenario.get(k) is not None), [])
        out |= {"multiTurn": True} | ({"systemPrompt": system} if system else {}) | {"conversationHistory": past}
        fields = ("userTurns", "persistenceCriteria")
    else:
        fields = ("input", "rubric", "environment")
    return out | {k: scenario[k] for k in fields if k in scenario}


def scenario_set_hash(spark, name: str, version: str, scenarios: list[Mapping]) -> str:
    """Digest of a data set's name, version and members; members stand in the order of Unicode collation of their ids."""
    by_id: dict[str, list[Mapping]] = {}
    for s in scenarios:
        by_id.setdefault(s["id"], []).append(s)
    ids = [r["id"] for r in _collation_order(spark.createDataFrame([(i,) for i in by_id], "id string")).collect()] if by_id else []
    members = [scenario_member(s) for i in ids for s in by_id[i]]
    return hashlib.sha256(dump({"name": name, "version": version, "scenarios": members}, authored=True).encode()).hexdigest()


def scenario_set_hash_v2(spark, name: str, version: str, scenarios: list[Mapping], fingerprints: list[Mapping] = (), plugins: list[Mapping] = ()) -> dict:
    """Metadata with a digest over public descriptors: rubric kinds and gate shapes, never private answers."""
    order = [r["id"] for r in _collation_order(spark.createDataFrame([(s["id"],) for s in scenarios], "id string")).collect()] if scenarios else []
    at = {i: k for k, i in enumerate(order)}
    members = []
    for s in sorted(scenarios, key=lambda s: at[s["id"]]):
        rubric = s.get("rubric") or {"kind": "multi-turn" if s.get("multiTurn") else "environment"}
        shape = {g: [{"label": x["label"], "matchers": len(x["matchers"])} for x in rubric.get(g, [])] for g in ("quantitative", "disambiguation", "actions") if g in rubric}
        members.append({"id": s["id"], "axes": sorted(s.get("axes", [])), "input": without_private(s.get("input") or {"userTurns": s.get("userTurns", [])}), "rubric": {"kind": rubric["kind"], "checker": rubric.get("checker"), **shape}})
    turns = [len(s["userTurns"]) for s in scenarios if s.get("multiTurn")]
    body = {"schema": "v2", "name": name, "version": version, "members": members, "fingerprints": sorted(map(canonical, fingerprints)), "plugins": sorted(map(canonical, plugins))}
    whole = hashlib.sha256(canonical(body).encode()).hexdigest()
    return {"hashSchemaVersion": "v2", "scenarioSetHash": whole, "shortHash": whole[:12], "scenarioCount": len(scenarios), "multiTurn": {"scenarios": len(turns), "maxTurns": max(turns, default=0)}}
