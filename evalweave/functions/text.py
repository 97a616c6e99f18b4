"""Text functions with the semantics of the source documents' language.

Lengths count UTF-16 units, white space is the Unicode set below, and rounding
is half up. All of them are built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as document authors' tools define it; wider than Java's ``\s``.
WS = r"\t\n\x0B\f\r    -     　﻿"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda would compute it again for each item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def normalise(text: Column) -> Column:
    """Trimmed, runs of white space as one space, lower case."""
    # Runs first: what stands at the ends is a space then, which needs no second pattern over the text.
    return F.lower(F.trim(F.regexp_replace(text, f"[{WS}]+", " ")))


def tokens(text: Column) -> Column:
    """Words of the normalised text without the punctuation around them."""
    bare = F.transform(F.split(normalise(text), " "), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words; of a shorter text its distinct words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) < n, w).otherwise(runs))

    return let(words, of)


def containment(part: Column, whole: Column) -> Column:
    """Share of part's distinct items that whole has; 0 for an empty part."""
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def percent(share: Column) -> Column:
    """Whole per cent, rounded half up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def clamp(x: Column) -> Column:
    """x within [0, 1]; null and NaN stay as they are."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def clamp_finite(x: Column) -> Column:
    """x within [0, 1]; anything that isn't a finite number is 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


_REDACTED = "[REDACTED]"
_BEARER = r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+"
_KEYS = r"\b(?:sk-[A-Za-z0-9._-]+|gh[ps]_[A-Za-z0-9_]+|xox[baprs]-[A-Za-z0-9-]+)\b"
_FLAG = r"--(?:api[_-]?key|token|secret|password|auth|credential)"
_FLAG_IN_TEXT = rf"""(?i)(^|\s)({_FLAG})(=|\s+)(?!--)(?:"[^"]*"|'[^']*'|\S+)"""


def redact(text: Column) -> Column:
    """Bearer tokens and keys of known shapes blanked."""
    return F.regexp_replace(F.regexp_replace(text, _BEARER, F.lit(_REDACTED)), _KEYS, _REDACTED)


def redact_command(line: Column) -> Column:
    """``redact``, and the values of secret flags of a command line."""
    return redact(F.regexp_replace(line, _FLAG_IN_TEXT, rf"$1$2$3{_REDACTED}"))


def redact_argv(argv: Column) -> Column:
    """A command line from its arguments, with the values of secret flags and secret-looking arguments blanked."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

    def step(acc: Column, arg: Column) -> Column:
        is_flag = arg.rlike(f"(?i)^{_FLAG}$")
        shown = (
            F.when(acc["skip"] & ~arg.startswith("-"), F.lit(_REDACTED))
            .when(arg.rlike(f"(?i)^{_FLAG}=.+$"), F.concat(F.regexp_extract(arg, f"(?i)^({_FLAG}=)", 1), F.lit(_REDACTED)))
            .when(~is_flag & arg.rlike(r"(?i)^(?:sk-|Bearer\s|gh[ps]_|xox[baprs]-)"), F.lit(_REDACTED))
            .otherwise(arg)
        )
        return F.struct(F.array_append(acc["out"], shown).alias("out"), (is_flag & ~(acc["skip"] & ~arg.startswith("-"))).alias("skip"))

    return F.array_join(F.aggregate(argv, start, step)["out"], " ")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def xml(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")])


def workflow_message(text: Column) -> Column:
    """Escapes a workflow command's message."""
    return _replaced(text, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")])


def workflow_property(text: Column) -> Column:
    """Escapes a workflow command's property."""
    return _replaced(workflow_message(text), [(":", "%3A"), (",", "%2C")])


def stable_id(text: Column) -> Column:
    """At most 200 characters that are safe in an identifier."""
    return F.left(F.regexp_replace(text, "[^A-Za-z0-9_.:-]+", "-"), F.lit(200))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


_HASH = r"(?i)\b(?:sha256:)?([a-f0-9]{12,64})\b"


def doc_facts(text: Column) -> Column:
    """Numbers and states that a release document claims: scenario counts, hashes, quorums and claim states."""
    counts = [r"(?i)\b(\d[\d,]*)\s+(?:\w+\s+){0,2}scenarios\b", r"(?i)\bscenarios?\s*(?:count)?\s*[:=]\s*(\d[\d,]*)", r"(?i)\bscenarioCount\W+(\d[\d,]*)"]
    quorum = [r"(?i)\bquorum\D{0,20}(\d+\s*(?:/|of)\s*\d+)", r"(?i)\b(\d+\s*(?:/|of)\s*\d+)\s+(?:provider|frontier|quorum)", r"(?i)\b(\d+-of-\d+)\b"]
    found = lambda patterns: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])))
    return F.struct(
        F.array_distinct(F.transform(found(counts), lambda x: F.replace(x, F.lit(",")).cast("bigint"))).alias("scenario_counts"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_HASH), 1), F.lower)).alias("hashes"),
        F.array_distinct(F.transform(found(quorum), lambda x: F.regexp_replace(x, r"(\d+)\D+(\d+)", "$1/$2"))).alias("quorums"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bclaims?\s+(?:are\s+|is\s+|status\s*[:=]\s*)?(allowed|blocked|provisional)\b"), 1), F.lower)).alias("claim_states"),
    )
