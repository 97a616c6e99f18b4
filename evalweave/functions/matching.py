"""Phrase matching with word edges and local negation, as JVM expressions.

A phrase counts only where no negation governs it: of the WINDOW characters
before an occurrence, the part after the last clause boundary must not end in a
negation. Java's ``\\b`` knows Unicode letters while rubrics mean ASCII words,
so edges are spelled out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

WINDOW = 48
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_W, _S = "A-Za-z0-9_", WS
_NOT_JUST = "|".join(["only", "just", "necessarily", "merely", "simply"])
DIRECT = rf"(?iu){EDGE}(?:do[{_S}]+not|don't|dont|never|not(?![{_S}]+(?:{_NOT_JUST}){EDGE})){EDGE}[{_W}{_S}'\",:()/-]*\z"
NO = rf"(?iu){EDGE}no[{_S}]+(?:[{_W}-]+[{_S}]+){{0,4}}\z"
CONTRAST = rf"(?iu){EDGE}(?:instead[{_S}]+of|rather[{_S}]+than){EDGE}[{_W}{_S}'\"()/-]*\z"
BOUNDARY = rf"(?isu)^.*(?:[.!?;]|{EDGE}(?:but|however|then){EDGE})"

_JAVA_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|&~#-])")


def _quote(word: str) -> str:
    return _JAVA_SPECIAL.sub(r"\\\1", word)


def pattern(matcher: str, substring: bool = False) -> str:
    """Java pattern of a matcher: ``/source/flags`` is a regular expression, anything else a phrase."""
    m = re.match(r"^/(.+)/([A-Za-z]*)$", matcher, re.S)
    if m:
        unsupported = set(m[2]) & set("ydv")
        if unsupported:
            raise ValueError(f"flags not supported: {''.join(sorted(unsupported))}")
        source = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda x: x[1] + EDGE, m[1])
        source = re.sub(r"(?<!\\)((?:\\\\)*)\$(?!\w)", lambda x: x[1] + r"\z", source) if "m" not in m[2] else source
        return f"(?iu{'m' if 'm' in m[2] else ''}{'s' if 's' in m[2] else ''}){source}"
    words = re.split(rf"[{WS}]+", re.sub(rf"^[{WS}]+|[{WS}]+$", "", matcher))
    source = rf"[{WS}]+".join(map(_quote, words))
    whole = " ".join(words)
    if not substring and whole:
        head, tail = (EDGE if re.match(r"[A-Za-z0-9]", c) else "" for c in (whole[0], whole[-1]))
        source = head + source + tail
    return f"(?iu){source}"


def present(text: Column, matcher: str) -> Column:
    """Whether the matcher is found at all."""
    return text.rlike(pattern(matcher))


def negated(before: Column) -> Column:
    """Whether what stands before an occurrence negates it."""
    clause = F.regexp_replace(F.right(before, F.lit(WINDOW)), BOUNDARY, "")
    return clause.rlike(DIRECT) | clause.rlike(NO) | clause.rlike(CONTRAST)


def unnegated(text: Column, matcher: str, substring: bool = False) -> Column:
    """Whether the matcher is found where nothing negates it."""
    p = pattern(matcher, substring)
    parts, found = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    start = F.struct(F.lit("").alias("pre"), F.lit(False).alias("hit"))

    def step(acc: Column, z: Column) -> Column:
        before = F.concat(acc["pre"], z["part"])
        return F.struct(F.right(F.concat(before, z["m"]), F.lit(200)).alias("pre"), (acc["hit"] | ~negated(before)).alias("hit"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.struct(a.alias("part"), b.alias("m")))
    # Most texts have no occurrence at all: the scan is for those that do.
    return F.when(text.isNull(), F.lit(False)).when(~text.rlike(p), F.lit(False)).otherwise(F.aggregate(pairs, start, step)["hit"])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def any_unnegated(text: Column, matchers: list[str], substring: bool = False) -> Column:
    return any_of([unnegated(text, m, substring) for m in matchers])


def any_present(text: Column, matchers: list[str]) -> Column:
    return any_of([present(text, m) for m in matchers])


def first_of(matchers: list[str], test: list[Column]) -> Column:
    """The first matcher whose test holds; null if none does."""
    return F.coalesce(*[F.when(t, F.lit(m)) for m, t in zip(matchers, test, strict=True)], F.lit(None).cast("string"))
