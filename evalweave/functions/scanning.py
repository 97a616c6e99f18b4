"""Phrase matching over Arrow batches: the matcher of ``matching``, each text scanned once for all phrases.

A scan stops at a phrase's first occurrence that nothing negates, so most texts
cost little more than finding it. Results equal the JVM expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matching as m

_ASCII = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \t\n\x0B\f\r"}


def _python(java: str) -> str:
    """A Java pattern as this language has it: \\d, \\w and \\s mean ASCII, \\z is \\Z."""
    out, at, inside = [], 0, False
    while at < len(java):
        c = java[at]
        if c == "\\" and at + 1 < len(java):
            n = java[at + 1]
            if n.lower() in _ASCII and not (inside and n.isupper()):
                out.append(_ASCII[n] if inside else f"[{'^' if n.isupper() else ''}{_ASCII[n.lower()]}]")
            else:
                out.append(r"\Z" if n == "z" else java[at : at + 2])
            at += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        at += 1
    return "".join(out)


@lru_cache(maxsize=None)
def compiled(matcher: str, substring: bool = False):
    """A matcher's pattern, compiled once in each process."""
    p = _python(m.pattern(matcher, substring))
    return regex.compile(p) if re.match(r"^/(.+)/([A-Za-z]*)$", matcher, re.S) else re.compile(p)


_NEGATIONS = [re.compile(_python(p)) for p in (m.DIRECT, m.NO, m.CONTRAST)]
_BOUNDARY = re.compile(_python(m.BOUNDARY))
#: Letters outside ASCII that equal ASCII letters in some case; texts that hold one are searched by pattern.
_FOLDING = re.compile("[\u0130\u0131\u017f\u212a]")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def negated(before: str) -> bool:
    """Whether what stands before an occurrence negates it."""
    window = before[-m.WINDOW :]
    low = window.lower()
    if not ("no" in low or "don" in low or "never" in low or "instead" in low or "rather" in low or _FOLDING.search(window)):
        return False
    clause = _BOUNDARY.sub("", window, count=1)
    return any(p.search(clause) for p in _NEGATIONS)


class Folded:
    """A text with its lower case, if that has the text's places; made once for all phrases."""

    __slots__ = ("text", "low")

    def __init__(self, text: str):
        self.text = text
        self.low = text.lower() if text.isascii() or not _FOLDING.search(text) else None


class _Finder:
    """The places where a matcher is found, by plain search for phrases of ASCII and by pattern for others."""

    def __init__(self, matcher: str, substring: bool):
        self.pattern = compiled(matcher, substring)
        words = re.split(f"[{m.WS}]+", re.sub(f"^[{m.WS}]+|[{m.WS}]+$", "", matcher))
        whole = " ".join(words)
        self.first = words[0].lower() if whole and whole.isascii() and not re.match(r"^/(.+)/([A-Za-z]*)$", matcher, re.S) else None
        self.rest = re.compile("".join(f"[{m.WS}]+{re.escape(w.lower())}" for w in words[1:])) if len(words) > 1 else None
        self.head, self.tail = (not substring and bool(re.match("[A-Za-z0-9]", c)) for c in (whole[:1], whole[-1:]))

    def places(self, t: Folded) -> Iterator[int]:
        if self.first is None or t.low is None:
            yield from (x.start() for x in self.pattern.finditer(t.text))
            return
        low, first, size = t.low, self.first, len(t.low)
        at = low.find(first)
        while at >= 0:
            end = at + len(first)
            if self.head and at and low[at - 1] in _WORD:
                at = low.find(first, at + 1)
                continue
            if self.rest is not None:
                x = self.rest.match(low, end)
                end = x.end() if x else -1
            if end >= 0 and not (self.tail and end < size and low[end] in _WORD):
                yield at
                at = low.find(first, end)
            else:
                at = low.find(first, at + 1)


@lru_cache(maxsize=None)
def _finder(matcher: str, substring: bool = False) -> _Finder:
    return _Finder(matcher, substring)


def present(text: str | Folded, matcher: str) -> bool:
    t = text if isinstance(text, Folded) else Folded(text)
    return next(_finder(matcher).places(t), None) is not None


def unnegated(text: str | Folded, matcher: str, substring: bool = False) -> bool:
    """Whether the matcher is found where nothing negates it."""
    t = text if isinstance(text, Folded) else Folded(text)
    return any(not negated(t.text[max(0, at - m.WINDOW) : at]) for at in _finder(matcher, substring).places(t))


def hits(text: Column, matchers: Sequence[str], seen: Sequence[str] = (), substring: bool = False) -> Column:
    """array<boolean>: for each of matchers whether it is found un-negated, then for each of seen whether it is found at all; false for a null text."""
    for x in (*matchers, *seen):
        compiled(x, substring)
    want, plain = list(matchers), list(seen)

    @F.arrow_udf("array<boolean>")
    def scan(texts: pa.Array) -> pa.Array:
        none = [False] * (len(want) + len(plain))

        def of(text: str | None) -> list[bool]:
            if text is None:
                return none
            t = Folded(text)
            return [unnegated(t, x, substring) for x in want] + [present(t, x) for x in plain]

        # One text at a time becomes an object; of the others there is the batch as it came.
        return pa.array((of(t.as_py()) for t in texts), pa.list_(pa.bool_()), size=len(texts))

    return scan(text)
