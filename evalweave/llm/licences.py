"""Licence scans.

An Aho-Corasick automaton finds identifier tags (``SPDX-License-Identifier:``)
and notice phrases, longest first, in the text with case and white space
levelled. The expression after a tag is parsed by a shunting-yard parser
(``WITH`` before ``AND`` before ``OR``, parentheses, ``+``) and evaluated: of an
``OR`` the freer side counts, of an ``AND`` the stricter one. Everything found
in a document holds together.

A GNU licence named without a version (and nowhere in the document with one) is
that of any version; the BSD body is told apart by its further clauses.

Cases: null, empty and plain texts have no findings: restriction ``none``,
allowed; a broken expression is kept as found, restriction ``unknown`` and not
allowed; identifiers that aren't known are ``unknown``; findings that repeat
count once; whole texts are scanned, and expressions of any length and depth read; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: From free to strict; an AND takes the later, an OR the earlier.
RANKS = ["none", "public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "noncommercial", "unknown", "proprietary"]
ALLOWED = {"none", "public-domain", "permissive", "weak-copyleft"}

KINDS = {
    "public-domain": "CC0-1.0 Unlicense 0BSD WTFPL PDDL-1.0 CC-PDDC SAX-PD blessing libpng-2.0-PD LicenseRef-Public-Domain",
    "permissive": "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC Zlib BSL-1.0 PostgreSQL Python-2.0 PSF-2.0 X11 NCSA HPND CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 Artistic-1.0 Artistic-2.0 ODC-By-1.0 BlueOak-1.0.0 UPL-1.0 "
    "AFL-2.1 AFL-3.0 Apache-1.0 BSD-1-Clause BSD-2-Clause-Patent BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-Source-Code bzip2-1.0.6 CNRI-Python curl ECL-2.0 EFL-2.0 FSFAP FTL GD ICU IJG ImageMagick Info-ZIP JSON libpng-2.0 Libpng libtiff "
    "MIT-CMU MIT-Modern-Variant MITNFA MulanPSL-2.0 Naumen NTP OLDAP-2.8 OpenSSL PHP-3.0 PHP-3.01 Ruby SMLNJ SSH-OpenSSH SunPro TCL TCP-wrappers Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Vim W3C W3C-20150513 Xnet XFree86-1.1 Zend-2.0 ZPL-2.0 ZPL-2.1 zlib-acknowledgement FSFUL FSFULLR Beerware HPND-sell-variant Spencer-94 TU-Berlin-1.0 OFL-1.0 OFL-1.1",
    "weak-copyleft": "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 MS-RL MS-PL APSL-2.0 CPL-1.0 IPL-1.0 CECILL-C NPL-1.1 SPL-1.0 LPPL-1.3c ErlPL-1.1 Nokia CPAL-1.0 RPSL-1.0 SISSL",
    "copyleft": "CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CECILL-2.0 CECILL-2.1 EUPL-1.0 GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later OSL-1.0 OSL-2.0 OSL-2.1 QPL-1.0 Sleepycat CC-SA-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later CC-BY-SA-3.0 CC-BY-SA-4.0 EUPL-1.1 EUPL-1.2 ODbL-1.0 GFDL-1.3-only GFDL-1.3-or-later OSL-3.0",
    "network-copyleft": "AGPL-1.0-only AGPL-1.0-or-later RPL-1.1 RPL-1.5 CPOL-1.02 AGPL-3.0-only AGPL-3.0-or-later SSPL-1.0",
    "noncommercial": "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-ND-3.0 PolyForm-Small-Business-1.0.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 PolyForm-Noncommercial-1.0.0",
    "proprietary": "LicenseRef-Proprietary BUSL-1.1",
}
KIND_OF = {x.lower(): kind for kind, names in KINDS.items() for x in names.split()}
NAME_OF = {x.lower(): x for names in KINDS.values() for x in names.split()}
#: Older identifiers, as they are read today.
for _old in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    NAME_OF[_old.lower()], KIND_OF[_old.lower()] = f"{_old}-only", KIND_OF[f"{_old}-only".lower()]
#: Exceptions that free what a copyleft licence links to.
LINKING = {"classpath-exception-2.0", "gcc-exception-3.1", "gcc-exception-2.0", "llvm-exception", "linux-syscall-note", "font-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "openjdk-assembly-exception-1.0", "u-boot-exception-2.0", "wxwindows-exception-3.1"}

#: Marks that name a licence only together with others: names of GNU licences without a version, and parts of the BSD licences.
UNVERSIONED = {"?GPL": "GPL-1.0-or-later", "?LGPL": "LGPL-2.0-or-later", "?AGPL": "AGPL-3.0-or-later"}
BSD_BODY, BSD_NAMES, BSD_ADVERTISING = "?BSD", "?BSD-names", "?BSD-advertising"

_TAG = "spdx-license-identifier:"
PHRASES: dict[str, str] = {_TAG: ""}


def _phrases(identifier: str, *phrases: str) -> None:
    for p in phrases:
        PHRASES[p] = identifier


_phrases("MIT", "mit license", "mit licence", "the mit license (mit)", "permission is hereby granted, free of charge, to any person obtaining a copy")
for _v in ("2.0", "1.1"):
    _phrases(f"Apache-{_v}", f"apache license, version {_v}", f"apache license version {_v}", f"apache license {_v}", f"apache-{_v} license", f"apache software license, version {_v}")
for _n, _long in (("GPL", "gnu general public license"), ("LGPL", "gnu lesser general public license"), ("AGPL", "gnu affero general public license")):
    for _v, _full in (("1", "1.0"), ("2", "2.0"), ("2.1", "2.1"), ("3", "3.0")):
        if f"{_n}-{_full}".lower() not in NAME_OF:
            continue
        for _form in (f"{_long}, version {_v}", f"{_long} version {_v}", f"{_long} v{_v}", f"{_long}, v{_v}", f"gnu {_n.lower()} v{_v}", f"{_n.lower()}v{_v}"):
            _phrases(f"{_n}-{_full}-only", _form, f"{_form} only")
            for _later in (" or later", ", or later", " or any later version", ", or any later version", " or (at your option) any later version", ", or (at your option) any later version"):
                _phrases(f"{_n}-{_full}-or-later", _form + _later)
        _phrases(f"{_n}-{_full}-or-later", f"{_n.lower()}v{_v}+")
for _n, _long in (("GPL", "general"), ("LGPL", "lesser general"), ("LGPL", "library general"), ("AGPL", "affero general")):
    _phrases(f"?{_n}", f"gnu {_long} public license", f"gnu {_n.lower()}")
for _kind, _words in (("BY", "attribution"), ("BY-SA", "attribution-sharealike"), ("BY-NC", "attribution-noncommercial"), ("BY-ND", "attribution-noderivatives"), ("BY-NC-SA", "attribution-noncommercial-sharealike"), ("BY-NC-ND", "attribution-noncommercial-noderivatives")):
    for _v in ("3.0", "4.0"):
        if f"cc-{_kind}-{_v}".lower() in NAME_OF:
            _phrases(f"CC-{_kind}-{_v}", f"cc {_kind} {_v}".lower(), f"cc-{_kind}-{_v}".lower(), f"cc-{_kind} {_v}".lower(), f"creative commons {_words} {_v}", f"creative commons {_words} {_v} international")
_phrases("CC0-1.0", "cc0 1.0", "cc0-1.0", "creative commons zero", "dedicated to the public domain")
_phrases("Unlicense", "this is free and unencumbered software released into the public domain", "the unlicense")
_phrases("MPL-2.0", "mozilla public license, version 2.0", "mozilla public license, v. 2.0", "mozilla public license version 2.0", "mozilla public license 2.0")
_phrases("BSD-2-Clause", "bsd 2-clause", "bsd-2-clause", "2-clause bsd", "simplified bsd license")
_phrases("BSD-3-Clause", "bsd 3-clause", "bsd-3-clause", "3-clause bsd", "new bsd license", "modified bsd license")
_phrases(BSD_BODY, "redistribution and use in source and binary forms", *[f"all rights reserved{x} redistribution and use in source and binary forms" for x in (".", "")])
_phrases(BSD_NAMES, "endorse or promote products derived from")
_phrases(BSD_ADVERTISING, "all advertising materials mentioning features or use of")
_phrases("ISC", "isc license", "permission to use, copy, modify, and/or distribute this software", "permission to use, copy, modify, and distribute this software")
_phrases("0BSD", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software is provided", "zero-clause bsd", "bsd zero clause")
_phrases("HPND", "permission to use, copy, modify, and distribute this software and its documentation")
_phrases("PostgreSQL", "postgresql license", "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted")
_phrases("Zlib", "zlib license", "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "altered source versions must be plainly marked as such")
_phrases("BSL-1.0", "boost software license, version 1.0", "boost software license 1.0")
_phrases("EPL-2.0", "eclipse public license, version 2.0", "eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license - v 2.0")
_phrases("EPL-1.0", "eclipse public license, version 1.0", "eclipse public license 1.0", "eclipse public license - v 1.0")
_phrases("LicenseRef-Proprietary", "all rights reserved", "proprietary and confidential", "unauthorized copying of this file")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, identifier in PHRASES.items():
        a.add_word(phrase, (len(phrase), identifier))
    a.make_automaton()
    return a


_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_OPERATORS = {"OR": 1, "AND": 2, "WITH": 3}


class Node:
    """An expression: an identifier (op None), or an operator with two sides."""

    __slots__ = ("op", "name", "left", "right")

    def __init__(self, op: str | None, name: str = "", left: Node | None = None, right: Node | None = None):
        self.op, self.name, self.left, self.right = op, name, left, right

    def __str__(self) -> str:
        out: list[str] = []
        work: list[Node | str] = [self]
        while work:
            x = work.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.op is None:
                out.append(x.name)
            else:
                for k, side in enumerate((x.right, x.left)):
                    work += [")", side, "("] if side.op and _OPERATORS[side.op] < _OPERATORS[x.op] else [side]
                    if not k:
                        work.append(f" {x.op} ")
        return "".join(out)

    def names(self) -> list[str]:
        """The licences named, from left to right; exceptions aren't licences."""
        out: list[str] = []
        work = [self]
        while work:
            x = work.pop()
            if x.op is None:
                out.append(x.name)
            else:
                work += [x.left] if x.op == "WITH" else [x.right, x.left]
        return out

    def kind(self) -> str:
        """The restriction that the expression amounts to."""
        done: list[int] = []
        work: list[tuple[Node, bool]] = [(self, False)]
        while work:
            x, known = work.pop()
            if x.op is None:
                done.append(RANKS.index(_kind(x.name)))
            elif not known:
                work += [(x, True), (x.left, False)] + ([(x.right, False)] if x.op != "WITH" else [])
            elif x.op == "WITH":
                if RANKS[done[-1]] == "copyleft" and x.right.op is None and x.right.name.lower() in LINKING:
                    done[-1] = RANKS.index("weak-copyleft")
            else:
                one, other = done.pop(), done.pop()
                done.append((min if x.op == "OR" else max)(one, other))
        return RANKS[done[0]]


def _canonical(name: str) -> str:
    low = name.lower()
    if low.endswith("+"):
        later = f"{low[:-1]}-or-later"
        return NAME_OF.get(later, NAME_OF.get(low[:-1], name[:-1] + "+"))
    return NAME_OF.get(low, name)


def _kind(name: str) -> str:
    return KIND_OF.get(name.lower(), "unknown")


def parse(text: str) -> tuple[Node | None, str]:
    """The expression at the head of text (None if it is broken), and as much of the text as it takes.

    Reading ends before a token that can't go on, so what follows a tag on its
    line does no harm.
    """
    output: list[Node] = []
    stack: list[str] = []
    expect_name, at, depth = True, 0, 0

    def apply() -> None:
        op = stack.pop()
        right, left = output.pop(), output.pop()
        output.append(Node(op, "", left, right))

    while m := _TOKEN.match(text, at):
        token = m[1]
        op = token.upper() if token.upper() in _OPERATORS else None
        if token == "(" and expect_name:
            stack.append("(")
            depth += 1
        elif token == ")" and not expect_name and depth:
            while stack[-1] != "(":
                apply()
            stack.pop()
            depth -= 1
        elif op and not expect_name:
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[op]:
                apply()
            stack.append(op)
            expect_name = True
        elif token not in "()" and not op and expect_name:
            output.append(Node(None, _canonical(token) if not (stack and stack[-1] == "WITH") else token))
            expect_name = False
        else:
            break
        at = m.end()
    taken = text[:at].strip()
    if expect_name or depth or not output:
        return None, taken
    while stack:
        apply()
    return output[0], taken


_LATER = r"(?P<later>\+|-or-later|,? or (?:\(?at your option\)?,? )?(?:any )?(?:later|newer)(?: version)?)?"
#: A version after a GNU licence's name, as in the Free Software Foundation's headers, or before it.
_AFTER = re.compile(rf"(?: \((?:gnu )?[al]?gpl\))?(?: as published by the free software foundation)?(?:[;,])?(?: either)?(?: version |[ -]?v\.? ?|[ -])(?P<v>[123](?:\.[01])?)(?![.]?\d)(?: of the license)?{_LATER}")
_BEFORE = re.compile(rf"(?<!\w)(?:version |v)(?P<v>[123](?:\.[01])?)(?: only)?{_LATER} of the $")


def _versioned(mark: str, level: str, start: int, end: int) -> str:
    """The licence that a GNU licence's name at level[start:end] means, with the version around it; '' if there is none."""
    m = _AFTER.match(level, end)
    if not m or not _edge(level, m.end()):
        m = _BEFORE.search(level[max(0, start - 80) : start])
    if not m:
        return ""
    v = m["v"] if "." in m["v"] else f"{m['v']}.0"
    return NAME_OF.get(f"{mark[1:]}-{v}-{'or-later' if m['later'] else 'only'}".lower(), "")


def _resolve(marks: set[str], names: set[str]) -> set[str]:
    """The licences that marks stand for, beside the names found."""
    out = {x for mark, x in UNVERSIONED.items() if mark in marks and not any(n.startswith(f"{mark[1:]}-") for n in names)}
    if BSD_BODY in marks:
        out.add("BSD-4-Clause" if BSD_ADVERTISING in marks else "BSD-3-Clause" if BSD_NAMES in marks else "BSD-2-Clause")
    return out


def _edge(text: str, at: int) -> bool:
    return at < 0 or at >= len(text) or not text[at].isalnum()


def scan(text: str | None, found: ahocorasick.Automaton) -> tuple[list[str], list[str], str]:
    """Licences named in the text, expressions of its tags, and the restriction of all of them together."""
    names: set[str] = set()
    marks: set[str] = set()
    expressions: dict[str, str] = {}
    kinds = {"none"}
    if text:
        level = " ".join(text.lower().split())
        tagged = False
        for end, (length, identifier) in found.iter_long(level):
            if not identifier:
                tagged = True
            elif not _edge(level, end - length):
                continue
            elif identifier in UNVERSIONED and (name := _versioned(identifier, level, end + 1 - length, end + 1)):
                names.add(name)
            elif _edge(level, end + 1):
                (marks if identifier[0] == "?" else names).add(identifier)
        kinds.update(map(_kind, names))
        if tagged:
            for m in re.finditer(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)", text):
                tree, taken = parse(m[1])
                if tree is None:
                    expressions[taken] = "unknown"
                else:
                    expressions[str(tree)] = tree.kind()
                    names.update(tree.names())
        rest = _resolve(marks, names)
        names |= rest
        kinds.update(map(_kind, rest), expressions.values())
    return sorted(names), sorted(expressions), RANKS[max(RANKS.index(k) for k in kinds)]


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences, expressions, restriction, allowed for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = [scan(t.as_py(), found) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string()), pa.array([r[2] in ALLOWED for r in rows], pa.bool_())],
                names=["doc_id", "licences", "expressions", "restriction", "allowed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licences array<string>, expressions array<string>, restriction string, allowed boolean")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))
