"""HTML extraction by union-free regular expressions.

Pages of a host are made by a few templates. A page is read as a stream of tags
and text slots, and folded: runs of one group become a repeated group. For each
host the distinct folded streams are aligned one after the other into a wrapper,
a union-free regular expression: what only one side has becomes optional (neighbours
that pages have all or none of, together),
repeated groups absorb single instances, and texts become slots. A slot whose
text is one and the same on all of the host's pages is part of the template, if
those are two different pages at least (copies of one page don't tell data from
template, nor do pages without texts count);
the others are the page's data, and those outside navigation, page headers,
footers, advertisements and blocks made of links are its content. A link in
running text is part of the text, and the header of an article is content.

Streams are counted before they are aligned, so a host costs its distinct
streams, not its pages.

Cases: a null or empty page, or one without tags, has no wrapper fields but
keeps its plain text as content; a page whose url has no host belongs to host ''
and is aligned with its like; a host with one page, or with copies of one page,
has a wrapper in which every slot is data; broken markup is read as it comes (ends that may be left out are put in, other unclosed and stray tags are tokens
as any others); pages of any length are read whole, elements nested to any depth; rows that repeat
are extracted each; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, sized

_SKIP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>")
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)([^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*)*)>""")
_CLASS = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
#: Inline marks of a text, which don't end a slot.
INLINE = frozenset("b i em strong u s small sub sup span font mark abbr code kbd q cite time wbr br ins del".split())
#: What holds no content, as a tag or as a word of class, id or role.
ASIDE_TAGS = frozenset("nav footer aside title a button select option label header menu".split())
ASIDE_NAMES = frozenset("nav navbar navigation menu footer header sidebar breadcrumb breadcrumbs ad ads advert advertisement banner sponsor sponsored cookie cookies promo related share social".split())
#: In these a header heads content, not the page.
SECTIONS = frozenset("article main section".split())
#: Elements whose end may be left out: one of its kind, or its parent's end, ends it.
IMPLIED = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#:@]*@)?([^/?#:]*)", url or "")
    return m[2].lower() if m else ""


def _token(name: str, rest: str) -> str:
    names = sorted({w.lower() for _, v in _CLASS.findall(rest) for w in v.strip("\"'").split() if not any(c.isdigit() for c in w)}) if "=" in rest else []
    return f"<{name}{'.' + '.'.join(names) if names else ''}>"


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Tag tokens with '#' for each text between them, and the texts; inline marks join the text around them.

    So do links, unless all words between the neighbouring tags are in links.
    """
    kinds: list[str] = []
    texts: list[str] = []
    pending: list[str] = []
    # Where in pending links begin and end: (index, token). How many elements were open when the open link began (-1: no link is open), and whether its token is among kinds.
    links: list[tuple[int, str]] = []
    linked, told = -1, False

    def level(parts: list[str]) -> str:
        joined = "".join(parts)
        if "&" in joined:
            joined = html.unescape(joined)
        return " ".join(joined.split())

    def put(parts: list[str]) -> None:
        if joined := level(parts):
            kinds.append("#")
            texts.append(joined)

    def close() -> None:
        nonlocal linked, told
        if links:
            edges = [0, *[i for i, _ in links], len(pending)]
            spans = [pending[i:j] for i, j in zip(edges, edges[1:], strict=False)]
            if any(c.isalnum() for k, span in enumerate(spans) if not k or links[k - 1][1][1] == "/" for c in level(span)):
                put(pending)
                linked = -1  # a link that is part of a text ends with it
            else:
                put(spans[0])
                for (_, token), span in zip(links, spans[1:], strict=True):
                    kinds.append(token)
                    put(span)
                told = linked >= 0
            links.clear()
        else:
            put(pending)
        pending.clear()

    def end_link() -> None:
        nonlocal linked, told
        if linked >= 0:
            if told:
                close()
                kinds.append("</a>")
            else:
                links.append((len(pending), "</a>"))
            linked, told = -1, False

    clean = _SKIP.sub(" ", page)
    open_: list[str] = []
    at = 0
    for m in _TAG.finditer(clean):
        if m.start() > at:
            pending.append(clean[at : m.start()])
        at = m.end()
        slash, name, rest = m.groups()
        name = name.lower()
        if name in INLINE:
            if name in ("br", "wbr"):
                pending.append(" ")
            continue
        if name == "a":
            end_link()
            if not slash:
                links.append((len(pending), _token(name, rest)))
                linked = len(open_)
            continue
        close()
        if slash:
            if name in open_:
                if linked >= 0 and linked > len(open_) - 1 - open_[::-1].index(name):
                    linked, told = -1, False  # an element that ends ends the link in it
                while open_[-1] != name:
                    if (inner := open_.pop()) in IMPLIED:
                        kinds.append(f"</{inner}>")
                open_.pop()
                kinds.append(f"</{name}>")
            elif name not in IMPLIED:
                kinds.append(f"</{name}>")
            continue
        if name not in VOID:
            if name in IMPLIED and open_ and open_[-1] == name:
                kinds.append(f"</{name}>")
            else:
                open_.append(name)
        kinds.append(_token(name, rest))
    pending.append(clean[at:])
    close()
    for inner in reversed(open_):
        if inner in IMPLIED:
            kinds.append(f"</{inner}>")
    return kinds, texts


# A node is a token ('#' or '<...>'), or ['+', nodes] for a repeated and ['?', nodes] for an optional group.
Nodes = list


class _Shapes:
    """Numbers of the shapes of a page's units: equal numbers, equal shapes, however large they are."""

    def __init__(self) -> None:
        self.number: dict[object, int] = {}
        #: Whether a shape begins with something other than a text or an end tag.
        self.opens: list[bool] = []

    def of(self, shape: object, opens: bool) -> int:
        k = self.number.setdefault(shape, len(self.opens))
        if k == len(self.opens):
            self.opens.append(opens)
        return k

    def token(self, t: str) -> int:
        return self.of(t, t != "#" and t[:2] != "</")


def fold(kinds: list[str]) -> tuple[Nodes, list[int]]:
    """Runs of equal neighbouring groups as repeated groups, innermost first; and for each text of the page its slot among the folded nodes'."""
    # A unit is (kind, body, shape): a token with its texts, an element 'E' with its units, or a repeated group '+'.
    n = 0
    shapes = _Shapes()
    stack: list[tuple[str, list]] = [("", [])]
    depth: dict[str, int] = {}
    for t in kinds:
        if t == "#":
            stack[-1][1].append((t, [n], shapes.token(t)))
            n += 1
        elif t[1] != "/":
            name = t[1:-1].partition(".")[0]
            if name in VOID:
                stack[-1][1].append((t, (), shapes.token(t)))
            else:
                stack.append((name, [(t, (), shapes.token(t))]))
                depth[name] = depth.get(name, 0) + 1
        elif depth.get(name := t[2:-1], 0):
            # Elements that are closed become one unit, with their own children folded before them.
            while stack[-1][0] != name:
                other, inner = stack.pop()
                depth[other] -= 1
                stack[-1][1].extend(inner)
            _, inner = stack.pop()
            depth[name] -= 1
            body = [inner[0], *_fold_run(inner[1:], shapes), (t, (), shapes.token(t))]
            stack[-1][1].append(("E", body, shapes.of(("E", *[u[2] for u in body]), True)))
        else:
            stack[-1][1].append((t, (), shapes.token(t)))
    while len(stack) > 1:
        _, inner = stack.pop()
        stack[-1][1].extend(inner)
    return _emitted(_fold_run(stack[0][1], shapes), n)


def _emitted(folded: list[tuple], n: int) -> tuple[Nodes, list[int]]:
    """The units as nodes, and the slot of each of the page's n texts; all instances of a repeated group share slots."""
    slot_of = [0] * n
    slots = 0
    out: Nodes = []
    # Work to go on with: units that are being written to nodes, and groups whose instances are gone through one by one.
    work: list[list] = [["units", iter(folded), out]]
    while work:
        job = work[-1]
        if job[0] == "group":
            _, body, k, first, last = job
            last = max(last, slots)
            if k < len(body):
                job[2:] = [k + 1, first, last]
                slots = first
                work.append(["units", iter(body[k]), []])
            else:
                slots = last
                work.pop()
            continue
        for kind, body, _ in job[1]:
            if kind == "E":
                work.append(["units", iter(body), job[2]])
                break
            if kind == "+":
                inner: Nodes = []
                job[2].append(["+", inner])
                work += [["group", body, 1, slots, slots], ["units", iter(body[0]), inner]]
                break
            job[2].append(kind)
            if kind == "#":
                for t in body:
                    slot_of[t] = slots
                slots += 1
        else:
            work.pop()
    return out, slot_of


def _fold_run(units: list[tuple], shapes: _Shapes) -> list[tuple]:
    """Neighbouring groups of units that repeat, as one repeated group; groups of any width, narrow ones first."""
    width, ids = 1, None
    while 2 * width <= len(units):
        if ids is None:
            ids = [u[2] for u in units]
            if len(set(ids)) == len(units) or not any(shapes.opens[k] for k in ids):
                return units
        # Two neighbouring groups hold a multiple of the width and the place one width after it: most widths end here.
        if not any(map(int.__eq__, ids[::width], ids[width::width])):
            width += 1
            continue
        x = np.array(ids)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[width:] == x[:-width], [False]]).astype(np.int8)))
        out: list[tuple] = []
        done = 0
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            first = max(first, done)
            if last - first < width or (width == 1 and units[first][0] == "+") or not any(shapes.opens[k] for k in ids[first : first + width]):
                continue
            end = first + (last - first) // width * width + width
            out += units[done:first]
            out.append(("+", [units[k : k + width] for k in range(first, end, width)], shapes.of(("+", *ids[first : first + width]), True)))
            done = end
        if out:
            units, ids = out + units[done:], None
        width += 1
    return units


def _events(nodes: Nodes) -> Iterator[object]:
    """The nodes in order, groups as '(', their nodes, and ')+' or ')?'."""
    work: list[tuple[Iterator, str]] = [(iter(nodes), "")]
    while work:
        for x in work[-1][0]:
            if isinstance(x, list):
                yield "("
                work.append((iter(x[1]), f"){x[0]}"))
                break
            yield x
        else:
            if mark := work.pop()[1]:
                yield mark


def _nested(events: Iterator[object]) -> Nodes:
    """What ``_events`` came from."""
    stack: list[Nodes] = [[]]
    for x in events:
        if x == "(":
            stack.append([])
        elif isinstance(x, str) and x[0] == ")":
            inner = stack.pop()
            stack[-1].append([x[1], inner])
        else:
            stack[-1].append(x)
    return stack[0]


#: Bits of a table of an alignment's rows that are kept; of larger ones every so many rows, and the others are made again.
_TABLE_BITS = 1 << 26


def _common(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Alignment of two sequences along a longest common subsequence: (place in a, place in b), None where one has nothing.

    Rows of the table are bit vectors (a bit for each place of b, zero where a
    longer subsequence begins), so a row costs a few operations on long numbers.
    """
    n, m = len(a), len(b)
    mask = (1 << m) - 1
    where: dict[object, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << (m - 1 - j)

    def row(below: int, x: object) -> int:
        u = below & where.get(x, 0)
        return ((below + u) | (below - u)) & mask

    every = max(1, int((n * m / _TABLE_BITS) ** 0.5 + 0.5)) if n * m > _TABLE_BITS else 1
    kept = {n: mask}
    v = mask
    for i in range(n - 1, -1, -1):
        v = row(v, a[i])
        if i % every == 0:
            kept[i] = v
    block: dict[int, int] = {}

    def vector(i: int) -> int:
        if i in kept:
            return kept[i]
        if i not in block:
            block.clear()
            top = min(n, (i // every + 1) * every)
            x = kept[top]
            for k in range(top - 1, i // every * every, -1):
                x = block[k] = row(x, a[k])
        return block[i]

    steps: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            steps.append((i, j))
            i, j = i + 1, j + 1
            continue
        if j >= m:
            down = True
        elif i >= n:
            down = False
        else:
            rest = (1 << (m - j)) - 1
            down = (vector(i) & rest).bit_count() == (vector(i + 1) & rest).bit_count()
        if down:
            steps.append((i, None))
            i += 1
        else:
            steps.append((None, j))
            j += 1
    return steps


class Wrapper:
    """A union-free expression that grows by alignment; each of its slots has a number that never changes."""

    def __init__(self, nodes: Nodes):
        self.count = 0
        self.nodes = self._number(nodes)[0]

    def _number(self, nodes: Nodes) -> tuple[Nodes, list[int]]:
        """nodes with each '#' as a number of its own, and those numbers."""
        first = self.count
        out = _nested(self._next() if x == "#" else x for x in _events(nodes))
        return out, list(range(first, self.count))

    def _next(self) -> int:
        self.count += 1
        return self.count - 1

    @staticmethod
    def _kind(x: object) -> object:
        """What a node can stand for: nodes of one kind match."""
        if isinstance(x, list):
            return x[0], Wrapper._first(x[1])
        return "#" if isinstance(x, int) else x

    @staticmethod
    def _first(nodes: Nodes) -> object:
        while nodes and isinstance(nodes[0], list):
            nodes = nodes[0][1]
        return "#" if not nodes or isinstance(nodes[0], int) or nodes[0] == "#" else nodes[0]

    def absorb(self, page: Nodes) -> list[int]:
        """Generalises to also match page; the wrapper's slot of each of its slots."""
        # Alignments inside groups are asked for by those around them.
        work, value = [self._align(self.nodes, page)], None
        while work:
            try:
                inner = work[-1].send(value)
            except StopIteration as done:
                work.pop()
                value = done.value
            else:
                work.append(self._align(*inner))
                value = None
        self.nodes, slots = value
        return slots

    def _instances(self, want: list, page: list, at: int) -> int:
        """Kinds of page from at on that are one instance of a repeated group, or 0."""
        return len(want) if want and page[at : at + len(want)] == want else 0

    def _align(self, wrapper: Nodes, page: Nodes) -> Generator[tuple[Nodes, Nodes], tuple[Nodes, list[int]], tuple[Nodes, list[int]]]:
        # Single instances of the wrapper's repeated groups are wrapped first, and the other way round.
        page = self._wrap(page, [g for g in wrapper if isinstance(g, list) and g[0] == "+"])
        flat: list[tuple[object, int | None]] = []  # nodes, with the number of the optional group they stand in
        for k, n in enumerate(wrapper):
            if isinstance(n, list) and n[0] == "?":
                flat += [(x, k) for x in n[1]]
            else:
                flat.append((n, None))
        a, b = [self._kind(x) for x, _ in flat], [self._kind(x) for x in page]
        # Common head and tail first: streams of one host differ in the middle.
        lo = 0
        while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        middle = _common(a[lo : len(a) - hi], b[lo : len(b) - hi])
        steps: list[tuple[int | None, int | None]] = [(k, k) for k in range(lo)]
        steps += [(None if w is None else lo + w, None if p is None else lo + p) for w, p in middle]
        steps += [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]
        # Neighbours with one mark are optional together: pages have all of them or none.
        out: list[tuple[object, object]] = []
        slots: list[int] = []
        for w, p in steps:
            if p is None:
                out.append((flat[w][0], ("without", flat[w][1])))
            elif w is None:
                new, mine = self._number([page[p]])
                slots += mine
                out.append((new[0], "new"))
            else:
                node, group = flat[w]
                if isinstance(node, int):
                    slots.append(node)
                elif isinstance(node, list):
                    inner, mine = yield node[1], page[p][1]
                    slots += mine
                    node = ["+", inner]
                out.append((node, None if group is None else ("with", group)))
        grouped: Nodes = []
        last: object = None
        for node, mark in out:
            if mark is None:
                grouped.append(node)
            elif mark == last:
                grouped[-1][1].append(node)
            else:
                grouped.append(["?", [node]])
            last = mark
        return grouped, slots

    def _wrap(self, page: Nodes, groups: list) -> Nodes:
        """page with unrepeated instances of the groups as repeated groups of one."""
        wanted: dict[object, list[list]] = {}
        for g in groups:
            want = [self._kind(x) for x in g[1] if not (isinstance(x, list) and x[0] == "?")]
            if want:
                wanted.setdefault(want[0], []).append(want)
        if not wanted:
            return page
        kinds = [self._kind(x) for x in page]
        out: Nodes = []
        at = 0
        while at < len(page):
            size = next((k for want in wanted.get(kinds[at], ()) if (k := self._instances(want, kinds, at))), 0)
            if size:
                out.append(["+", page[at : at + size]])
                at += size
            else:
                out.append(page[at])
                at += 1
        return out

    def text(self) -> str:
        """The expression: tags as they are, #PCDATA for slots, (...)+ and (...)? for groups."""
        parts: list[str] = []
        for x in _events(self.nodes):
            if parts and parts[-1] != "(" and not (isinstance(x, str) and x[0] == ")"):
                parts.append(" ")
            parts.append("#PCDATA" if isinstance(x, int) else x)
        return "".join(parts)

    def asides(self) -> list[bool]:
        """For each slot, whether it stands in something that holds no content."""
        out = [False] * self.count
        path: list[tuple[str, bool]] = []
        opened: dict[str, int] = {}
        inside = sections = 0
        for n in _events(self.nodes):
            if isinstance(n, int):
                out[n] = inside > 0
            elif n[0] != "<":
                continue
            elif n.startswith("</"):
                name = n[2:-1]
                while opened.get(name, 0):
                    other, aside = path.pop()
                    opened[other] -= 1
                    inside -= aside
                    sections -= other in SECTIONS
                    if other == name:
                        break
            else:
                name, *names = n[1:-1].split(".")
                if name not in VOID:
                    aside = any(x in group and not (sections and x == "header") for group, own in ((ASIDE_TAGS, [name]), (ASIDE_NAMES, names)) for x in own)
                    path.append((name, aside))
                    opened[name] = opened.get(name, 0) + 1
                    inside += aside
                    sections += name in SECTIONS
        return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "host", "sig", "nodes", "slot", "texts"]
    for batch in batches:
        rows: list[tuple] = []
        for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kinds, texts = tokens(page or "")
            nodes, slot_of = fold(kinds)
            plain = json.dumps(list(_events(nodes)), separators=(",", ":"))
            rows.append((page_id, host_of(url), hashlib.md5(plain.encode()).hexdigest(), plain, slot_of, texts))
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.column(0).type), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.list_(pa.int32())), pa.array(c[5], pa.list_(pa.string()))], names=names)


def induce(streams: list[Nodes]) -> tuple[Wrapper, list[list[int]]]:
    """The wrapper of a host from its distinct streams, the commonest first; and the wrapper's slot of each slot of each stream."""
    wrapper = Wrapper([])
    wrapper.nodes, slots = wrapper._number(streams[0])
    maps = [slots]
    for nodes in streams[1:]:
        maps.append(wrapper.absorb(nodes))
    return wrapper, maps


def _induce_host(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pages", "sig"], ascending=[False, True])
    wrapper, maps = induce([_nested(json.loads(x)) for x in pdf["nodes"]])
    aside = wrapper.asides()
    return pd.DataFrame({"host": pdf["host"], "sig": pdf["sig"], "slot_map": maps, "aside": [[aside[s] for s in m] for m in maps], "wrapper": wrapper.text()})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, host, wrapper_id, n_fields, content for every page.

    wrapper_id is the hash of the host's wrapper; content joins by line the texts
    of data slots outside navigation, advertisements and the like.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    streams, _ = materialise(pages.select("page_id", "url", "html").mapInArrow(_streams, f"page_id {kind}, host string, sig string, nodes string, slot array<int>, texts array<string>"))
    shapes = streams.groupBy("host", "sig").agg(F.first("nodes").alias("nodes"), F.count(F.lit(1)).alias("pages"))
    induced, size = materialise(shapes.groupBy("host").applyInPandas(_induce_host, "host string, sig string, slot_map array<int>, aside array<boolean>, wrapper string"))
    maps = induced.select("host", "sig", "slot_map", "aside", F.md5("wrapper").alias("wrapper_id"))
    placed = streams.drop("nodes").join(sized(maps, size), ["host", "sig"])
    # Each text with the slot of the wrapper that it fills.
    fields = F.transform(F.arrays_zip("slot", "texts"), lambda x: F.struct(F.element_at("slot_map", x["slot"] + 1).alias("at"), F.element_at("aside", x["slot"] + 1).alias("aside"), x["texts"].alias("text")))
    filled = placed.select("page_id", "host", "wrapper_id", fields.alias("fields"), F.xxhash64("sig", "texts").alias("print"))
    # A slot once for each page and text in it: with one text, its rows are its pages.
    each = F.array_distinct(F.transform("fields", lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["text"]).alias("h"))))
    flat = filled.select("host", F.explode(each).alias("f")).select("host", "f.at", "f.h")
    seen = flat.groupBy("host", "at").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo = hi and n > 1")
    hosts = filled.where(F.size("fields") > 0).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("print").alias("first"), F.max("print").alias("last")).where("first <> last")
    fixed, fixed_size = materialise(seen.join(hosts, "host").where("n = pages").groupBy("host").agg(F.sort_array(F.collect_set("at")).alias("fixed")).withColumnRenamed("host", "f_host"))
    with_fixed = filled.join(sized(fixed, fixed_size), F.col("host") == F.col("f_host"), "left")
    none = F.array().cast("array<int>")
    data = F.filter("fields", lambda x: ~F.array_contains(F.coalesce("fixed", none), x["at"]))
    content = F.filter(data, lambda x: ~x["aside"])
    return with_fixed.select("page_id", "host", "wrapper_id", F.size(data).alias("n_fields"), F.array_join(F.transform(content, lambda x: x["text"]), "\n").alias("content"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
