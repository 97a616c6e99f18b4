"""Repeated passages by a suffix array with its common-prefix interval tree.

A maximal repeat of MIN_WORDS words or more is an interval of the sorted
suffixes whose members don't all have the same word before them. All members of
an interval share their first MIN_WORDS words, so the suffix array is cut by the
hash of those words (128 bits of it) and each part is sorted and scanned for
itself. Texts of the same words are one text, whose copies come back in the
result. Two sieves by 64-bit hashes come first. Winnowing marks, in every
MIN_WORDS words, at least one run of ANCHOR_WORDS words by content alone, so a
repeat has marks that repeat; and of the positions near such marks only those
count whose MIN_WORDS words are found after different words (or at the head of a
text), for no interval below the others can be left-maximal. Both are asked for
by chunks of texts (see exchange). Suffixes go to their parts by the least run in
their head, so that those of one text that overlap travel together and compress.

Suffixes inside a run (words with a period under MIN_WORDS) are all there, but
short: words with a period come as the number of words that go on with it, in
levels, for what is known of a suffix may have other periods first. Suffixes
sorted by these numbers stand together as their common prefixes need it, and the
lengths of those follow from the numbers. What comes after a run goes only with
positions that go on as long as some run from its begin.

The scan keeps the open intervals of the enhanced suffix array on a stack: it
closes those deeper than the common prefix of the next suffix, and gives each
closed one whose left extensions differ, with all its occurrences.

A word is a run of bytes other than ASCII white space; words are compared by
their bytes, white space between them isn't. Cases: null, empty and short texts
have no repeats; rows that repeat a doc_id and the words of its text are one
document; a null doc_id is a document as any other; doc_id may be of any type
(integers come back as long); an empty table gives an empty result; further
columns are not read. ``repeated_passages`` gives lists, in which the occurrences
in one run are one item; a long one is spread over several rows of one group_id.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from .common import materialise, read
from .exchange import BLOBS, CHUNK_BYTES, Packer, Unpacker, blobs, bounds, opened, parts_for, text_bytes, with_answers, write_chunks
from .kernels import mix, range_sum, slices, window_hash, words

MIN_WORDS = 50
ANCHOR_WORDS = 25
#: Occurrences in a row of the result.
ROW_OCCURRENCES = 1 << 16

_MAX = ~np.uint64(0)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every window of width values; len(x) - width + 1 of them."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, row_at: np.ndarray, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed runs of k words of all rows: where each begins (index into h), and its hash.

    Every min_words words of a row hold one whole, chosen by content alone.
    """
    width = min_words - k + 1
    g = window_hash(h, k)
    if len(g) < width:
        return np.zeros(0, np.int64), g[:0]
    low = _sliding(g, width, np.minimum)
    ends = np.repeat(row_at[1:], np.diff(row_at))[: len(low)]
    low[np.arange(len(low)) + min_words > ends] = 0
    # A run is marked if it is the least of any window that holds it, i.e. equals the largest of those windows' least.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    best = _sliding(padded, width, np.maximum)
    at = np.flatnonzero((best[: len(g)] == g) & (best[: len(g)] > 0))
    return at, g[at]


def _runs(h: np.ndarray, head: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """For positions of a text with words h: at the first one of a run how many words it goes on, inside it as many less than zero, else 0.

    A run has one period, under min_words, so that heads in it come again before
    they end. Inside are positions whose head comes a period before and after.
    """
    rest = np.zeros(len(at), np.int32)
    order = np.lexsort((at, head))
    hs, ps = head[order], at[order].astype(np.int64)
    gap = np.where(hs[1:] == hs[:-1], np.minimum(np.diff(ps), min_words), min_words)
    near = np.flatnonzero(gap < min_words)
    for p in np.unique(gap[near]):
        these = near[gap[near] == p]
        breaks = np.append(np.flatnonzero(h[p:] != h[:-p]) + p, len(h))
        goes_on = breaks[np.searchsorted(breaks, ps[these] + p)] - ps[these]
        begins = (ps[these] == 0) | (h[np.maximum(ps[these] - 1, 0)] != h[ps[these] - 1 + p])
        again = (these > 0) & (gap[np.maximum(these - 1, 0)] == p)
        rest[order[these]] = np.where(begins, goes_on, np.where(again, -goes_on, 0))
    return rest


def _period(words: list[bytes], under: int) -> int:
    """The least period of the words that is less than under, or 0."""
    n, p = len(words), 0
    while True:
        try:
            p = words.index(words[0], p + 1, under)
        except ValueError:
            return 0
        if words[p:] == words[: n - p]:
            return p


class _Extents:
    """How far periods go on in a text."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts
        self.codes: np.ndarray | None = None
        self.breaks: dict[int, np.ndarray] = {}

    def end(self, at: int, period: int) -> int:
        """The first position from at on whose word isn't the one a period before."""
        parts, n = self.parts, len(self.parts)
        for i in range(at, min(at + 64, n)):
            if parts[i] != parts[i - period]:
                return i
        if period not in self.breaks:
            if self.codes is None:
                known: dict[bytes, int] = {}
                self.codes = np.array([known.setdefault(w, len(known)) for w in parts], np.int64)
            self.breaks[period] = np.append(np.flatnonzero(self.codes[period:] != self.codes[:-period]) + period, n)
        return int(self.breaks[period][np.searchsorted(self.breaks[period], at)])

    def levels(self, at: int, min_words: int) -> tuple[bytes, int, int, int]:
        """How the suffix at a position begins, where that ends, and where its last run ends and with which period (0, 0 without).

        While what is known of it has a period under min_words, a level tells how many
        words go on with that and the word after them: suffixes that share a level's
        words but not their number part at the smaller number. By Fine and Wilf a
        level of 2 * min_words or more is the last.
        """
        out, to, run, period = b"", at + min_words, 0, 0
        while to - at <= 2 * min_words and (p := _period(self.parts[at:to], min_words)):
            run, period = self.end(to, p), p
            out += b"\x01" + (run - at).to_bytes(4, "big")
            if run == len(self.parts):
                return out, run, run, period
            out += self.parts[run] + b" "
            to = run + 1
        return out + b"\x00", to, run, period


class _Texts:
    """The texts of a chunk that count: one of those of the same words, with all their doc_ids if there are several."""

    def __init__(self, data: bytes, answers: list[dict] | None):
        docs = opened(data)
        self.answers = answers or []
        notes = [a for a in self.answers if a["step"] == 0]
        gone = {a["row"] for a in notes if a["ids"] is None}
        rows = np.array([r for r in range(docs.num_rows) if r not in gone], np.int64)
        self.copies = {int(np.searchsorted(rows, a["row"])): (a["copy_of"], a["ids"]) for a in notes if a["ids"] is not None}
        self.docs = docs.take(pa.array(rows)) if gone else docs
        hashes, at, ends = [np.zeros(0, np.uint64)], 0, [np.zeros(1, np.int64)]
        for s in slices(self.docs.column("text")):
            w = words(s)
            hashes.append(w.hash)
            ends.append(at + w.row_at[1:])
            at += len(w.hash)
        self.h, self.row_at = np.concatenate(hashes), np.concatenate(ends)

    def read(self, step: int) -> Iterator[Unpacker]:
        for a in sorted((a for a in self.answers if a["step"] == step), key=lambda a: a["part"]):
            yield Unpacker(a["data"])

    def bits(self, step: int, which: int = 0) -> np.ndarray:
        """The answers to the chunk's keys, of which there are so many for each part."""
        out = [np.zeros(0, np.uint8)]
        for u in self.read(step):
            fields = [u.raw("u1") for _ in range(which + 1)]
            out.append(fields[which])
        return np.concatenate(out)


class _Marks:
    """The marks of a chunk's texts, as keys to ask about: ascending hashes, with how often each comes."""

    def __init__(self, t: _Texts, min_words: int, k: int):
        at, g = anchors(t.h, t.row_at, min_words, k)
        self.keys, self.n = np.unique(mix(g), return_counts=True)


class _Heads:
    """Positions of a chunk whose first words hold a repeated mark as their least run."""

    def __init__(self, t: _Texts, marks: _Marks, min_words: int, k: int):
        width = min_words - k + 1
        g = window_hash(t.h, k)
        low = mix(_sliding(g, width, np.minimum)) if len(g) >= width else g[:0]
        ends = np.repeat(t.row_at[1:], np.diff(t.row_at))
        whole = np.arange(len(low)) + min_words <= ends[: len(low)]
        repeated = marks.keys[t.bits(1) > 0]
        self.at = np.flatnonzero(whole & _among(low, repeated))
        self.mark = low[self.at]
        self.head = window_hash(t.h, min_words)[self.at]
        self.row = np.searchsorted(t.row_at, self.at, side="right") - 1
        first = t.row_at[self.row]
        self.before = np.where(self.at > first, t.h[np.maximum(self.at - 1, 0)] | np.uint64(1), np.uint64(0))
        self.rest = np.zeros(len(self.at), np.int32)
        order = np.lexsort((self.head, self.row))
        again = (self.head[order][1:] == self.head[order][:-1]) & (self.row[order][1:] == self.row[order][:-1])
        for r in np.unique(self.row[order][1:][again]):
            a, b = np.searchsorted(self.row, [r, r + 1])
            begin, end = t.row_at[r], t.row_at[r + 1]
            self.rest[a:b] = _runs(t.h[begin:end], self.head[a:b], (self.at[a:b] - begin).astype(np.int32), min_words)
        self.keys, self.place = np.unique(self.head, return_inverse=True)
        # A run's first position tells how long it is; the places inside other runs ask for runs of just the length that is left to them.
        told = np.flatnonzero(self.rest)
        runs = mix(self.head[told] + np.abs(self.rest[told]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.run_keys, self.run_place = np.unique(runs, return_inverse=True)
        self.told = told

    def ask(self, parts: int) -> list[tuple[int, bytes]]:
        n = np.bincount(self.place, minlength=len(self.keys))
        lo, hi = np.full(len(self.keys), _MAX), np.zeros(len(self.keys), np.uint64)
        np.minimum.at(lo, self.place, self.before)
        np.maximum.at(hi, self.place, self.before)
        first = np.zeros(len(self.run_keys), np.uint8)
        first[self.run_place[self.rest[self.told] > 0]] = 1
        kind = ((n > 1) + 2 * (lo != hi)).astype(np.uint8)
        at, to = bounds(self.keys, parts), bounds(self.run_keys, parts)
        return [
            (p, Packer().keys(self.keys[at[p] : at[p + 1]]).raw(kind[at[p] : at[p + 1]], "u1").raw(lo[at[p] : at[p + 1]], "<u8").keys(self.run_keys[to[p] : to[p + 1]]).raw(first[to[p] : to[p + 1]], "u1").done())
            for p in range(parts)
            if at[p] < at[p + 1] or to[p] < to[p + 1]
        ]

    def starts(self, t: _Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which positions repeat, which of them begin suffixes of the array, and which of those matter past the end of their run.

        Inside a run all have the same word before them: past its end only those can
        be in a left-maximal repeat that go on as long as some run from its begin.
        """
        repeated, diverse, runs = t.bits(2)[self.place] > 0, t.bits(2, 1)[self.place] > 0, t.bits(2, 2)
        past = self.rest >= 0
        past[self.told] |= runs[self.run_place] > 0
        return repeated, repeated & diverse, past


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ascending keys."""
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def _prints(min_words: int):
    """For chunks, the texts of min_words words or more: two hashes of all their words, their rows, their doc_ids."""

    def notes(docs: pa.Table) -> list[pa.Array]:
        one, two, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in slices(docs.column("text")):
            w = words(s)
            long = np.flatnonzero(np.diff(w.row_at) >= min_words)
            for out, h in ((one, w.hash), (two, mix(w.hash ^ np.uint64(0x5851F42D4C957F2D)))):
                out.append(range_sum(h, w.row_at[long], w.row_at[long + 1]))
            rows.append(s.first + long)
        h1, h2, row = np.concatenate(one), np.concatenate(two), np.concatenate(rows)
        ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], docs.column("doc_id").type)
        ids = ids.take(pa.array(row)) if not isinstance(ids, pa.ChunkedArray) else pa.concat_arrays(ids.chunks).take(pa.array(row))
        lists = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(row.astype(np.int32)), ids]
        return [pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), x) for x in lists]

    return notes


_ANSWERS = BLOBS


def _reply(table: pa.Table, made: list[bytes]) -> pa.Table:
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "data": pa.array(made, pa.binary())})


def _merge_marks(table: pa.Table) -> pa.Table:
    """Answers each chunk which of its marks come more than once."""
    keys, n = zip(*((u.keys(), u.numbers().astype(np.int64)) for u in map(Unpacker, table.column("data").to_pylist())), strict=True)
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    often = (np.bincount(place, np.concatenate(n)) > 1)[place]
    ends = np.cumsum([len(k) for k in keys])
    return _reply(table, [Packer().raw(often[e - len(k) : e], "u1").done() for k, e in zip(keys, ends, strict=True)])


def _merge_heads(table: pa.Table) -> pa.Table:
    """Answers each chunk which of its heads come more than once, which after different words or at the head of a text, and which runs there are."""
    keys, kind, left, run_keys, first = zip(*((u.keys(), u.raw("u1"), u.raw("<u8"), u.keys(), u.raw("u1")) for u in map(Unpacker, table.column("data").to_pylist())), strict=True)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    kinds, lefts = np.concatenate(kind), np.concatenate(left)
    times = np.bincount(place, 1 + (kinds & 1), minlength=len(distinct))
    lo, hi = np.full(len(distinct), _MAX), np.zeros(len(distinct), np.uint64)
    np.minimum.at(lo, place, lefts)
    np.maximum.at(hi, place, lefts)
    differ = (lo != hi) | (lo == 0) | (np.bincount(place, kinds & 2, minlength=len(distinct)) > 0)
    runs, run_place = np.unique(np.concatenate(run_keys), return_inverse=True)
    known = np.zeros(len(runs), np.uint8)
    known[run_place[np.concatenate(first) > 0]] = 1
    again, diverse, known = (times > 1)[place], differ[place], known[run_place]
    made, a, b = [], 0, 0
    for k, r in zip(keys, run_keys, strict=True):
        made.append(Packer().raw(again[a : a + len(k)], "u1").raw(diverse[a : a + len(k)], "u1").raw(known[b : b + len(r)], "u1").done())
        a, b = a + len(k), b + len(r)
    return _reply(table, made)


def _each_chunk(ask):
    """ask(texts) for every chunk with its answers; what it gives goes to the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = _Texts(batch.column(1)[i].as_buffer(), batch.column(2)[i].as_py())
                yield from blobs(batch.column(0)[i].as_py(), ask(t)).to_batches()

    return run


def _suffix_rows(min_words: int, k: int, kind: pa.DataType):
    """The suffixes at the starts, without their first min_words words (which the heads stand for), to where nothing repeats any more.

    Of words with a period come only the numbers (see ``_Extents.levels``), so that
    the suffixes of a long run are short.

    A text that has copies also gives its doc_ids to each part its suffixes go to
    (rows without a head, which come first there).
    """
    names = ["mark", "head", "check", "suffix", "doc_id", "at", "before", "copy_of", "words", "ids", "run", "step"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), kind, pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.list_(kind), pa.string(), pa.int32()]

    def out(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of_chunk(batch.column(0)[i].as_py(), _Texts(batch.column(1)[i].as_buffer(), batch.column(2)[i].as_py()))

    def of_chunk(chunk: int, t: _Texts) -> Iterator[pa.RecordBatch]:
        heads = _Heads(t, _Marks(t, min_words, k), min_words, k)
        repeated, starts, past = heads.starts(t)
        cols: list[list] = [[] for _ in names]
        size = 0
        texts, ids = t.docs.column("text"), t.docs.column("doc_id")
        g = window_hash(t.h, k)
        whole = window_hash(t.h, min_words)
        for r in sorted({*np.unique(heads.row[starts]).tolist(), *t.copies}):
            begin, end = int(t.row_at[r]), int(t.row_at[r + 1])
            a, b = np.searchsorted(heads.row, [r, r + 1])
            mine = np.arange(a, b)[starts[a:b]]
            at, head, mark = (heads.at[mine] - begin).tolist(), heads.head[mine].view(np.int64).tolist(), heads.mark[mine].view(np.int64).tolist()
            on = past[mine].tolist()
            parts = texts[r].as_py().encode().split()
            copy_of, others = t.copies.get(r, (None, None))
            if others is not None and not (at and at[0] == 0):
                at.insert(0, 0)
                on.insert(0, True)
                head.insert(0, int(whole[begin].view(np.int64)))
                mark.insert(0, int(mix(g[begin : begin + min_words - k + 1].min(keepdims=True)).view(np.int64)[0]))
            flat = b" ".join(parts) + b" "
            offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
            inside = np.zeros(end - begin + 1, dtype=bool)
            inside[heads.at[a:b][repeated[a:b]] - begin] = True
            gaps = np.flatnonzero(~inside)
            doc, told, extents = ids[r].as_py(), set(), _Extents(parts)
            for p, h, m, goes_past in zip(at, head, mark, on, strict=True):
                suffix, tail, end, period = extents.levels(p, min_words)
                stop = max(tail, int(gaps[np.searchsorted(gaps, p)]) + min_words - 1)
                if goes_past:
                    suffix += flat[offset[tail] : offset[stop]]
                else:  # the number of words of its last level is the last that counts
                    suffix = suffix[: -2 - len(parts[end])] if end < len(parts) else suffix
                check = int.from_bytes(hashlib.blake2b(flat[offset[p] : offset[p + min_words]], digest_size=8).digest(), "little", signed=True)
                run = f"{chunk}-{r}-{end}-{period}" if period else None
                row = (m, h, check, suffix, doc, p, parts[p - 1] if p else None, copy_of, len(parts) if copy_of is not None and not p else None, None, run, period)
                if copy_of is not None and m not in told:
                    told.add(m)
                    for c, v in zip(cols, (m, None, None, None, None, None, None, copy_of, None, others, None, None), strict=True):
                        c.append(v)
                    size += 8 * len(others)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                size += len(suffix) + 100
                if size > 4 << 20:
                    yield out(cols)
                    cols, size = [[] for _ in names], 0
        if cols[0]:
            yield out(cols)

    return run


def common_words(a: bytes, b: bytes, begin: int = 0) -> int:
    """Whole words (each with a space after it) that are in common from begin on, where a and b are the same before."""
    lo, hi = begin, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return a.count(b" ", begin, hi)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return a.count(b" ", begin, lo)


def common_prefix(a: bytes, b: bytes, shared: int) -> int:
    """Words that two suffixes begin with in common, by their levels and the words after those; the first ones, shared in number, they don't hold."""
    i = 0
    while i < len(a) and i < len(b):
        if not a[i]:
            return shared + common_words(a, b, i + 1)
        one, two = int.from_bytes(a[i + 1 : i + 5], "big"), int.from_bytes(b[i + 1 : i + 5], "big")
        if one != two:
            return min(one, two)
        shared, i = one, i + 5
        to = a.find(b" ", i) + 1
        if not to or a[i:to] != b[i:to]:
            return shared
        shared, i = shared + 1, to
    return shared


#: Left extensions that differ; the head of a text differs from everything.
_DIVERSE = object()


def _join(a: object, b: object) -> object:
    return a if a is not _DIVERSE and b is not _DIVERSE and a == b else _DIVERSE


def intervals(suffixes: Iterator[tuple[bytes, object, int | None]], shared: int) -> Iterator[tuple[int, int, int]]:
    """(words, first, last) of each left-maximal interval of sorted (suffix, word before it or None at a text's head, words of a text that has copies).

    All suffixes have their first words in common, shared in number, and come
    without them. A text that has copies is an interval by itself.
    """
    stack: list[list] = []  # depth, first suffix, left extension
    previous, i, left_of_previous = None, -1, None
    for i, (suffix, before, copied) in enumerate(suffixes):  # noqa: B007
        left = _DIVERSE if before is None else before
        if previous is not None:
            depth = common_prefix(previous, suffix, shared)
            first, ext = i - 1, left_of_previous
            while stack and stack[-1][0] > depth:
                d, first, own = stack.pop()
                ext = _join(own, ext)
                if ext is _DIVERSE:
                    yield d, first, i - 1
            if stack and stack[-1][0] == depth:
                stack[-1][2] = _join(stack[-1][2], ext)
            else:
                stack.append([depth, first, ext])
        if copied is not None:
            if stack and stack[-1][0] == copied:
                stack[-1][2] = _DIVERSE
            else:
                stack.append([copied, i, _DIVERSE])
        previous, left_of_previous = suffix, left
    ext = left_of_previous
    while stack:
        d, first, own = stack.pop()
        ext = _join(own, ext)
        if ext is _DIVERSE:
            yield d, first, i


class _Passage:
    """An interval: its number and words, its first suffix, how many occurrences it has, the suffixes that are in no longer passage, and (for lists) all its runs."""

    __slots__ = ("k", "n", "first", "last", "times", "own", "runs")

    def __init__(self, k: int, n: int, first: int, last: int, inner: list[_Passage], entries: list[tuple]):
        self.k, self.n, self.first, self.last, self.own, at = k, n, first, last, [], first
        for p in inner:
            self.own.extend(range(at, p.first))
            at = p.last + 1
        self.own.extend(range(at, last + 1))
        self.times = sum(p.times for p in inner) + sum(len(entries[i][0]) for i in self.own)

    def gather(self, inner: list[_Passage], entries: list[tuple]) -> None:
        """By run, or by suffix where there is none: doc_ids, first and last position, period. Takes those of the inner passages."""
        self.runs = max((p.runs for p in inner), key=len, default={})
        more = [(key, x) for p in inner if p.runs is not self.runs for key, x in p.runs.items()]
        more += [(entries[i][2] or i, (entries[i][0], entries[i][1], entries[i][1], entries[i][3])) for i in self.own]
        for key, (docs, lo, hi, step) in more:
            _, first, last, _ = self.runs.get(key, (docs, lo, hi, step))
            self.runs[key] = (docs, min(lo, first), max(hi, last), step)


def _groups(min_words: int, kind: pa.DataType, tree: bool):
    """Passages as trees (each suffix once, with the longest passage it begins) or with lists of all occurrences."""
    lists = {"group_id": pa.string(), "n_words": pa.int64(), "n_occurrences": pa.int64(), "doc_ids": pa.list_(kind), "word_at": pa.list_(pa.int32()), "step": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
    each = {"group_id": pa.string(), "within": pa.string(), "n_words": pa.int64(), "n_occurrences": pa.int64(), "doc_id": kind, "word_at": pa.int32(), "longer": pa.bool_()}
    fields = each if tree else lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        copies: dict[int, list] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(1, 12)), strict=True):
                    if row[0] is None:
                        copies[row[6]] = row[8]
                    else:
                        yield row

        waiting = None
        source = rows()

        def of_head(first: tuple) -> Iterator[tuple[bytes, object, int | None]]:
            """Suffixes with the head of the first row; leaves the next head's first row waiting."""
            nonlocal waiting
            row = first
            while row is not None and row[:2] == first[:2]:
                entries.append(([row[3]] if row[6] is None else copies[row[6]], row[4], row[9], row[10]))
                yield row[2], row[5], row[7]
                row = next(source, None)
            waiting = row

        out: list[tuple] = []
        size = 0

        def put(p: _Passage, name: str, outer: _Passage | None) -> None:
            nonlocal size
            group = f"{name}-{p.k}"
            if tree:
                within = f"{name}-{outer.k}" if outer else None
                shown = [(d, entries[i][1]) for i in p.own for d in entries[i][0]]
                out.extend((group, within, p.n, p.times, d, at, False) for d, at in shown)
                if not shown:
                    out.append((group, within, p.n, p.times, entries[p.first][0][0], entries[p.first][1], True))
                size += len(shown) + 1
                return
            found = [(d, lo, step if hi > lo else 0, (hi - lo) // step + 1 if hi > lo else 1) for docs, lo, hi, step in p.runs.values() for d in docs]
            for lo in range(0, len(found), ROW_OCCURRENCES):
                some = found[lo : lo + ROW_OCCURRENCES]
                out.append((group, p.n, p.times, *map(list, zip(*some, strict=True))))
                size += len(some)

        row = next(source, None)
        while row is not None:
            entries.clear()
            name = f"{row[0] & 0xFFFFFFFFFFFFFFFF:016x}{row[1] & 0xFFFFFFFFFFFFFFFF:016x}"
            open_ones: list[_Passage] = []
            for k, (n, first, last) in enumerate(intervals(of_head(row), min_words)):
                at = len(open_ones)
                while at and open_ones[at - 1].first >= first:
                    at -= 1
                inner = open_ones[at:]
                del open_ones[at:]
                p = _Passage(k, n, first, last, inner, entries)
                for x in inner if tree else ():
                    put(x, name, p)
                if not tree:
                    p.gather(inner, entries)
                    put(p, name, None)
                open_ones.append(p)
                if size > 100_000:
                    yield _batch(out)
                    out.clear()
                    size = 0
            for x in open_ones if tree else ():
                put(x, name, None)
            row = waiting
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields.values(), strict=True)], names=list(fields))

    return run


def _copies(chunks: DataFrame, buckets: int, kind: str) -> DataFrame:
    """Answers about texts of the same words: all but one of them are gone (ids null); that one gets the list of their doc_ids if they are several."""
    each = chunks.select("chunk", F.explode(F.arrays_zip(*[f"note{i}" for i in range(4)])).alias("x"))
    each = each.select("chunk", *[F.col("x")[f"note{i}"].alias(n) for i, n in enumerate(("h1", "h2", "row", "doc_id"))])
    groups = each.groupBy("h1", "h2").agg(
        F.sort_array(F.collect_set("doc_id")).alias("ids"), F.max(F.col("doc_id").isNull()).alias("unnamed"), F.collect_list(F.struct("chunk", "row")).alias("places")
    )
    none = F.array(F.lit(None).cast(kind))
    groups = groups.where("size(places) > 1").select("h1", "places", F.array_min("places").alias("kept"), F.when(F.col("unnamed"), F.concat(none, "ids")).otherwise(F.col("ids")).alias("ids"))
    rows = groups.select(F.col("h1").alias("copy_of"), "ids", F.explode("places").alias("at"), (F.col("at") == F.col("kept")).alias("stays"))
    rows = rows.where("not stays or size(ids) > 1")
    return rows.select(F.col("at.chunk").alias("chunk"), F.lit(0).alias("step"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("data"), F.col("at.row").alias("row"), "copy_of", F.when(F.col("stays"), F.col("ids")).alias("ids"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """group_id, n_words, n_occurrences, doc_ids, word_at, step, times: the maximal repeats of min_words words or more, each with all its occurrences.

    Those in one run are one item: the first, how many words the next is on (0 if
    it is the only one), and how many they are.
    """
    return _passages(docs, min_words, chunk_bytes, False)


def passage_tree(docs: DataFrame, min_words: int = MIN_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """group_id, within, n_words, n_occurrences, doc_id, word_at, longer: the same repeats, with each place in a text only at the longest that begins there.

    A passage has the occurrences of its own rows and of all passages within it. If
    all of them are in those, it has one row, for one of them, with longer true.
    """
    return _passages(docs, min_words, chunk_bytes, True)


def _passages(docs: DataFrame, min_words: int, chunk_bytes: int, tree: bool) -> DataFrame:
    k = min(ANCHOR_WORDS, max(1, min_words // 2))
    doc_id = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")
    texts = docs.where("text is not null").select(doc_id.alias("doc_id"), "text", F.lit(False).alias("held"))
    kind = texts.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    size = text_bytes(texts)
    parts = parts_for(size)
    chunks, buckets = write_chunks(texts, size, chunk_bytes, _prints(min_words), f", note0 array<long>, note1 array<long>, note2 array<int>, note3 array<{name}>")
    answers, _ = materialise(_copies(chunks, buckets, name))
    plain = [F.lit(None).cast(t).alias(c) for c, t in (("row", "int"), ("copy_of", "long"), ("ids", f"array<{name}>"))]

    def marks(t: _Texts) -> list[tuple[int, bytes]]:
        m = _Marks(t, min_words, k)
        at = bounds(m.keys, parts)
        return [(p, Packer().keys(m.keys[a:b]).numbers(m.n[a:b]).done()) for p, (a, b) in enumerate(itertools.pairwise(at.tolist())) if a < b]

    def heads(t: _Texts) -> list[tuple[int, bytes]]:
        return _Heads(t, _Marks(t, min_words, k), min_words, k).ask(parts)

    for step, (ask, merge) in enumerate(((marks, _merge_marks), (heads, _merge_heads)), 1):
        asked = with_answers(chunks, answers, buckets).mapInArrow(_each_chunk(ask), BLOBS)
        found, _ = materialise(asked.groupBy("part").applyInArrow(merge, _ANSWERS))
        answers = answers.unionByName(found.select("chunk", F.lit(step).alias("step"), "part", "data", *plain))
    rows = f"mark long, head long, check long, suffix binary, doc_id {name}, at int, before binary, copy_of long, words int, ids array<{name}>, run string, step int"
    suffixes = with_answers(chunks, answers, buckets).mapInArrow(_suffix_rows(min_words, k, arrow), rows)
    ordered = suffixes.repartition("mark").sortWithinPartitions("head", "check", "suffix", "doc_id", "at")
    each = f"group_id string, within string, n_words long, n_occurrences long, doc_id {name}, word_at int, longer boolean"
    lists = f"group_id string, n_words long, n_occurrences long, doc_ids array<{name}>, word_at array<int>, step array<int>, times array<int>"
    return ordered.mapInArrow(_groups(min_words, arrow, tree), each if tree else lists)


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_tree(read(spark, sf_dir, "documents"))
