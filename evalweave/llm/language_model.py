"""Language-model scoring by deleted interpolation.

The query's model is over words (score_words): trigrams, whose number grows with
the corpus; score is the same over bytes, as follows. The probability of a byte after its context mixes the
maximum-likelihood estimates of orders ORDER to 1 and a uniform one. How much
an order counts depends on how often its context was seen (one weight for each
power of two); the weights are learned by expectation-maximisation on held-out
counts: a hashed share of the documents, whose own counts are deleted from the
estimates that predict them. The scores then use the counts of all documents, a
document's own among them: they tell how usual its wording is in this corpus, so
a text all of whose word runs are its own is as likely as one can be.

The word model works on chunks of documents (see exchange): a chunk's distinct
words get numbers and counts, then its distinct pairs and triples of numbers get
their counts, part by part, so nothing that grows with the corpus is held in one
place, and texts don't move. The bytes' model gathers documents in chunks, which
ask for the probabilities of their distinct n-grams.

Cases: null and empty texts have no bytes: log_prob 0, bits_per_byte null;
a context that reaches before the text is filled up (with zero bytes, or with a
word that no text holds); rows that repeat are counted and scored each, and held
out together; a null doc_id is a document as any other; an empty table gives an
empty result; further columns are not read; texts of any length are scored
whole; more than 2**32 distinct words are refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, remove, written
from .exchange import BLOBS, CHUNK_BYTES, Packer, Unpacker, blobs, bounds, opened, parts_for, text_bytes, write_chunks
from .kernels import Slice, slices, words

ORDER = 5
#: One document in so many is held out to learn the weights.
HELD_OUT = 16
BUCKETS = 48
ROUNDS = 30
TOLERANCE = 1e-4
_SLICE = 4 << 20
#: Events that are packed together.
_PACKED = 1 << 18


def _held() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(HELD_OUT)) == 0


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; bytes before the text count as zero."""
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for k in range(1, ORDER):
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = data[: len(data) - k] if k <= len(data) else 0
        before[at < k] = 0
        out |= before << (8 * k)
    return out


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the parts together, and how often each comes."""
    keys, counts = [], []
    for p in parts:
        p = np.sort(p)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        keys.append(p[first])
        counts.append(np.diff(np.concatenate([first, [len(p)]])))
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _count_chunk(table: pa.Table) -> pa.Table:
    """gram, chunk, n, held for the distinct n-grams of one chunk."""
    held = table.column("held").to_numpy()
    every, out = [], []
    for s in slices(table.column("text"), _SLICE):
        c = codes(s.data, s.offsets)
        every.append(c)
        out.append(c[np.repeat(held[s.first : s.first + s.rows], np.diff(s.offsets))])
    grams, n = _tally(every)
    kept, m = _tally(out)
    h = np.zeros(len(grams), dtype=np.int64)
    h[np.searchsorted(grams, kept)] = m
    chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
    return pa.table({"gram": grams, "chunk": np.full(len(grams), chunk, dtype=np.int32), "n": n.astype(np.int64), "held": h})


def _low(bits: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))


def _tables(grams: DataFrame) -> list[DataFrame]:
    """For each order from ORDER down: key, n, held, and those of the key's context (cn, ch)."""
    out = []
    for order in range(ORDER, 0, -1):
        t = grams if order == ORDER else grams.groupBy(_low(8 * order).alias("gram")).agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
        context = Window.partitionBy(F.shiftright("gram", 8)) if order > 1 else Window.partitionBy(F.lit(0))
        out.append(t.select("gram", "n", "held", F.sum("n").over(context).alias("cn"), F.sum("held").over(context).alias("ch")))
    return out


def _bucket(count: Column) -> Column:
    """Which power of two a context's frequency has; -1 for a context that wasn't seen."""
    return F.when(count > 0, F.floor(F.log2(count.cast("double"))).cast("int")).otherwise(F.lit(-1))


def _events(tables: list[DataFrame]) -> DataFrame:
    """weight, and for each order the deleted estimate p and the context's bucket b, of each held-out n-gram."""
    out = None
    for i, t in enumerate(tables):
        order = ORDER - i
        n, cn = F.col("n") - F.col("held"), F.col("cn") - F.col("ch")
        t = t.select(
            F.col("gram").alias(f"g{order}"), *([F.col("held").alias("weight")] if not i else []),
            F.when(cn > 0, n / cn).otherwise(F.lit(0.0)).alias(f"p{order}"), _bucket(cn).alias(f"b{order}"),
        )
        if out is None:
            out = t.where("weight > 0")
        else:
            out = out.join(t, F.col(f"g{ORDER}").bitwiseAND(F.lit((1 << (8 * order)) - 1)) == F.col(f"g{order}"))
    return out.select("weight", *[f"p{k}" for k in range(ORDER, 0, -1)], *[f"b{k}" for k in range(ORDER, 0, -1)])


def mix(p: np.ndarray, b: np.ndarray, weights: np.ndarray, base: float = 1 / 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each event, and for each order the share of it that stops there and that gets there.

    p, b: events x orders, highest order first; weights: orders x BUCKETS; base: the uniform estimate.
    """
    total, stop = _mixed(list(p.T), list(b.T), weights, base)
    share = np.stack(stop, axis=1) / total[:, None]
    after = 1.0 - np.cumsum(share, axis=1)
    reach = np.concatenate([np.ones((len(p), 1)), after[:, :-1]], axis=1)
    return total, share, reach


def _mixed(p: list[np.ndarray], b: list[np.ndarray], weights: np.ndarray, base: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probability of each event, and for each order the part of it that stops there; p, b: an array for each order."""
    unseen = np.concatenate([weights, np.zeros((len(weights), 1))], axis=1)  # bucket -1 is the last
    go_on, total, stop = np.ones(len(p[0])), np.zeros(len(p[0])), []
    for w, q, k in zip(unseen, p, b, strict=True):
        w = w[k]
        stop.append(go_on * w * q)
        total += stop[-1]
        go_on *= 1 - w
    total += go_on * base
    return total, stop


Events = tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]


def _packed(weight: np.ndarray, p: list[np.ndarray], b: list[np.ndarray]) -> list[bytes]:
    """Events as bytes, _PACKED at most together: a row each would cost more to move than to weigh, in every round."""
    out = []
    for lo in range(0, len(weight), _PACKED):
        packer = Packer().raw(weight[lo : lo + _PACKED], "<i8")
        for x, kind in [(x, "<f8") for x in p] + [(x, "i1") for x in b]:
            packer.raw(x[lo : lo + _PACKED], kind)
        out.append(packer.done())
    return out


def _of_rows(orders: int) -> Callable[[pa.RecordBatch], Iterator[Events]]:
    def run(batch: pa.RecordBatch) -> Iterator[Events]:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + 2 * orders)]
        yield cols[0], cols[1 : 1 + orders], [x.astype(np.int64) for x in cols[1 + orders :]]

    return run


def _of_packed(orders: int) -> Callable[[pa.RecordBatch], Iterator[Events]]:
    def run(batch: pa.RecordBatch) -> Iterator[Events]:
        for data in batch.column(0):
            u = Unpacker(data.as_buffer())
            yield u.raw("<i8"), [u.raw("<f8") for _ in range(orders)], [u.raw("i1").astype(np.int64) for _ in range(orders)]

    return run


def _expect(weights: np.ndarray, base: float, events: Callable[[pa.RecordBatch], Iterator[Events]]):
    orders = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den, like = np.zeros((orders, BUCKETS)), np.zeros((orders, BUCKETS)), 0.0
        for weight, p, b in itertools.chain.from_iterable(map(events, batches)):
            total, stop = _mixed(p, b, weights, base)
            weight = weight.astype(float)
            like += float((weight * np.log(total)).sum())
            reach = np.ones(len(weight))
            for k in range(orders):
                share = stop[k] / total
                num[k] += np.bincount(b[k] + 1, weight * share, minlength=BUCKETS + 1)[1:]
                den[k] += np.bincount(b[k] + 1, weight * np.maximum(reach, 0.0), minlength=BUCKETS + 1)[1:]
                reach -= share
        k, bucket = np.nonzero(den > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(bucket, -1)), pa.array(np.append(num[k, bucket], like)), pa.array(np.append(den[k, bucket], 0.0))], names=["k", "bucket", "num", "den"])

    return run


def learn(events: DataFrame, rounds: int = ROUNDS, base: float = 1 / 256, packed: int = 0) -> np.ndarray:
    """Weights (orders x BUCKETS, highest order first) by expectation-maximisation; a bucket without events keeps a half.

    events: weight, p of each order, b of each order; or, where packed is the number of orders, data (_packed).
    """
    orders = packed or (len(events.columns) - 1) // 2
    weights, opened_ = np.full((orders, BUCKETS), 0.5), (_of_packed if packed else _of_rows)(orders)
    for _ in range(rounds):
        rows = events.mapInArrow(_expect(weights, base, opened_), "k long, bucket long, num double, den double").groupBy("k", "bucket").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).collect()
        new = weights.copy()
        for r in rows:
            if r["k"] >= 0 and r["den"] > 0:
                new[r["k"], r["bucket"]] = min(r["num"] / r["den"], 1 - 1e-6)
        change, weights = float(np.abs(new - weights).max()), new
        if change < TOLERANCE:
            break
    return weights


def _probabilities(tables: list[DataFrame], weights: np.ndarray) -> DataFrame:
    """gram, logp for every n-gram of the corpus: the mixture with the counts of all documents, from the lowest order up."""
    below = None
    for i in range(ORDER - 1, -1, -1):
        order = ORDER - i
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights[i]]), F.least(_bucket(F.col("cn")), F.lit(BUCKETS - 1)) + 1)
        t = tables[i].withColumn("w", w)
        if below is None:
            t = t.select("gram", (F.col("w") * F.col("n") / F.col("cn") + (1 - F.col("w")) / 256).alias("p"))
        else:
            low = below.select(F.col("gram").alias("low"), F.col("p").alias("q"))
            t = t.join(low, _low(8 * (order - 1)) == F.col("low")).select("gram", (F.col("w") * F.col("n") / F.col("cn") + (1 - F.col("w")) * F.col("q")).alias("p"))
        below = t
    return below.select("gram", F.log("p").cast("float").alias("logp"))


class _Lookup:
    """Open-addressed table from n-gram to row, probed for many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]
            step += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, all of which must be there."""
        out = self.slots[self._slot(keys, 0)]
        wrong, step = np.flatnonzero(self.keys[out] != keys), 1
        while len(wrong):
            out[wrong] = self.slots[self._slot(keys[wrong], step)]
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
            step += 1
        return out


def _byte_grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    return codes(s.data, s.offsets), s.offsets


def _score_with(docs: pa.Table, answers: pa.Table, grams: Callable[[Slice], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    look = _Lookup(answers.column("gram").to_numpy())
    logp = answers.column("logp").to_numpy()
    n = docs.num_rows
    total, size = np.zeros(n), np.zeros(n, dtype=np.int64)
    for s in slices(docs.column("text"), 1 << 20):
        length = np.diff(s.offsets)
        codes_, row_at = grams(s)
        full = np.flatnonzero(np.diff(row_at))
        if len(full):
            each = logp[look.rows(codes_)].astype(np.float64)
            total[s.first + full] = np.add.reduceat(each, row_at[full])
        size[s.first : s.first + s.rows] = length
    bits = -total / np.maximum(size, 1) / np.log(2)
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": size, "log_prob": total, "bits_per_byte": pa.array(bits, mask=size == 0)})


def _score_chunk(docs: pa.Table, answers: pa.Table) -> pa.Table:
    return _score_with(docs, answers, _byte_grams)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_bytes, log_prob (natural), bits_per_byte for every document, by a model of all of them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(chunks)).cast("int")
    texts = docs.select("doc_id", "text", chunk.alias("chunk"), _held().alias("held"))
    asked, _ = materialise(texts.select("chunk", "held", "text").groupBy("chunk").applyInArrow(_count_chunk, "gram long, chunk int, n long, held long"))
    grams, _ = materialise(asked.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held")))
    tables = _tables(grams)
    if weights is None:
        events, _, path = written(_events(tables))
        weights = learn(events)
        remove(docs.sparkSession, path)
    answers = asked.select("gram", "chunk").join(_probabilities(tables, weights), "gram").select("chunk", "gram", "logp")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk, f"doc_id {kind}, n_bytes long, log_prob double, bits_per_byte double")


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (uint64), ascending, and for each value its place among them.

    A value and its index are sorted as one number, several times as fast as indices
    by values; where both don't fit 64 bits, values that differ only in what is left
    out are put in order afterwards.
    """
    if not len(x):
        return x, np.zeros(0, dtype=np.int64)
    low, bits = x.min(), np.uint64((len(x) - 1).bit_length())
    out = np.uint64(max(0, int(x.max() - low).bit_length() + int(bits) - 64))
    both = x - low
    both >>= out
    both <<= bits
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if out:
        y = x[order]
        if (y[1:] < y[:-1]).any():
            again = np.argsort(y, kind="stable")
            order, y = order[again], y[again]
    else:
        both >>= bits
        both += low
        y = both
    new = np.ones(len(x), dtype=bool)
    new[1:] = y[1:] != y[:-1]
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return y[new], place


def _sums(place: np.ndarray, amounts: np.ndarray, n: int) -> np.ndarray:
    """Sums by place; exact below 2**53."""
    return np.bincount(place, amounts, minlength=n).astype(np.int64)


class _Vocabulary:
    """A chunk's words: their hashes, ascending (0 stands for the place before a text), how often each comes and is a context."""

    def __init__(self, docs: pa.Table):
        self.docs = docs
        hashes, ends, at = [], [np.zeros(1, np.int64)], 0
        for s in slices(docs.column("text"), 1 << 20):
            w = words(s)
            hashes.append(w.hash)
            ends.append(at + w.row_at[1:])
            at += len(w.hash)
        self.row_at = np.concatenate(ends)
        self.keys, place = _distinct(np.concatenate([*hashes, np.zeros(1, np.uint64)]))
        self.word = place[:-1]
        self.head = np.zeros(at, dtype=bool)
        self.head[self.row_at[:-1][np.diff(self.row_at) > 0]] = True
        self.before = np.where(self.head, 0, np.concatenate([[0], self.word])[:at])
        self.n = np.bincount(self.word, minlength=len(self.keys))
        self.cn = np.bincount(self.before, minlength=len(self.keys))


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = _Vocabulary(opened(data))
                at = bounds(v.keys, parts)
                made = [(p, Packer().keys(v.keys[a:b]).numbers(v.n[a:b]).numbers(v.cn[a:b]).done()) for p, (a, b) in enumerate(itertools.pairwise(at.tolist())) if a < b]
                yield from blobs(chunk, made).to_batches()

    return run


#: Answers to a chunk, or (chunk -1) a part's sums: distinct words, tokens of all documents and of those not held out, and ranks.
_ANSWERS = BLOBS + ", words long, tokens long, kept long, ranks long"


def _answers(rows: list[tuple[int, int, bytes]], sums: tuple[int, ...] | None = None) -> pa.Table:
    rows = rows + ([(-1, -1, b"")] if sums else [])
    table = pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})
    for k, name in enumerate(("words", "tokens", "kept", "ranks")):
        table = table.append_column(name, pa.array([None] * (len(rows) - bool(sums)) + ([sums[k]] if sums else []), pa.int64()))
    return table


def _merge_words(table: pa.Table) -> pa.Table:
    """Numbers one part's words, and answers each chunk: the words' ranks, counts and counts as contexts (to held-out chunks also without held-out documents)."""
    chunks, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
    keys, n, cn = zip(*((u.keys(), u.numbers().astype(np.int64), u.numbers().astype(np.int64)) for u in map(Unpacker, table.column("data").to_pylist())), strict=True)
    size = [len(k) for k in keys]
    distinct, place = _distinct(np.concatenate(keys))
    kept = np.repeat([c % 2 == 0 for c in chunks], size)
    every, free = ([_sums(place, np.concatenate(x) * f, len(distinct)) for x in (n, cn)] for f in (1, kept))
    out, lo = [], 0
    for chunk, k in zip(chunks, size, strict=True):
        mine, lo = place[lo : lo + k], lo + k
        p = Packer().keys(mine.astype(np.uint64))
        for counts in every + (free if chunk % 2 else []):
            p.numbers(counts[mine])
        out.append((chunk, part, p.done()))
    return _answers(out, (int((every[0] > 0).sum()), int(every[0].sum()), int(free[0].sum()), len(distinct)))


@dataclass
class _Model:
    """What is known of all words: bits of a word's number, parts, distinct words, tokens of all documents and of those not held out."""

    bits: int
    parts: int
    words: int
    tokens: int
    kept: int

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of numbers as numbers of twice the bits, shuffled one to one, so that parts are of like size."""
        half, mask = np.uint64(self.bits), np.uint64((1 << (2 * self.bits)) - 1)
        x = (a << half) | b
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            x = (x * np.uint64(factor)) & mask
            x ^= x >> half
        return x


class _Grams:
    """A chunk's pairs and triples of words, and the answers to them."""

    def __init__(self, docs: pa.Table, answers: pa.Table, model: _Model, held: bool):
        self.model, self.held = model, held
        v = self.v = _Vocabulary(docs)
        ranks, counts = [np.zeros(0, np.uint64)], [[np.zeros(0, np.int64)] for _ in range(4)]
        for part, u in self._read(answers, 1):
            ranks.append(u.keys() * np.uint64(model.parts) + np.uint64(part))
            for k in range(4 if held else 2):
                counts[k].append(u.numbers().astype(np.int64))
        number = np.concatenate(ranks)
        self.word_counts = [np.concatenate(x) for x in counts]
        self.number = number[v.word]
        if not len(v.word):
            self.pairs, self.triples = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        pad = number[:1]
        codes = model.pairs(np.concatenate([number[v.before], pad]), np.concatenate([self.number, pad]))
        self.pairs, place = _distinct(codes)
        self.pair = place[:-1]
        self.context = np.where(v.head, place[-1], np.concatenate([[0], self.pair])[: len(v.word)])
        self.triples, self.triple = _distinct((self.context.astype(np.uint64) << np.uint64(model.bits)) | self.number)

    @staticmethod
    def _read(answers: pa.Table, step: int) -> Iterator[tuple[int, Unpacker]]:
        some = answers.filter(pc.equal(answers.column("step"), step)).sort_by("part")
        for part, data in zip(some.column("part").to_pylist(), some.column("data").to_pylist(), strict=True):
            yield part, Unpacker(data)

    def ask(self) -> list[tuple[int, bytes]]:
        n = np.bincount(self.pair, minlength=len(self.pairs)) if len(self.pairs) else self.pairs
        m = np.bincount(self.triple, minlength=len(self.triples)) if len(self.pairs) else self.pairs
        context = (self.triples >> np.uint64(self.model.bits)).astype(np.int64)
        after = np.bincount(context, minlength=len(self.pairs))
        at = bounds(self.pairs, self.model.parts, 2 * self.model.bits)
        to = np.searchsorted(context, at)
        last = self.triples & np.uint64((1 << self.model.bits) - 1)
        return [(p, Packer().keys(self.pairs[a:b]).numbers(n[a:b]).numbers(after[a:b]).numbers(last[to[p] : to[p + 1]]).numbers(m[to[p] : to[p + 1]]).done()) for p, (a, b) in enumerate(itertools.pairwise(at.tolist())) if a < b]

    def estimates(self, answers: pa.Table, kept: bool) -> Events:
        """For each distinct triple, of all documents or only of those that aren't held out: how often it comes; for each order its estimates p and its contexts' buckets b."""
        counts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for _, u in self._read(answers, 2):
            for k in range(6 if self.held else 3):
                counts[k].append(u.numbers().astype(np.int64))
        pair_n, pair_cn, triple_n = (np.concatenate(x) for x in counts[3 * kept : 3 * kept + 3])
        word_n, word_cn = self.word_counts[2 * kept : 2 * kept + 2]
        at = np.empty(len(self.triples), dtype=np.int64)
        at[self.triple] = np.arange(len(self.triple))
        total = self.model.kept if kept else self.model.tokens
        tops = (triple_n, pair_n[self.pair[at]], word_n[self.v.word[at]])
        contexts = (pair_cn[self.context[at]], word_cn[self.v.before[at]], np.full(len(at), total))
        p = [np.where(c > 0, n / np.maximum(c, 1), 0.0) for n, c in zip(tops, contexts, strict=True)]
        b = [np.frexp(c.astype(np.float64))[1] - 1 for c in contexts]
        return np.bincount(self.triple, minlength=len(at)), p, b


def _merge_grams(table: pa.Table) -> pa.Table:
    """Counts one part's pairs and triples, and answers each chunk: pairs' counts and counts as contexts, triples' counts."""
    chunks, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
    keys, n, after, last, m = zip(*((u.keys(), *(u.numbers().astype(np.int64) for _ in range(4))) for u in map(Unpacker, table.column("data").to_pylist())), strict=True)
    size, more = [len(x) for x in keys], [len(x) for x in last]
    distinct, place = _distinct(np.concatenate(keys))
    context = np.repeat(place, np.concatenate(after)).astype(np.uint64)
    number = np.concatenate(last).astype(np.uint64)
    bits = np.uint64(int(number.max(initial=0)).bit_length())
    triples, where = _distinct((context << bits) | number)
    of = (triples >> bits).astype(np.int64)
    every = []
    for free in (False, True):
        pair_f, triple_f = (np.repeat([not free or c % 2 == 0 for c in chunks], x) for x in (size, more))
        counted = _sums(where, np.concatenate(m) * triple_f, len(triples))
        every += [_sums(place, np.concatenate(n) * pair_f, len(distinct)), _sums(of, counted, len(distinct)), counted]
    out, lo, to = [], 0, 0
    for chunk, k, t in zip(chunks, size, more, strict=True):
        mine, theirs = place[lo : lo + k], where[to : to + t]
        lo, to = lo + k, to + t
        p = Packer()
        for i, counts in enumerate(every if chunk % 2 else every[:3]):
            p.numbers(counts[theirs if i % 3 == 2 else mine])
        out.append((chunk, part, p.done()))
    return _answers(out)


def score_words(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_bytes, log_prob (natural) of the text's words, bits_per_byte for every document, by a model of word trigrams of all of them.

    Lowest is a uniform choice among the corpus's words; white space costs nothing.
    """
    size = text_bytes(docs)
    parts = parts_for(size)
    chunks, _ = write_chunks(docs.select("doc_id", "text", _held().alias("held")), size, chunk_bytes)
    asked = chunks.mapInArrow(_ask_words(parts), BLOBS)
    numbered, _ = materialise(asked.groupBy("part").applyInArrow(_merge_words, _ANSWERS))
    all_ = numbered.where("chunk < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "kept")], F.coalesce(F.max("ranks"), F.lit(0)).alias("ranks")).first()
    bits = max(8, (all_["ranks"] * parts).bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 words; their pairs don't fit 64 bits")
    model = _Model(bits, parts, all_["words"], all_["tokens"], all_["kept"])
    numbers = numbered.where("chunk >= 0").select("chunk", F.lit(1).alias("step"), "part", "data")

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py()
        return blobs(chunk, _Grams(opened(docs.column("data")[0]), answers, model, chunk % 2 == 1).ask())

    wanted = chunks.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(ask, BLOBS)
    counted, _ = materialise(wanted.groupBy("part").applyInArrow(_merge_grams, _ANSWERS))
    answers = numbers.unionByName(counted.select("chunk", F.lit(2).alias("step"), "part", "data"))
    base = 1 / max(1, model.words)
    if weights is None:

        def events(docs: pa.Table, answers: pa.Table) -> pa.Table:
            g = _Grams(opened(docs.column("data")[0]), answers, model, True)
            return pa.table({"data": pa.array(_packed(*g.estimates(answers, True)) if len(g.triples) else [], pa.binary())})

        odd = "chunk % 2 = 1"
        heldout = chunks.where(odd).groupBy("chunk").cogroup(answers.where(odd).groupBy("chunk")).applyInArrow(events, "data binary")
        table, _, path = written(heldout)
        weights = learn(table, ROUNDS, base, 3)
        remove(docs.sparkSession, path)
    found = weights

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, chunk = opened(docs.column("data")[0]), docs.column("chunk")[0].as_py()
        g = _Grams(texts, answers, model, chunk % 2 == 1)
        total = np.zeros(texts.num_rows)
        if len(g.triples):
            _, p, b = g.estimates(answers, False)
            each = np.log(_mixed(p, [np.minimum(x, BUCKETS - 1) for x in b], found, base)[0])[g.triple]
            full = np.flatnonzero(np.diff(g.v.row_at))
            total[full] = np.add.reduceat(each, g.v.row_at[full])
        length = np.asarray(pc.fill_null(pc.binary_length(texts.column("text")), 0)).astype(np.int64)
        bits = -total / np.maximum(length, 1) / np.log(2)
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": length, "log_prob": total, "bits_per_byte": pa.array(bits, mask=length == 0)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, n_bytes long, log_prob double, bits_per_byte double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_words(read(spark, sf_dir, "documents"))
