"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte
n-grams (naive Bayes, closed form) says on which side a text falls. Decoding
weighs each bit's loss by the classifier's margin and takes the language whose
codeword loses least; a text whose two best codewords are too close is flagged
as ambiguous, and rejected.

The classifiers are fitted on a bounded sample of labelled rows, whole texts:
at most SAMPLE_ROWS a language, chosen by hash. All documents are scored, with
all their bytes.

Cases: a null, empty or blank text has no n-grams: its language is null, it is
ambiguous and rejected. Without any labelled row nothing can be identified and
nothing is rejected. With one language every text that has n-grams gets it. An
empty table gives an empty result. Rows that repeat are scored alike, and a null
or repeated doc_id is a document as any other: the sample goes by the hash of
doc_id and text together. Further columns pass through ``keep_identified`` whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read
from .kernels import SPACE, Slice, give_back, slices

#: Labelled rows a language that the classifiers are fitted on, at most.
SAMPLE_ROWS = 300
#: Share of the sample that calibrates ambiguity instead of fitting.
HOLDOUT = 0.25
#: Share of rightly identified held-out texts that may be called ambiguous.
AMBIGUOUS_SHARE = 0.002
BITS = 16
ORDERS = (1, 2, 3, 4)
_ALPHA = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32
_FOLD[48:58] = 48
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: every way to split up to 7 classes, else random columns far apart."""
    if k <= 2:
        return np.array([[1], [-1]], dtype=np.int8)[:k]
    if k <= 7:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (k - 1) - 1)] for i in range(k)], dtype=np.int8)
    length, rng, best, best_distance = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, length))
        m[0, np.abs(m.sum(0)) == k] *= -1
        distance = min(int((m[i] != m[j]).sum()) for i, j in itertools.combinations(range(k), 2))
        if distance > best_distance:
            best, best_distance = m, distance
    return best


def grams(s: Slice) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each byte; 2**BITS where it would leave its row or be blank."""
    x = _FOLD[s.data].astype(np.uint64)
    ends = np.repeat(s.offsets[1:], np.diff(s.offsets))
    at = np.arange(len(x))
    code = np.zeros(len(x), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(x)
        if len(x) >= order:
            shifted[: len(x) - order + 1] = x[order - 1 :]
        code = (code ^ shifted) * _STEP[(order - 1) % len(_STEP)]
        code ^= code >> np.uint64(29)
        if order in ORDERS:
            bucket = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int64)
            bucket[(at + order > ends) | (x == 32)] = 1 << BITS
            yield bucket


@dataclass
class Model:
    """languages, their codewords, the weights of each bucket for each bit (a last row of zeros), and the least gap of losses that isn't ambiguous."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    least_gap: float

    def decode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the best language's index (-1: none), its loss, the gap to the next one, and the number of n-grams."""
        n = len(column)
        best, loss, gap, count = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        bits = self.code.shape[1]
        for s in slices(column):
            margin, grams_of = np.zeros((s.rows, bits)), np.zeros(s.rows, dtype=np.int64)
            full = np.flatnonzero(np.diff(s.offsets) > 0)
            if not len(full):
                continue
            for bucket in grams(s):
                margin[full] += np.add.reduceat(self.weights[bucket], s.offsets[full], axis=0)
                grams_of[full] += np.add.reduceat((bucket < 1 << BITS).astype(np.int64), s.offsets[full])
            margin /= np.maximum(grams_of, 1)[:, None]
            losses = np.logaddexp(0.0, -4.0 * margin[:, None, :] * self.code[None]).mean(axis=2)
            order = np.argsort(losses, axis=1, kind="stable")
            rows = np.arange(s.rows)
            first = losses[rows, order[:, 0]]
            span = slice(s.first, s.first + s.rows)
            best[span] = np.where(grams_of > 0, order[:, 0], -1)
            loss[span] = first
            gap[span] = losses[rows, order[:, 1]] - first if len(self.languages) > 1 else np.inf
            count[span] = grams_of
        return best, loss, gap, count


def fit(texts: list[str], labels: list[str]) -> Model:
    """Fits the classifiers on three quarters of the texts and calibrates ambiguity on the rest."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = {x: i for i, x in enumerate(languages)}
    seen: dict[str, int] = {}
    held = []
    every = round(1 / HOLDOUT)
    for x in labels:
        seen[x] = seen.get(x, 0) + 1
        held.append(seen[x] % every == 0)
    counts = np.zeros((len(languages), (1 << BITS) + 1))
    for text, label, out in zip(texts, labels, held, strict=True):
        if not out:
            for s in slices(pa.array([text])):
                for bucket in grams(s):
                    counts[index[label]] += np.bincount(bucket, minlength=(1 << BITS) + 1)
    counts = counts[:, :-1]
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    scale = max(1.0, counts.sum() / max(1, len(languages)))
    weights = np.zeros(((1 << BITS) + 1, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        plus, minus = (shares[code[:, b] == side].sum(axis=0) / max(1, (code[:, b] == side).sum()) + _ALPHA / scale for side in (1, -1))
        weights[:-1, b] = np.log(plus / minus) if (code[:, b] == -1).any() else 1.0
    model = Model(languages, code, weights, 0.0)
    if any(held) and len(languages) > 1:
        mine = [i for i, out in enumerate(held) if out]
        best, _, gap, count = model.decode(pa.array([texts[i] for i in mine]))
        right = gap[(best == np.array([index[labels[i]] for i in mine])) & (count > 0)]
        if len(right):
            # Short texts have small gaps by chance only: the cut is never above a tenth of the usual gap.
            model.least_gap = float(min(np.quantile(right, AMBIGUOUS_SHARE), np.median(right) / 10))
    return model


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on at most sample_rows labelled documents a language; None without any."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and trim(text) <> ''")
    sizes = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # Of each language, about twice the rows wanted pass by hash before they are ranked.
    key = F.xxhash64(F.lit("lid"), "doc_id", "text")
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, (2 * sample_rows + 50) / n))) for x, n in sizes.items()])
    some = labelled.withColumn("key", key).where((F.pmod("key", F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", F.xxhash64(F.lit("tie"), "text")))).where(F.col("rank") <= sample_rows)
    rows = sorted(ranked.select("lang", "rank", "text").collect(), key=lambda r: (r["lang"], r["rank"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, lang (as labelled), identified, loss, gap, n_grams, ambiguous, rejected for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if m is None:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))], names=names)
                continue
            best, loss, gap, count = m.decode(batch.column(1))
            none, unsure = best < 0, (best < 0) | (gap < m.least_gap)
            said = pa.array([None if b < 0 else m.languages[b] for b in best], pa.string())
            gap = np.where(np.isinf(gap), np.nan, gap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), said, pa.array(loss, mask=none), pa.array(gap, mask=none | np.isnan(gap)), pa.array(count), pa.array(unsure), pa.array(unsure)], names=names)

    names = ["doc_id", "lang", "identified", "loss", "gap", "n_grams", "ambiguous", "rejected"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(score, f"doc_id {kind}, lang string, identified string, loss double, gap double, n_grams long, ambiguous boolean, rejected boolean")


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those that ``identify`` rejects; columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if m is not None:
                best, _, gap, _ = m.decode(batch.column(at))
                batch = batch.filter(pa.array((best >= 0) & (gap >= m.least_gap)))
            yield batch
        give_back()

    # Columns go by number while they pass through Python, so that any name will do.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
