"""Exact duplicates with counting quotient filters.

Each partition packs the 64-bit fingerprints of its texts into counting
quotient filters, one for each range of quotients; filters of a range merge
losslessly by their sorted remainders, adding counts. Fingerprints counted more
than once route their documents to a comparison of the texts' bytes.

Cases: a null text has no copies; empty texts are copies of one another; rows
that repeat doc_id and text are copies as any others; a null doc_id sorts
first; an empty table gives an empty result; further columns pass through
``drop_copies`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, quoted, read, sized

#: Distinct fingerprints that one merged filter is planned for.
FILTER_KEYS = 1 << 18


class QuotientFilter:
    """Counting quotient filter over fingerprints that share their top ``drop`` bits.

    The next ``qbits`` bits of a fingerprint are its quotient, the rest its
    remainder. A bit per quotient says whether its run is there, a bit per slot
    where a run ends; slots hold the remainders in order, with their counts.
    Nothing of a fingerprint is lost, so merged filters count exactly.
    """

    __slots__ = ("drop", "qbits", "prefix", "occupied", "run_ends", "remainders", "counts")

    def __init__(self, drop: int, qbits: int, prefix: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.drop, self.qbits, self.prefix = drop, qbits, prefix
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray, drop: int) -> QuotientFilter:
        """keys: distinct ascending uint64 with the same top drop bits."""
        qbits = min(max(3, int(max(1, len(keys))).bit_length()), 64 - drop - 1)
        prefix = int(keys[0] >> np.uint64(64 - drop)) if drop else 0
        quotient = (keys >> np.uint64(64 - drop - qbits)) & np.uint64((1 << qbits) - 1)
        occupied = np.zeros(1 << qbits, dtype=bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.ones(len(keys), dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        return cls(drop, qbits, prefix, occupied, ends, keys & np.uint64((1 << (64 - drop - qbits)) - 1), counts)

    def keys(self) -> np.ndarray:
        """The fingerprints, ascending."""
        run = np.cumsum(np.concatenate([[0], self.run_ends[:-1]])).astype(np.int64)
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        high = np.uint64((self.prefix << (64 - self.drop)) & ((1 << 64) - 1)) if self.drop else np.uint64(0)
        return high | (quotient << np.uint64(64 - self.drop - self.qbits)) | self.remainders

    def pack(self) -> bytes:
        rbytes = (64 - self.drop - self.qbits + 7) // 8
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.drop, self.qbits, self.prefix, len(self.remainders), len(many)], dtype=np.int64)
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :rbytes]
        return b"".join([head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), np.ascontiguousarray(low).tobytes(), many.astype("<u4").tobytes(), self.counts[many].astype("<i8").tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        drop, qbits, prefix, n, m = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=5))
        at, rbytes = 40, (64 - drop - qbits + 7) // 8

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        occupied = np.unpackbits(take(((1 << qbits) + 7) // 8, "u1"), count=1 << qbits).astype(bool)
        ends = np.unpackbits(take((n + 7) // 8, "u1"), count=n).astype(bool)
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :rbytes] = take(n * rbytes, "u1").reshape(n, rbytes)
        counts = np.ones(n, dtype=np.int64)
        many = take(m, "<u4")
        counts[many] = take(m, "<i8")
        return cls(drop, qbits, prefix, occupied, ends, wide.view("<u8").reshape(n).astype(np.uint64), counts)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' fingerprints in order, without sorting them again: the smaller one's go to their places among the other's, or add to their counts."""
        large, small = (self, other) if len(self.remainders) >= len(other.remainders) else (other, self)
        a, b = large.keys(), small.keys()
        at = np.searchsorted(a, b)
        same = a[np.minimum(at, len(a) - 1)] == b
        counts = large.counts.copy()
        counts[at[same]] += small.counts[same]
        new = np.flatnonzero(~same)
        place = at[new] + np.arange(len(new))
        old = np.ones(len(a) + len(new), dtype=bool)
        old[place] = False
        keys, sums = np.empty(len(old), np.uint64), np.empty(len(old), np.int64)
        keys[place], sums[place] = b[new], small.counts[new]
        keys[old], sums[old] = a, counts
        return self.of_sorted(keys, sums, self.drop)


def _build(drop: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.uint64)]
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        if not len(keys):
            return
        part = keys >> np.uint64(64 - drop) if drop else np.zeros(len(keys), dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = np.concatenate([first[1:], [len(keys)]])
        for lo in range(0, len(first), 4096):
            some = list(zip(first[lo : lo + 4096], last[lo : lo + 4096], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a]) for a, _ in some], pa.int64()), pa.array([QuotientFilter.of_sorted(keys[a:b], counts[a:b], drop).pack() for a, b in some], pa.binary())],
                names=["part", "filter"],
            )

    return build


def _repeated(table: pa.Table) -> pa.Table:
    """Merges the filters of one range, two by two, and gives the fingerprints counted more than once."""
    level = [QuotientFilter.unpack(x) for x in table.column("filter").to_pylist()]
    while len(level) > 1:
        level = [a.merge(b) for a, b in zip(level[::2], level[1::2], strict=False)] + (level[-1:] if len(level) % 2 else [])
    again = level[0].counts > 1
    return pa.table({"fp": pa.array(level[0].keys()[again].view(np.int64), pa.int64())})


def repeated_fingerprints(prints: DataFrame, filter_keys: int = FILTER_KEYS) -> tuple[DataFrame, int]:
    """prints: one column of int64 fingerprints. A written table ``fp`` of those found more than once, and its bytes."""
    drop = max(0, int(prints.count() // filter_keys).bit_length())
    filters = prints.mapInArrow(_build(drop), "part long, filter binary")
    return materialise(filters.groupBy("part").applyInArrow(_repeated, "fp long"))


def _candidates(docs: DataFrame, fp: str) -> tuple[DataFrame, DataFrame]:
    marked = docs.where(F.col("text").isNotNull()).withColumn(fp, F.xxhash64("text"))
    again, size = repeated_fingerprints(marked.select(fp))
    return marked, sized(again.withColumnRenamed("fp", fp), size)


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, n_copies: a row for each document that repeats the text of keep_id, the lowest doc_id of its group."""
    marked, again = _candidates(docs.select("doc_id", "text"), "fp")
    group = Window.partitionBy("fp", "text")
    ranked = marked.join(again, "fp", "left_semi").select(
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("n_copies"),
        F.row_number().over(group.orderBy("doc_id")).alias("rank"),
    )
    return ranked.where("rank > 1").drop("rank")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but the first (lowest doc_id) of each group of equal texts; null texts stay."""
    fp, rank = fresh(docs.columns, "fp"), fresh(docs.columns, "rank")
    marked, again = _candidates(docs, fp)
    alone = marked.join(again, fp, "left_anti")
    ranked = marked.join(again, fp, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(fp, "text").orderBy("doc_id")))
    first = ranked.where(F.col(rank) == 1).drop(rank)
    return alone.unionByName(first).drop(fp).unionByName(docs.where(F.col("text").isNull())).select(*[quoted(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(read(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, keep_id, n_copies FROM (
  SELECT doc_id,
         min(doc_id) OVER (PARTITION BY text) AS keep_id,
         count(*) OVER (PARTITION BY text) AS n_copies,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS FIRST) AS pos
  FROM documents WHERE text IS NOT NULL
) WHERE pos > 1
"""
