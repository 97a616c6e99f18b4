"""Chunks of documents that ask about their keys, and get answers to just those.

Documents are written once as chunks: a row holds about CHUNK_BYTES of text, as
compressed Arrow data, in a table bucketed by chunk, so that passes over it never
move a text. What moves instead is packed: a chunk sends the ascending keys that
fall to a part (a range of hashes, the same for all chunks) as differences of as
few bytes as they need, with small counts; the part merges the keys of all chunks
and answers each chunk in the order of its own keys, so that answers need no keys
at all. Nothing that grows with the corpus is held in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Bytes of text of a chunk, which a Python worker holds at once (with some twenty times as much in arrays of words).
CHUNK_BYTES = 4 << 20
#: Bytes of text that one part's keys come from, on the average.
PART_BYTES = 8 << 20
#: Buckets that the catalog allows a table.
_MOST_BUCKETS = 100_000

Notes = Callable[[pa.Table], list[pa.Array]]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(size: int) -> int:
    return max(1, -(-size // PART_BYTES))


def _cut(chunk_bytes: int, notes: Notes | None):
    """Batches of doc_id, text, held as chunks: odd ones of rows that are held out, even ones of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[list[pa.RecordBatch]] = [[], []]
        size = [0, 0]

        def emit(side: int) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(waiting[side])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            chunk = ((task << 26) | made) * 2 + side
            made += 1
            waiting[side], size[side] = [], 0
            more = notes(table) if notes else []
            columns = [pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *more]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "data", *[f"note{i}" for i in range(len(more))]])

        for batch in batches:
            held = np.asarray(batch.column(2).fill_null(False))
            for side in (0, 1):
                some = batch.filter(pa.array(held == bool(side))).select([0, 1])
                length = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(some.column(1)), 0)).astype(np.int64) + 16)
                lo = 0
                while lo < some.num_rows:
                    done = int(length[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(length, done + chunk_bytes - size[side], side="right")))
                    waiting[side].append(some.slice(lo, hi - lo))
                    size[side] += int(length[hi - 1]) - done
                    lo = hi
                    if size[side] >= chunk_bytes or lo < some.num_rows:
                        yield emit(side)
        for side in (0, 1):
            if waiting[side]:
                yield emit(side)

    return run


def _buckets(spark: SparkSession, size: int, chunk_bytes: int) -> int:
    # Fewer buckets than shuffles have partitions, and Spark would shuffle the chunks after all.
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))
    return min(_MOST_BUCKETS, max(least, -(-size // (2 * chunk_bytes)), 1))


def write_chunks(docs: DataFrame, size: int, chunk_bytes: int = CHUNK_BYTES, notes: Notes | None = None, note_types: str = "") -> tuple[DataFrame, int]:
    """docs (doc_id, text, held) as a written table chunk, data and the notes taken of each chunk; and its buckets. size: bytes of all texts."""
    spark = docs.sparkSession
    name, path = f"evalweave_{uuid.uuid4().hex}", new_path(spark)
    buckets = _buckets(spark, size, chunk_bytes)
    chunks = docs.mapInArrow(_cut(chunk_bytes, notes), "chunk long, data binary" + note_types)
    chunks.write.format("parquet").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and out reads them
    return out, buckets


def with_answers(chunks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """chunk, data, answers (all rows of answers but for the chunk) for every chunk; chunks stay where they are."""
    fields = F.struct(*[c for c in answers.columns if c != "chunk"])
    lists = answers.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(fields).alias("answers")).withColumnRenamed("chunk", "of")
    return chunks.select("chunk", "data").join(lists.hint("merge"), F.col("chunk") == F.col("of"), "left").select("chunk", "data", "answers")


def opened(data: bytes | pa.Scalar) -> pa.Table:
    """The documents of a chunk: doc_id, text."""
    raw = data.as_buffer() if isinstance(data, pa.Scalar) else data
    return pa.ipc.open_stream(raw).read_all()


class Packer:
    """Arrays one after the other, as compressed bytes."""

    def __init__(self) -> None:
        self.out: list[bytes] = []

    def raw(self, x: np.ndarray, kind: str) -> Packer:
        x = np.ascontiguousarray(x.astype(kind))
        self.out += [np.int64(len(x)).tobytes(), x.tobytes()]
        return self

    def keys(self, x: np.ndarray) -> Packer:
        """Ascending uint64."""
        step = np.diff(x, prepend=np.uint64(0)).astype(np.uint64)
        first, step = step[:1], step[1:]
        return self.raw(first, "<u8").numbers(step)

    def numbers(self, x: np.ndarray) -> Packer:
        """uint64, in the number of bytes that takes least; those that need more stand apart."""
        x = np.ascontiguousarray(x.astype("<u8"))
        most = int(x.max(initial=0))
        cost = [len(x) * w + 12 * (int(np.count_nonzero(x >= np.uint64(1 << (8 * w)))) if most >> (8 * w) else 0) for w in range(1, 9)]
        w = 1 + int(np.argmin(cost))
        large = np.flatnonzero(x >= np.uint64(1 << (8 * w))) if w < 8 else np.zeros(0, np.int64)
        planes = x.view(np.uint8).reshape(-1, 8)[:, :w].T
        self.out.append(np.int64(w).tobytes())
        return self.raw(planes.reshape(-1), "u1").raw(large, "<u4").raw(x[large], "<u8")

    def done(self) -> bytes:
        return zstandard.compress(b"".join(self.out), 1)


class Unpacker:
    def __init__(self, data: bytes):
        self.data, self.at = zstandard.decompress(data), 0

    def _int(self) -> int:
        self.at += 8
        return int(np.frombuffer(self.data, np.int64, 1, self.at - 8)[0])

    def raw(self, kind: str) -> np.ndarray:
        n = self._int()
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def keys(self) -> np.ndarray:
        first = self.raw("<u8")
        return np.cumsum(np.concatenate([first, self.numbers()]), dtype=np.uint64)

    def numbers(self) -> np.ndarray:
        w = self._int()
        planes = self.raw("u1").reshape(w, -1)
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :w] = planes.T
        out = wide.view("<u8").reshape(-1)
        large = self.raw("<u4")
        out[large] = self.raw("<u8")
        return out


def bounds(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Where the keys of each part begin and end, of ascending uint64 keys below 2**bits; parts + 1 places."""
    top = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    return np.searchsorted((top * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


BLOBS = "chunk long, part int, data binary"


def blobs(chunk: int, made: list[tuple[int, bytes]]) -> pa.Table:
    """Rows for Spark: what a chunk sends to each part."""
    return pa.table({"chunk": pa.array([chunk] * len(made), pa.int64()), "part": pa.array([p for p, _ in made], pa.int32()), "data": pa.array([d for _, d in made], pa.binary())})
