"""Packed keys and chunks of documents."""

from __future__ import annotations

import numpy as np
from evalweave.llm import exchange
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

U64 = st.integers(0, 2**64 - 1)


@given(st.lists(st.one_of(U64, st.integers(0, 300)), max_size=80), st.lists(st.one_of(st.integers(0, 5), U64), max_size=80))
@settings(max_examples=200, deadline=None)
def test_packing(keys, numbers):
    keys = np.array(sorted(set(keys)), dtype=np.uint64)
    numbers = np.array(numbers, dtype=np.uint64)
    u = exchange.Unpacker(exchange.Packer().keys(keys).numbers(numbers).raw(numbers > 3, "u1").keys(keys[:1]).done())
    assert u.keys().tolist() == keys.tolist() and u.numbers().tolist() == numbers.tolist()
    assert u.raw("u1").tolist() == (numbers > 3).astype(int).tolist() and u.keys().tolist() == keys[:1].tolist()


@given(st.lists(U64, max_size=60), st.sampled_from([1, 2, 7, 100]), st.sampled_from([16, 31, 32, 40, 64]))
@settings(max_examples=100, deadline=None)
def test_parts(keys, parts, bits):
    keys = np.array(sorted({k >> (64 - bits) for k in keys}), dtype=np.uint64)
    at = exchange.bounds(keys, parts, bits)
    assert at[0] == 0 and at[-1] == len(keys) and len(at) == parts + 1 and (np.diff(at) >= 0).all()
    for p in range(parts):
        assert all(int(k) * parts >> bits == p or bits > 32 for k in keys[at[p] : at[p + 1]])


def test_chunks(spark, odd, docs):
    """Every row is in one chunk, held-out ones in chunks of odd number; chunks hold whole rows and about so many bytes."""
    for table, size in ((docs, 20_000), (odd.select("doc_id", "text"), 100)):
        marked = table.select("doc_id", "text", (F.xxhash64("text") % 3 == 0).alias("held"))
        chunks, _ = exchange.write_chunks(marked, exchange.text_bytes(table), size)
        rows = chunks.collect()
        assert len({r["chunk"] for r in rows}) == len(rows)
        got = [(r["chunk"] % 2 == 1, d, t) for r in rows for d, t in zip(*exchange.opened(bytes(r["data"])).to_pydict().values(), strict=True)]
        want = [(bool(r["held"]), r["doc_id"], r["text"]) for r in marked.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_stay_where_they_are(spark, docs):
    """The plan that meets chunks with answers shuffles the answers only."""
    chunks, buckets = exchange.write_chunks(docs.select("doc_id", "text", F.lit(False).alias("held")), exchange.text_bytes(docs))
    answers = docs.select(F.col("doc_id").alias("chunk"), F.lit(1).alias("step"))
    plan = exchange.with_answers(chunks, answers, buckets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
