"""op8 and op9: exact and near duplicates."""

from __future__ import annotations

import numpy as np
import oracle
import pyarrow as pa
import pytest
from evalweave.llm import exact, simhash
from hypothesis import given, settings
from hypothesis import strategies as st

U64 = st.integers(0, 2**64 - 1)


@given(st.lists(U64, min_size=1, max_size=60), st.lists(U64, min_size=1, max_size=60), st.sampled_from([0, 3]))
@settings(max_examples=60, deadline=None)
def test_quotient_filter(a, b, drop):
    mask = (1 << (64 - drop)) - 1 if drop else 2**64 - 1
    a, b = [x & mask for x in a] + a[:1] * 0, [x & mask for x in b]
    b += a[:5]

    def made(xs):
        keys, counts = np.unique(np.array(xs, dtype=np.uint64), return_counts=True)
        return exact.QuotientFilter.unpack(exact.QuotientFilter.of_sorted(keys, counts, drop).pack())

    merged = made(a).merge(made(b))
    keys, counts = np.unique(np.array(a + b, dtype=np.uint64), return_counts=True)
    assert merged.keys().tolist() == keys.tolist() and merged.counts.tolist() == counts.tolist()
    again = exact.QuotientFilter.unpack(merged.pack())
    assert again.keys().tolist() == keys.tolist()


def test_op8(spark, sf_dir):
    assert oracle.difference(exact.op8_exact_dedup(spark, sf_dir), exact.OP8_SQL, sf_dir) == ""


def test_many_filters(docs):
    prints = docs.selectExpr("xxhash64(text) AS fp")
    some, _ = exact.repeated_fingerprints(prints, filter_keys=8)
    want = prints.groupBy("fp").count().where("count > 1")
    assert {r["fp"] for r in some.collect()} == {r["fp"] for r in want.collect()}


def test_exact_odd(odd, empty):
    assert sorted((r["doc_id"], r["keep_id"], r["n_copies"]) for r in exact.find_copies(odd).collect()) == [(1, 1, 3), (2, 1, 3), (10, 4, 2)]
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "6", "7", "8", "9"])
    assert exact.find_copies(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_fingerprints_by_brute_force():
    from evalweave.llm import kernels

    texts = ["one two three two", "", " \n", "x", " ".join(f"w{i % 700}" for i in range(2000)), None, "é é é"]
    fp, has = simhash.fingerprints(pa.array(texts))
    assert has.tolist() == [True, False, False, True, True, False, True]
    for t, got in zip(texts, fp, strict=True):
        words = {w for w in (t or "").encode().split()}
        if not words:
            continue
        s = next(kernels.slices(pa.array([" ".join(w.decode() for w in words)])))
        h = kernels.words(s).hash
        both = [h, kernels.mix(h ^ np.uint64(0x5851F42D4C957F2D))]
        bits = np.concatenate([np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1) for x in both], axis=1)
        assert (np.packbits(bits.sum(axis=0) * 2 > len(h)).view(np.uint64) == got).all()


@pytest.mark.parametrize("n", [2, 63, 64, 65, 200])
def test_bit_slices(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2, (max(2, n // 4), simhash.NBITS), dtype=np.uint8)
    bits = base[rng.integers(0, len(base), n)] ^ (rng.random((n, simhash.NBITS)) < 0.09).astype(np.uint8)
    distance = (bits[:, None, :] != bits[None]).sum(axis=2)
    planes = simhash.planes_of(bits)
    valid = np.packbits(np.arange(planes.shape[1] * 64).reshape(-1, 64) < n, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    q = np.repeat(np.arange(n), planes.shape[1])
    block = np.tile(np.arange(planes.shape[1]), n)
    p, lane = simhash.within(planes, block, bits[q], valid[block], 24)
    assert set(zip(q[p].tolist(), (block[p] * 64 + lane).tolist(), strict=True)) == set(zip(*np.nonzero(distance <= 24), strict=True))
    i, j = np.nonzero(distance <= 24)
    want = simhash._components(n, i, j)
    for got in (simhash._links_all(bits, np.array([0]), np.array([n]), 24), simhash._links_search(bits, 24)):
        label = np.arange(n)
        label[got[0]] = got[1]
        assert (label == want).all()


def test_op9_recall(spark, docs, sf_dir):
    """Against all pairs within the radius, every document a query."""
    pdf = docs.toPandas()
    fp, has = simhash.fingerprints(pa.array(pdf["text"]))
    bits = simhash._unpack(fp)
    keep = {r["doc_id"]: r["keep_id"] for r in simhash.op9_simhash_near_dedup(spark, sf_dir).collect()}
    ids = pdf["doc_id"].tolist()
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero((bits[i] != bits[i + 1 :]).sum(axis=1) <= simhash.RADIUS) + i + 1 if has[i] and has[j]]
    found = sum(keep.get(a, a) == keep.get(b, b) for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    grouped = {frozenset((a, b)) for a, b in keep.items()}
    assert len(grouped) == len(keep)


@pytest.mark.parametrize("bits", [16, 20, 30])
def test_recall_by_distance(bits):
    """Pairs of every distance up to the radius meet in some table with probability RECALL or more, whatever the key's length."""
    choice = simhash._choices(bits)
    rng = np.random.default_rng(bits)
    for distance in (10, 19, 20, 21, 22, 23, simhash.RADIUS):
        differ = np.zeros((600, simhash.NBITS), dtype=bool)
        for row in differ:
            row[rng.choice(simhash.NBITS, distance, replace=False)] = True
        meet = np.zeros(len(differ), dtype=bool)
        for c in choice:
            meet |= ~differ[:, c].any(axis=1)
        assert meet.mean() >= simhash.RECALL - 0.04


def test_near_odd(odd, empty):
    got = sorted((r["doc_id"], r["keep_id"]) for r in simhash.find_near(odd).collect())
    assert got == [(2, 1)]
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted(["1", "3", "4", "5", "None", "6", "7", "8", "9", "10"])
    assert simhash.find_near(empty).count() == 0 and simhash.drop_near(empty).count() == 0


def test_near_rows_are_decided_one_by_one(spark):
    """One id with several texts, null ids and ids that are texts: no row goes that isn't near a row that stays."""
    rng = np.random.default_rng(8)
    a, u, v = (" ".join(f"{x}{i}" for i in rng.permutation(60)) for x in "auv")
    rows = [(1, a), (2, a + " tail"), (2, u), (None, a), (None, v), (None, v + " tail"), (3, u), (3, u), (None, None), (4, "")]
    for kind, cast in (("long", lambda x: x), ("string", lambda x: None if x is None else f"d{x}"), ("int", lambda x: x)):
        docs = spark.createDataFrame([(cast(i), t) for i, t in rows], f"doc_id {kind}, text string")
        kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near(docs).collect()]
        assert sorted(kept[:], key=str) == sorted([(cast(1), a), (cast(2), u), (None, None), (cast(4), "")] + [x for x in kept if x[1] in (v, v + " tail")], key=str)
        assert sum(t in (v, v + " tail") for _, t in kept) == 1
        near = {(r["doc_id"], r["keep_id"]) for r in simhash.find_near(docs).collect()}
        assert near == {(cast(2), cast(1)), (None, cast(1)), (cast(3), cast(2))}


def test_large_buckets(monkeypatch):
    """Buckets of hundreds of like fingerprints: links, not pairs, and the same groups by either search."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (3, simhash.NBITS), dtype=np.uint8)
    bits = base[rng.integers(0, 3, 1500)] ^ (rng.random((1500, simhash.NBITS)) < 0.04).astype(np.uint8)
    one = simhash._links_all(bits, np.array([0]), np.array([1500]), 24)
    other = simhash._links_search(bits, 24)
    labels = []
    for m, root in (one, other):
        label = np.arange(1500)
        label[m] = root
        labels.append(label.tolist())
    assert labels[0] == labels[1] and len(one[0]) < 1500


@pytest.mark.parametrize("n", [1, 300, 20_000, 2**24, 2**36])
def test_keys_follow_the_input(n):
    bits = simhash.key_bits(n)
    assert n / 2**bits <= simhash.BUCKET and (bits == 0 or n / 2**bits > simhash.BUCKET / 2) and simhash.tables_for(bits) >= 1


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (10, 8), (10, 9), (7, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} == {(3, 1), (4, 1), (5, 1), (7, 1), (9, 8), (10, 8)}
