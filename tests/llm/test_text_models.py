"""op3, op4, op5, op6 and op10: rules, language models, tokens, languages and licences."""

from __future__ import annotations

import collections
import itertools
import math
import re
import time

import numpy as np
import oracle
import pyarrow as pa
import pytest
import sentencepiece
from evalweave.llm import language, language_model, licences, quality, sentencepieces
from hypothesis import given, settings
from hypothesis import strategies as st


def test_op3(spark, sf_dir):
    assert oracle.difference(quality.op3_quality_rules(spark, sf_dir), quality.OP3_SQL, sf_dir) == ""


def test_op3_where_cutoffs_bite(spark):
    """At sf0.1 there are labels enough for cutoffs, and rows are rejected."""
    sf_dir = "/root/testdata/sf0.1"
    assert oracle.difference(quality.op3_quality_rules(spark, sf_dir), quality.OP3_SQL, sf_dir) == ""
    assert quality.op3_quality_rules(spark, sf_dir).where("not keep").count() > 500


def test_cutoffs_by_brute_force(spark):
    """Rules that bite: the cutoffs against a search over all of them, and the promise on the labelled rows."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(4000):
        good = rng.random() < 0.8
        text = "plain words go here " * 5 if good else "#### junk %%%% " * 6
        rows.append((i, text, "en" if i % 2 else None, "s", len(text)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    levels = quality.features(docs)
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.cutoffs(levels, marks).collect()}
    pdf = levels.toPandas().merge(marks.toPandas(), on="doc_id")
    for stratum in ("en", None):
        mine = pdf[(pdf["stratum"] == "en" if stratum else pdf["stratum"].isna()) & (pdf["quality"] == 1)]
        for rule in quality.RULES:
            n, share, level = len(mine), quality.ALPHA / len(quality.RULES), quality.DELTA / (2 * len(quality.RULES))
            fine = [c for c in range(1001) if (k := int((mine[rule] >= c).sum())) <= n * share and quality.binomial_at_most(k, n, share) <= level]
            assert got.get((stratum, rule)) == (min(fine) if fine else None)
    judged = quality.judge(docs, marks).toPandas().merge(marks.toPandas(), on="doc_id")
    assert judged[judged["quality"] == 1]["keep"].mean() > 1 - quality.ALPHA
    assert not judged[judged["quality"] == 0]["keep"].any()


def test_binomial():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert quality.binomial_at_most(3, 50, 0.1) == pytest.approx(exact)


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(odd, none).collect()
    assert len(out) == odd.count() and all(r["keep"] for r in out)
    assert quality.judge(empty, none).count() == 0


def test_lm_by_brute_force(docs):
    few = docs.where("doc_id < 25")
    weights = np.random.default_rng(1).uniform(0.2, 0.8, (language_model.ORDER, language_model.BUCKETS))
    got = {r["doc_id"]: r for r in language_model.score(few, 20_000, weights).collect()}
    rows = few.collect()
    count: collections.Counter = collections.Counter()
    padded = {r["doc_id"]: b"\0" * 4 + r["text"].encode() for r in rows}
    for b in padded.values():
        for i in range(4, len(b)):
            for k in range(1, 6):
                count[b[i - k + 1 : i + 1]] += 1
                count[k, b[i - k + 1 : i]] += 1
    for doc_id, b in padded.items():
        total = 0.0
        for i in range(4, len(b)):
            p = 1 / 256
            for k in range(1, 6):
                c = count[k, b[i - k + 1 : i]]
                w = weights[5 - k, int(math.log2(c))]
                p = w * count[b[i - k + 1 : i + 1]] / c + (1 - w) * p
            total += math.log(p)
        assert got[doc_id]["n_bytes"] == len(b) - 4 and got[doc_id]["log_prob"] == pytest.approx(total, rel=1e-6)


def test_lm_learns(spark):
    """Each round of expectation-maximisation makes the held-out events likelier."""
    rng = np.random.default_rng(0)
    p, b = rng.random((400, 5)), rng.integers(-1, 4, (400, 5))
    p[b < 0] = 0
    names = ["weight", *[f"p{k}" for k in range(5, 0, -1)], *[f"b{k}" for k in range(5, 0, -1)]]
    events = spark.createDataFrame([(int(rng.integers(1, 5)), *map(float, x), *map(int, y)) for x, y in zip(p, b, strict=True)], ", ".join(f"{n} {'double' if n[0] == 'p' else 'int'}" for n in names))
    w0 = np.array(events.toPandas()["weight"])

    def likelihood(w):
        return float((w0 * np.log(language_model.mix(p, b, w)[0])).sum())

    seen = [likelihood(language_model.learn(events, rounds)) for rounds in (0, 1, 2, 5)]
    assert seen == sorted(seen) and seen[-1] > seen[0]


def test_packed_events(spark, monkeypatch):
    """Events that travel packed, many to a row, teach the same weights as a row each."""
    monkeypatch.setattr(language_model, "_PACKED", 300)
    rng = np.random.default_rng(2)
    weight, p, b = rng.integers(1, 5, 1000), rng.random((3, 1000)), rng.integers(-1, 40, (3, 1000))
    p[b < 0] = 0
    packed = language_model._packed(weight, list(p), list(b))
    assert len(packed) == 4
    names = ["weight", *[f"p{k}" for k in (3, 2, 1)], *[f"b{k}" for k in (3, 2, 1)]]
    rows = spark.createDataFrame([(int(w), *map(float, x), *map(int, y)) for w, x, y in zip(weight, p.T, b.T, strict=True)], ", ".join(f"{n} {'double' if n[0] == 'p' else 'int'}" for n in names))
    expected = language_model.learn(rows, 5, 1e-3)
    assert np.allclose(language_model.learn(spark.createDataFrame([(x,) for x in packed], "data binary"), 5, 1e-3, 3), expected, rtol=1e-9)
    assert (expected != 0.5).any()


def test_distinct_by_numpy():
    """Also values of which the lowest bits don't fit beside the indices, and differ only there."""
    rng = np.random.default_rng(3)
    near = (rng.integers(0, 30, 5000).astype(np.uint64) << np.uint64(59)) | rng.integers(0, 8, 5000).astype(np.uint64)
    for x in (near, near >> np.uint64(50), rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.full(3, 2**64 - 1, np.uint64), np.array([2**64 - 1, 0, 0], np.uint64), near[:1], near[:0]):
        values, place = language_model._distinct(x.copy())
        expected, inverse = np.unique(x, return_inverse=True)
        assert values.dtype == np.uint64 and values.tolist() == expected.tolist() and place.tolist() == inverse.tolist()


def test_word_model_by_brute_force(spark, docs, odd, empty):
    """Word trigrams, in several chunks; the query itself depends on word order; odd tables."""
    few = docs.where("doc_id < 25")
    weights = np.random.default_rng(1).uniform(0.2, 0.8, (3, language_model.BUCKETS))
    got = {r["doc_id"]: r for r in language_model.score_words(few, 20_000, weights).collect()}
    texts = {r["doc_id"]: ["", "", *r["text"].encode().split()] for r in few.collect()}
    count: collections.Counter = collections.Counter()
    for w in texts.values():
        for i in range(2, len(w)):
            for k in (1, 2, 3):
                count[tuple(w[i - k + 1 : i + 1])] += 1
                count["before", tuple(w[i - k + 1 : i])] += 1
    vocabulary = len({x for w in texts.values() for x in w[2:]})
    for doc_id, w in texts.items():
        total = 0.0
        for i in range(2, len(w)):
            p = 1 / vocabulary
            for k in (1, 2, 3):
                c = count["before", tuple(w[i - k + 1 : i])]
                x = weights[3 - k, int(math.log2(c))]
                p = x * count[tuple(w[i - k + 1 : i + 1])] / c + (1 - x) * p
            total += math.log(p)
        assert got[doc_id]["log_prob"] == pytest.approx(total, rel=1e-5)
    out = language_model.score_words(odd).collect()
    assert len(out) == odd.count() and all((r["bits_per_byte"] is None) == (r["n_bytes"] == 0) for r in out)
    assert language_model.score_words(empty).count() == 0


def test_learned_word_model_by_hand(spark, docs):
    """Held-out counts deleted, weights by expectation-maximisation, scores with them: all in plain Python."""
    few = docs.where("doc_id < 60").select("doc_id", "text")
    held = {r["doc_id"] for r in few.where(language_model._held()).collect()}
    assert held
    texts = {r["doc_id"]: ["", "", *r["text"].encode().split()] for r in few.collect()}
    n: collections.Counter = collections.Counter()
    kept: collections.Counter = collections.Counter()
    for d, w in texts.items():
        for i in range(2, len(w)):
            for k in (1, 2, 3):
                for c in (n, kept) if d not in held else (n,):
                    c[tuple(w[i - k + 1 : i + 1])] += 1
                    c["before", tuple(w[i - k + 1 : i])] += 1
    base = 1 / len({x for w in texts.values() for x in w[2:]})

    def terms(w, i, c):
        out = []
        for k in (3, 2, 1):
            before = c["before", tuple(w[i - k + 1 : i])]
            out.append((c[tuple(w[i - k + 1 : i + 1])] / before if before else 0.0, int(math.log2(before)) if before else -1))
        return out

    events = [terms(texts[d], i, kept) for d in held for i in range(2, len(texts[d]))]
    weights = np.full((3, language_model.BUCKETS), 0.5)

    def mixed(e):
        p, left, parts = 0.0, 1.0, []
        for k, (q, b) in enumerate(e):
            w = weights[k, b] if b >= 0 else 0.0
            parts.append(left * w * q)
            left *= 1 - w
        p = sum(parts) + left * base
        return p, parts

    for _ in range(language_model.ROUNDS):
        num, den = np.zeros_like(weights), np.zeros_like(weights)
        for e in events:
            p, parts = mixed(e)
            reach = 1.0
            for k, (_, b) in enumerate(e):
                if b >= 0:
                    num[k, b] += parts[k] / p
                    den[k, b] += reach
                reach -= parts[k] / p
        new = np.where(den > 0, np.minimum(num / np.where(den > 0, den, 1), 1 - 1e-6), weights)
        change, weights = np.abs(new - weights).max(), new
        if change < language_model.TOLERANCE:
            break
    for r in language_model.score_words(few, 30_000).collect():
        w = texts[r["doc_id"]]
        assert r["log_prob"] == pytest.approx(sum(math.log(mixed(terms(w, i, n))[0]) for i in range(2, len(w))), rel=1e-4)


def test_null_ids_spread(spark):
    """Documents without an id are held out one by one, not all or none."""
    df = spark.createDataFrame([(None, f"text number {i}") for i in range(400)], "doc_id long, text string")
    assert 5 < df.where(language_model._held()).count() < 60


def test_lm_odd(odd, empty):
    out = language_model.score(odd).collect()
    assert len(out) == odd.count()
    assert all((r["bits_per_byte"] is None) == (r["n_bytes"] == 0) for r in out)
    assert language_model.score(empty).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.Encoder(sentencepieces.Pieces.load(sentencepieces.MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)


def _encoded(encoder, texts):
    flat, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


@given(st.lists(st.one_of(st.text(max_size=60), st.text("aeinorst  \n", max_size=120), st.text("-=*#_/ .", max_size=60)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_as_the_library(encoder, library, texts):
    assert _encoded(encoder, texts) == [library.encode(t) for t in texts]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=80), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_round_trip(encoder, texts):
    flat, counts = encoder.encode(texts)
    data, sizes = encoder.decode(flat, counts)
    ends = np.cumsum(sizes)
    assert [bytes(data[e - s : e]).decode() for e, s in zip(ends, sizes, strict=True)] == texts


@pytest.mark.parametrize("text", ["", " ", " " * 41, " " * 33 + "a", "    日", "a" * 300, "<s></s><unk>", "<0x0A>", "x\r\ny", "0" * 99])
def test_hard_texts(encoder, library, text):
    assert _encoded(encoder, [text]) == [library.encode(text)]


def test_long_words(encoder, library):
    """Texts without spaces, of all kinds, as the library has them; a megabyte in seconds."""
    rng = np.random.default_rng(6)
    for alphabet in ("ab", "aeinorst", "ACGT", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "日本語のテキスト", "é😀x"):
        for n in (257, 1000, 3000):
            text = "".join(rng.choice(list(alphabet), n))
            assert _encoded(encoder, [text, "   " + text]) == [library.encode(text), library.encode("   " + text)]
    began = time.time()
    flat, _ = encoder.encode(["".join(rng.choice(list("abcdefghijklmnop0123456789"), 200_000))])
    assert len(flat) and time.time() - began < 60


def test_words_of_all_lengths_together(encoder, library, monkeypatch):
    """Words of any lengths take one pass over positions, not one for each length; also in several lots, with spaces before and outside characters."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeinorstlé😀日"), n, p=[0.11] * 9 + [0.004, 0.003, 0.003])) for n in range(2, 61) for _ in range(4)]
    texts = [" ".join(words), "  ".join(reversed(words)), "   " + words[-1] + "    "]
    asked = []
    may_follow = encoder.pieces.may_follow
    monkeypatch.setattr(encoder.pieces, "may_follow", lambda first, second: asked.append(len(first)) or may_follow(first, second))
    fresh = sentencepieces.Encoder(encoder.pieces)
    assert _encoded(fresh, texts) == [library.encode(t) for t in texts]
    assert len(asked) <= 62 * encoder.pieces.longest
    monkeypatch.setattr(sentencepieces, "_TOGETHER", 50)
    assert _encoded(sentencepieces.Encoder(encoder.pieces), texts) == [library.encode(t) for t in texts]


def test_op5(docs, library):
    for r in sentencepieces.encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["token_ids"] == library.encode(r["text"]) and r["decoded"] == r["text"] and r["n_tokens"] == len(r["token_ids"])


def test_pieces_odd(odd, empty, encoder, monkeypatch):
    rows = sentencepieces.encode_documents(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["token_ids"] is None and by[3]["decoded"] is None and by[4]["token_ids"] == [] and by[4]["decoded"] == ""
    assert by[9]["decoded"] == "日本語のテキスト 😀   \x00  " and by[6]["decoded"].endswith("word end")
    assert sentencepieces.encode_documents(empty).count() == 0
    monkeypatch.setattr(sentencepieces, "KEEP_WORDS", 3)
    small = sentencepieces.Encoder(encoder.pieces)
    for text in ("one two three four five", "six seven one two", "three eight"):
        assert _encoded(small, [text]) == _encoded(encoder, [text])


def test_codewords():
    for k in (2, 3, 4, 7, 12):
        code = language.codewords(k)
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        assert code.shape[0] == k and least >= {2: 1, 3: 2, 4: 4, 7: 32, 12: 8}[k]


def test_language_accuracy(spark):
    """Trained on one half, held against the labels of the other."""
    pdf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 40").toPandas()
    train, held = pdf[pdf["doc_id"] % 2 == 0], pdf[pdf["doc_id"] % 2 == 1]
    model = language.fit(train["text"].tolist(), train["lang"].tolist())
    best, _, gap, _ = model.decode(pa.array(held["text"]))
    said = np.array(model.languages)[best]
    assert (said == held["lang"].to_numpy()).mean() >= 0.98
    assert (gap < model.least_gap).mean() < 0.02


def test_language_by_brute_force(docs):
    """Counts, weights and decoding byte by byte in plain Python."""
    rows = [(r["text"], r["lang"]) for r in docs.where("length(text) between 20 and 400").orderBy("doc_id").limit(60).collect()]
    model = language.fit([t for t, _ in rows], [x for _, x in rows])
    mask, space = (1 << 64) - 1, set(b" \t\n\x0b\x0c\r")

    def buckets(text):
        x = [32 if c in space else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in text.encode()]
        for i, first in enumerate(x):
            code = 0
            for k in range(4):
                if i + k < len(x):
                    code = ((code ^ x[i + k]) * int(language._STEP[k])) & mask
                    code ^= code >> 29
                    if first != 32:
                        yield ((code * 0x9E3779B97F4A7C15 + k + 1) & mask) >> (64 - language.BITS)

    seen: collections.Counter = collections.Counter()
    counts = {x: collections.Counter() for x in model.languages}
    for t, x in rows:
        seen[x] += 1
        if seen[x] % 4:
            counts[x].update(buckets(t))
    total = {x: sum(c.values()) for x, c in counts.items()}
    scale = sum(total.values()) / len(total)

    def weight(bucket, bit):
        side = {s: [counts[x][bucket] / total[x] for i, x in enumerate(model.languages) if model.code[i, bit] == s] for s in (1, -1)}
        plus, minus = (sum(v) / len(v) + 0.5 / scale for v in (side[1], side[-1]))
        return math.log(plus / minus)

    texts = [t for t, _ in rows][:12]
    best, loss, gap, count = model.decode(pa.array(texts))
    for k, t in enumerate(texts):
        b = list(buckets(t))
        margin = [sum(weight(x, bit) for x in b) / len(b) for bit in range(model.code.shape[1])]
        losses = sorted((float(np.mean([math.log1p(math.exp(-4 * m * c)) for m, c in zip(margin, code, strict=True)])), i) for i, code in enumerate(model.code))
        assert count[k] == len(b) and best[k] == losses[0][1]
        assert loss[k] == pytest.approx(losses[0][0], rel=1e-4) and gap[k] == pytest.approx(losses[1][0] - losses[0][0], rel=1e-3, abs=1e-6)


def test_languages_without_ids(spark):
    """Null and repeated ids: the sample spreads over the rows, and languages are told."""
    words = {"en": "the of and with this that from have".split(), "de": "der und nicht mit dass eine wird sein".split()}
    rng = np.random.default_rng(1)
    rows = [(None if i % 2 else 7, " ".join(rng.choice(words[x], 12)), x, "s", 1) for i in range(1500) for x in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = language.identify(df)
    assert out.where("identified = lang").count() > 0.98 * len(rows)


def test_language_odd(spark, odd, empty):
    out = language.identify(odd)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count()
    assert by[5]["identified"] is None and by[5]["rejected"] and by[3]["rejected"] and by[4]["ambiguous"]
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and not {3, 4, 5, 10} & {r["doc_id"] for r in kept.collect()}
    assert language.identify(empty).count() == 0 and language.keep_identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    r = language.identify(unlabelled).first()
    assert r["identified"] is None and not r["rejected"] and language.keep_identified(unlabelled).count() == 1
    one = spark.createDataFrame([(1, "some text", "en"), (2, "other", None)], "doc_id long, text string, lang string")
    assert {r["identified"] for r in language.identify(one).collect()} == {"en"}


@pytest.mark.parametrize(
    ("text", "tree", "kind"),
    [
        ("MIT", "MIT", "permissive"), ("mit or GPL-3.0", "MIT OR GPL-3.0-only", "permissive"), ("MIT AND GPL-2.0-only", "MIT AND GPL-2.0-only", "copyleft"),
        ("MIT OR Apache-2.0 AND AGPL-3.0-only", "MIT OR Apache-2.0 AND AGPL-3.0-only", "permissive"), ("(MIT OR Apache-2.0) AND AGPL-3.0-only", "(MIT OR Apache-2.0) AND AGPL-3.0-only", "network-copyleft"),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0", "weak-copyleft"), ("LGPL-2.1+ */", "LGPL-2.1-or-later", "weak-copyleft"),
        ("LicenseRef-Own", "LicenseRef-Own", "unknown"), ("MIT some words after", "MIT", "permissive"),
    ],
)
def test_expressions(text, tree, kind):
    node, _ = licences.parse(text)
    assert str(node) == tree and node.kind() == kind


def test_long_expressions():
    for text, names, kind in (
        (" OR ".join(["GPL-3.0-only"] * 49_999 + ["MIT"]), 50_000, "permissive"), ("(" * 50_000 + "MIT" + ")" * 50_000, 1, "permissive"), ("MIT AND (" * 20_000 + "GPL-3.0-only" + ")" * 20_000, 20_001, "copyleft"), ("(" * 30_000 + "MIT", 0, "unknown"),
    ):
        node, _ = licences.parse(text)
        assert node is None if not names else len(node.names()) == names and node.kind() == kind and str(node)
        assert licences.scan(f"SPDX-License-Identifier: {text}", licences.automaton())[2] == kind


@pytest.mark.parametrize("text", ["", "MIT AND", "(MIT", "AND MIT", "()", "MIT OR OR MIT"])
def test_broken_expressions(text):
    assert licences.parse(text)[0] is None


@given(st.recursive(st.sampled_from(["MIT", "GPL-3.0-only", "MPL-2.0", "AGPL-3.0-only"]), lambda x: st.tuples(x, st.sampled_from(["AND", "OR"]), x), max_leaves=8))
@settings(max_examples=100, deadline=None)
def test_expressions_by_brute_force(tree):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[0])} {t[1]} {text(t[2])})"

    def rank(t):
        if isinstance(t, str):
            return licences.RANKS.index(licences.KIND_OF[t.lower()])
        return (min if t[1] == "OR" else max)(rank(t[0]), rank(t[2]))

    node, taken = licences.parse(text(tree))
    assert licences.RANKS.index(node.kind()) == rank(tree) and taken == text(tree)
    assert licences.parse(str(node))[0].kind() == node.kind()


def test_scan(docs):
    found = licences.automaton()
    names, expressions, kind = licences.scan("# SPDX-License-Identifier: MIT OR GPL-2.0-only\n... Licensed  under the\nApache License, Version 2.0 (", found)
    assert (names, expressions, kind) == (["Apache-2.0", "GPL-2.0-only", "MIT"], ["MIT OR GPL-2.0-only"], "permissive")
    assert licences.scan("GNU General Public License, version 3 or later.", found)[0] == ["GPL-3.0-or-later"]
    assert licences.scan("summit license", found) == ([], [], "none")
    assert licences.scan("SPDX-License-Identifier: MIT AND", found)[2] == "unknown"
    for r in docs.select("text").collect():
        level = " ".join(r["text"].lower().split())
        want = set()
        spans = sorted(((m.start(), -len(p), i) for p, i in licences.PHRASES.items() if i for m in re.finditer(re.escape(p), level)))
        end = 0
        for start, size, identifier in spans:
            if start >= end:
                end = start - size
                if licences._edge(level, start - 1) and licences._edge(level, end):
                    want.add(identifier)
        assert set(licences.scan(r["text"], found)[0]) == want


_FSF = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as
published by the Free Software Foundation{1} version {2} of the License{3}. This program is distributed in the hope that it will be useful. See the
GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program."""
_BSD = "Copyright (c) 2010, A. Author. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that"


@pytest.mark.parametrize(
    ("text", "names", "kind"),
    [
        (_FSF.format("", "; either", "2", ", or (at your option) any later version"), ["GPL-2.0-or-later"], "copyleft"), (_FSF.format("", ", either", "3", ", or (at your option) any later version"), ["GPL-3.0-or-later"], "copyleft"),
        (_FSF.format("", ";", "2", ""), ["GPL-2.0-only"], "copyleft"), (_FSF.format("Lesser ", "; either", "2.1", ", or (at your option) any later version"), ["LGPL-2.1-or-later"], "weak-copyleft"),
        (_FSF.format("Library ", "; either", "2", ", or (at your option) any later version"), ["LGPL-2.0-or-later"], "weak-copyleft"), (_FSF.format("Affero ", ", either", "3", ", or (at your option) any later version"), ["AGPL-3.0-or-later"], "network-copyleft"),
        ("released under the GNU GPL.", ["GPL-1.0-or-later"], "copyleft"), ("the GNU General Public License applies", ["GPL-1.0-or-later"], "copyleft"), ("GNU GPLv3+ code", ["GPL-3.0-or-later"], "copyleft"), ("GNU GPL v2", ["GPL-2.0-only"], "copyleft"),
        ("under version 2 or later of the GNU General Public License", ["GPL-2.0-or-later"], "copyleft"),
        (_BSD, ["BSD-2-Clause"], "permissive"), (_BSD + " ... may be used to endorse or promote products derived from this software", ["BSD-3-Clause"], "permissive"),
        (_BSD + " ... All advertising materials mentioning features or use of this software ... endorse or promote products derived from", ["BSD-4-Clause"], "permissive"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", ["ISC"], "permissive"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED", ["0BSD"], "public-domain"),
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["Zlib"], "permissive"),
        ("Copyright 2010. All rights reserved.", ["LicenseRef-Proprietary"], "proprietary"), ("used to endorse or promote products derived from", [], "none"),
    ],
)
def test_standard_headers(text, names, kind):
    found = licences.scan(text, licences.automaton())
    assert (found[0], found[2]) == (names, kind)


def test_licences_odd(odd, empty):
    out = licences.scan_licences(odd).collect()
    assert len(out) == odd.count() and all(r["restriction"] == "none" and r["allowed"] for r in out)
    assert licences.scan_licences(empty).count() == 0
