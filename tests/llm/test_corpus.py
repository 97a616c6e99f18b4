"""op1, op2, op7 and the pipeline."""

from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
import numpy as np
import oracle
import pytest
from evalweave.llm import mixing, suffixes, wrappers
from evalweave.llm.common import fresh, shared_dir
from pyspark.sql import functions as F


def test_op1(spark, sf_dir):
    assert oracle.difference(mixing.op1_mix_sources(spark, sf_dir), mixing.OP1_SQL, sf_dir) == ""


def _tokens(df):
    return {r["source"]: r["t"] for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing._TOKEN))).alias("t")).collect()}


@pytest.mark.parametrize("weights", [{}, {"src0": 40, "src1": 0}])
def test_budgets(docs, weights):
    taken = {r["source"]: r["t"] for r in mixing.mix_sources(docs, weights).groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()}
    whole = _tokens(docs)
    w = {s: weights.get(s, 1) for s in whole}
    budget = {s: sum(whole.values()) * w[s] // sum(w.values()) for s in whole}
    assert taken == {s: b for s, b in budget.items() if b}
    mixed = mixing.mix_documents(docs, weights)
    assert mixed.columns == docs.columns and _tokens(mixed) == taken


def test_small_parts(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "PART_ROWS", 2)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == want


def test_mixing_odd(spark, odd, empty):
    rows = mixing.mix_sources(odd, {}).collect()
    assert not {3, 4, 5, 10} & {r["doc_id"] for r in rows}
    out = mixing.mix_documents(odd, {})
    assert out.columns == odd.columns
    assert sum(_tokens(out).values()) == sum(r["take_tokens"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d", "en", "x", 7)] * 7 + [(2, "e", "en", "y", 1)], odd.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert _tokens(mixing.mix_documents(same, {"y": 3})) == {"x": 7, "y": 21}


def _maximal(docs, least):
    """All maximal repeats by trying every substring."""
    words = {d: (t or "").split() for d, t in docs}
    places = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w)):
            for j in range(i + least, len(w) + 1):
                places[tuple(w[i:j])].add((d, i))
    out = set()
    for s, where in places.items():
        left = {words[d][i - 1] if i else (d, "^") for d, i in where}
        right = {words[d][i + len(s)] if i + len(s) < len(words[d]) else (d, "$") for d, i in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(s), tuple(sorted(where))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_by_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    docs = []
    for d in range(40):
        w: list[str] = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))] + rng.choice(pool)[rng.randint(0, 4) :]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    docs += [(40, docs[3][1]), (3, docs[3][1]), (41, None), (42, "")]
    got = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    assert {(r["n_words"], tuple(sorted(zip(r["doc_ids"], r["word_at"], strict=True)))) for r in got} == _maximal(docs, 6)
    assert all(r["n_occurrences"] == len(r["doc_ids"]) for r in got)


def test_repeats_in_many_chunks(spark):
    """Copies, also with other white space, rows that repeat, ids that are texts or null, in chunks of a few texts: all the same."""
    rng = random.Random(9)
    pool = [[f"p{k}{i}" for i in range(rng.randint(8, 30))] for k in range(4)]
    docs = []
    for d in range(60):
        w = [x for _ in range(rng.randint(1, 3)) for x in [f"u{d}"] * rng.randint(0, 2) + rng.choice(pool)[rng.randint(0, 3) :]]
        docs.append((f"d{d}", " ".join(w)))
    docs += [(f"c{k}", docs[3][1].replace(" ", "\n")) for k in range(5)] + [docs[3], docs[3], (None, docs[4][1]), (None, docs[4][1]), ("short", "a b"), ("none", None)]
    alone = [f"alone{i}" for i in range(12)]
    docs += [("x1", " ".join(alone)), ("x2", "  ".join(alone)), ("x1", " ".join(alone))]
    got = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id string, text string"), 6, chunk_bytes=700).collect()
    named = {(r["n_words"], tuple(sorted((str(d), i) for d, i in zip(r["doc_ids"], r["word_at"], strict=True)))) for r in got}
    assert named == _maximal({(str(d), " ".join((t or "").split())) for d, t in docs}, 6)
    assert len(got) == len(named) and any(r["n_words"] == 12 and sorted(r["doc_ids"]) == ["x1", "x2"] for r in got)


def _periodic(words, least):
    return any(all(a == b for a, b in zip(words, words[p:], strict=False)) for p in range(1, least))


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_after_runs_by_brute_force(spark, seed):
    """Texts with runs of differing length, periods and continuations: whatever isn't a run itself is found with all its occurrences."""
    rng = random.Random(seed)
    roots = [["x"], ["p", "q"], ["r", "r", "s"], ["a", "b", "c", "d"]]
    tails = [[f"t{k}{i}" for i in range(9)] for k in range(3)]
    docs = []
    for d in range(30):
        w: list[str] = []
        for _ in range(rng.randint(1, 3)):
            root, n = rng.choice(roots), rng.randint(3, 26)
            shift = rng.randrange(len(root))
            w += [f"l{rng.randrange(3)}"] * rng.randint(0, 1) + [root[(shift + i) % len(root)] for i in range(n)] + rng.choice(tails)[: rng.choice([0, 2, 9])]
        docs.append((d, " ".join(w)))
    words = {d: t.split() for d, t in docs}
    got = {}
    for r in suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect():
        where = tuple(sorted(zip(r["doc_ids"], r["word_at"], strict=True)))
        d, i = where[0]
        got[tuple(words[d][i : i + r["n_words"]])] = where
        assert all(words[d][i : i + r["n_words"]] == words[where[0][0]][where[0][1] : where[0][1] + r["n_words"]] for d, i in where)
    want = {tuple(words[where[0][0]][where[0][1] : where[0][1] + n]): where for n, where in _maximal(docs, 6)}
    assert {k: v for k, v in got.items() if not _periodic(k, 6)} == {k: v for k, v in want.items() if not _periodic(k, 6)}
    assert all(set(v) <= set(want.get(k, v)) for k, v in got.items())


def _runs_of_words(seed):
    """Texts with runs of differing period, length and begin, periods within periods, copies, and passages that go on after runs."""
    rng = random.Random(seed)
    roots = [["x"], ["p", "q"], ["r", "r", "s"], ["a", "a", "a", "a", "b"], ["a", "a", "b"], ["a", "b", "c", "d", "e"]]
    tails = [[f"t{k}{i}" for i in range(9)] for k in range(3)]
    docs = []
    for d in range(24):
        w: list[str] = []
        for _ in range(rng.randint(1, 3)):
            root, n = rng.choice(roots), rng.randint(3, 30)
            shift = rng.randrange(len(root))
            w += [f"l{rng.randrange(3)}"] * rng.randint(0, 1) + [root[(shift + i) % len(root)] for i in range(n)] + rng.choice(tails)[: rng.choice([0, 2, 9])]
        docs.append((d, " ".join(w)))
    return [*docs, (24, docs[5][1]), (25, docs[5][1]), (26, "x " * 40), (27, "x " * 33)]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_repeats_in_runs_by_brute_force(spark, seed):
    """Every occurrence of every repeat, those that overlap in a run too."""
    docs = _runs_of_words(seed)
    got = set()
    for r in suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), 6, chunk_bytes=2000).collect():
        where = [(d, at + step * i) for d, at, step, times in zip(r["doc_ids"], r["word_at"], r["step"], r["times"], strict=True) for i in range(times)]
        assert r["n_occurrences"] == len(where) == len(set(where))
        got.add((r["n_words"], tuple(sorted(where))))
    assert got == _maximal(docs, 6)


def test_long_runs(spark):
    """The repeats of two runs of 20,000 words take two items each, not as many as there are pairs of places."""
    docs = [(1, "word " * 20_000 + "end"), (2, "word " * 20_000 + "end more")]
    rows = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["n_words"]: (r["n_occurrences"], sorted(r["doc_ids"])) for r in rows} == {n: (2 * (20_001 - n), [1, 2]) for n in range(50, 20_000)} | {20_001: (2, [1, 2])}


def test_passage_after_runs(spark):
    shared = [f"s{i}" for i in range(500)]
    docs = [(d, " ".join([f"{d}0", *["x"] * n, *shared, f"{d}1"])) for d, n in ((1, 70), (2, 60))]
    rows = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert any(r["n_words"] == 560 and sorted(zip(r["doc_ids"], r["word_at"], strict=True)) == [(1, 11), (2, 1)] for r in rows)


def test_winnowing_covers_every_window():
    rng = np.random.default_rng(0)
    for n in (49, 50, 51, 400):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        at, _ = suffixes.anchors(h, np.array([0, n]))
        for p in range(n - 49):
            assert any(p <= a <= p + 25 for a in at)
        assert len(at) == 0 or n >= 50


def test_planted_passage(spark, docs):
    passage = " ".join(f"planted{i}" for i in range(53))
    some = docs.select("doc_id", F.when(F.col("doc_id") % 40 == 3, F.concat("text", F.lit(" " + passage + " "), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    want = sorted(r["doc_id"] for r in docs.where("doc_id % 40 = 3").collect())
    assert any(sorted(r["doc_ids"]) == want and r["n_words"] >= 53 for r in suffixes.repeated_passages(some).collect())


def _unfolded(rows):
    """(words, occurrences) of each passage of a tree: those of its rows and of all passages within it."""
    outer, n_words, where = {}, {}, collections.defaultdict(set)
    for r in rows:
        outer[r["group_id"]], n_words[r["group_id"]] = r["within"], r["n_words"]
    for r in rows:
        group = r["group_id"]
        while group and not r["longer"]:
            where[group].add((r["doc_id"], r["word_at"]))
            group = outer[group]
    assert all(r["n_occurrences"] == len(where[r["group_id"]]) for r in rows)
    assert all((r["doc_id"], r["word_at"]) in where[r["group_id"]] for r in rows)
    return {(n_words[g], tuple(sorted(w))) for g, w in where.items()}


@pytest.mark.parametrize("seed", [5, 8])
def test_passage_tree_by_brute_force(spark, seed):
    """A row for each place in a text holds all occurrences of all repeats."""
    docs = _runs_of_words(seed)
    rows = suffixes.passage_tree(spark.createDataFrame(docs, "doc_id long, text string"), 6, chunk_bytes=2000).collect()
    assert _unfolded(rows) == _maximal(docs, 6)
    own = [(r["doc_id"], r["word_at"]) for r in rows if not r["longer"]]
    assert len(own) == len(set(own))


def test_repeats_by_document(spark, tmp_path):
    """The query's rows name one document each, by its integer id or null, and where in it."""
    passage = " ".join(f"p{i}" for i in range(53))
    rows = [(1, f"a b {passage} c"), (2, f"d {passage} e"), (None, f"{passage} f"), (4, "g h")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffixes.op2_suffix_repeats(spark, str(tmp_path))
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert sorted(((r["doc_id"], r["word_at"]) for r in got.collect()), key=str) == [(1, 2), (2, 1), (None, 0)]
    assert {(r["n_words"], r["n_occurrences"], r["longer"]) for r in got.collect()} == {(53, 3, False)}


def test_repeats_odd(odd, empty):
    rows = suffixes.repeated_passages(odd).collect()
    assert rows and all(set(r["doc_ids"]) <= {6, 7} for r in rows)
    assert suffixes.repeated_passages(empty).count() == 0


def _page(items, ad=None, title="T", foot="about us"):
    return f"<html><head><title>{title}</title><script>x='<p>'</script></head><body><nav><a href='/'>home</a></nav>{f'<div class=ad>{ad}</div>' if ad else ''}<ul>" + "".join(f"<li><b>{i}</b> kg" for i in items) + f"</ul><p>{foot}</body></html>"


def test_wrapper():
    streams = [wrappers.fold(wrappers.tokens(_page(items, ad))[0])[0] for items, ad in ((["a", "b", "c"], None), (["a"], "buy"), (["a", "b"], "buy"))]
    w, maps = wrappers.induce(streams)
    assert w.text() == "<html> <head> <title> #PCDATA </title> </head> <body> <nav> <a> #PCDATA </a> </nav> (<div.ad> #PCDATA </div>)? <ul> (<li> #PCDATA </li>)+ </ul> <p> #PCDATA </p> </body> </html>"
    assert maps[0] == [0, 1, 2, 3] and maps[1] == [0, 1, 4, 2, 3] and w.asides() == [True, True, False, False, True]


def test_extraction(spark):
    pages = [(1, "https://h.example/1", _page(["apples", "pears"], None, "one")), (2, "https://h.example/2", _page(["plums"], "buy", "two")), (3, "http://H.example:80/3", _page(["figs"] * 3, "sell", "three"))]
    out = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1]["content"] == "apples kg\npears kg" and out[2]["content"] == "plums kg" and {r["host"] for r in out.values()} == {"h.example"}
    assert len({r["wrapper_id"] for r in out.values()}) == 1


def test_extraction_odd(spark):
    pages = [(1, None, None), (2, "", ""), (3, "nonsense", "plain & simple"), (4, "https://x.example/", "<p>one<p>two</div></p><li>"), (4, "https://x.example/", "<p>one<p>two</div></p><li>"), (None, "https://y.example/", "<div>" * 3000 + "deep"), (5, "https://z.example/", "<p>" + "long text " * 50_000)]
    schema = "page_id long, url string, html string"
    rows = wrappers.extract(spark.createDataFrame(pages, schema)).collect()
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows}
    assert by[3]["content"] == "plain & simple" and by[1]["content"] == "" and by[None]["content"] == "deep" and len(by[5]["content"]) == 499_999
    assert wrappers.extract(spark.createDataFrame([], schema)).count() == 0


def test_wide_records():
    """Records of many siblings fold, whatever their width, also around narrower groups and in halves of a page."""
    for width in (5, 6, 11):
        record = [x for k in range(width) for x in (f"<div.{chr(97 + k)}>", "#", "</div>")]
        for times in (2, 3, 7):
            nodes, slots = wrappers.fold(["<body>", "#", *record * times, "<p>", "#", "</p>", "</body>"])
            assert nodes == ["<body>", "#", ["+", record], "<p>", "#", "</p>", "</body>"]
            assert slots == [0, *list(range(1, width + 1)) * times, width + 1]
    streams = [wrappers.fold(["<body>", *record * times, "</body>"])[0] for times in (3, 1, 2)]
    w, _ = wrappers.induce(streams)
    assert w.count == 11 and w.text().count("(") == 1


def test_alignment_by_brute_force(monkeypatch):
    """The bit vectors against the plain table, all rows kept or only some."""
    rng = random.Random(4)
    for bits in (1 << 26, 40, 3):
        monkeypatch.setattr(wrappers, "_TABLE_BITS", bits)
        for _ in range(60):
            a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
            n, m = len(a), len(b)
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
            steps = wrappers._common(a, b)
            assert [i for i, _ in steps if i is not None] == list(range(n)) and [j for _, j in steps if j is not None] == list(range(m))
            both = [(i, j) for i, j in steps if i is not None and j is not None]
            assert all(a[i] == b[j] for i, j in both) and len(both) == best[0][0]


def test_large_pages(spark):
    """Closed elements nested 10,000 deep, repeated groups nested 3,000 deep, and two pages of 20,000 nodes of one host."""
    rng = random.Random(1)
    flat = ["".join(f"<{rng.choice(['p', 'div', 'h2', 'h3'])}>{rng.choice(['', 'text'])}" for _ in range(20_000)) for _ in range(2)]
    lists = "<ul><li>a<li>b<li>" * 3000 + "end" + "</ul>" * 3000
    pages = [(1, "https://deep.example/1", "<div>" * 10_000 + "deep" + "</div>" * 10_000), (2, "https://deep.example/2", "<div>" * 9_000 + "less" + "</div>" * 9_000), (3, "https://lists.example/", lists), (4, "https://lists.example/", "<p>other</p>" + lists)]
    pages += [(5 + k, "https://flat.example/", x) for k, x in enumerate(flat)]
    out = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1]["content"] == "deep" and out[2]["content"] == "less" and out[3]["wrapper_id"] == out[4]["wrapper_id"] and out[6]["wrapper_id"] == out[5]["wrapper_id"]
    assert "other" in out[4]["content"]


def test_wrappers_accept_their_pages(spark, sf_dir):
    """A host's wrapper, as a regular expression over tags, matches every page of the host: those it was made from, and odd ones."""
    rng = random.Random(2)
    hosts = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html").collect():
        hosts[wrappers.host_of(r["url"])].append(wrappers.tokens(r["html"])[0])
    for k in range(30):
        hosts[f"odd{k}"] = [wrappers.tokens("".join(rng.choice(["<p>", "</p>", "<ul>", "</ul>", "<li>", "<div>", "</div>", "x ", "<br>", "<hr>"]) for _ in range(rng.randint(1, 40))))[0] for _ in range(5)]
    for streams in hosts.values():
        w, _ = wrappers.induce([wrappers.fold(x)[0] for x in streams])
        pattern = "".join({"(": "(?:", ")+": ")+", ")?": ")?"}.get(x, re.escape("#\n" if isinstance(x, int) else f"{x}\n")) for x in wrappers._events(w.nodes))
        for x in streams:
            assert re.fullmatch(pattern, "".join(f"{t}\n" for t in x)), (x, w.text())


def test_links_in_texts():
    """Links in running text are text; blocks made of links aren't content; forms and the headers of articles are."""

    def content(page):
        kinds, texts = wrappers.tokens(page)
        w, maps = wrappers.induce([wrappers.fold(kinds)[0]])
        slots = wrappers.fold(kinds)[1]
        return [t for t, k in zip(texts, slots, strict=True) if not w.asides()[maps[0][k]]]

    assert content("<p>See <a href=x>the <b>manual</b></a> first</p>") == ["See the manual first"]
    assert content("<p><a href=x>The manual</a>, says <a href=y>one</a></p><p>more</p>") == ["The manual, says one", "more"]
    assert content("<p><a href=x>one</a> <a href=y>two</a>&nbsp;</p><p>more</p>") == ["more"]
    assert content("<a href=x><h2>card</h2>tail</a> after <p>more</p>") == ["after", "more"]
    assert content("<ul><li><a href=x>one<li>two</ul><p>more</p>") == ["two", "more"]
    assert content("<p>open <a href=x>link<p>more</a> text</p>") == ["open link", "more text"]
    assert content("<ul><li><a href=x>one</ul><p>more</p>") == ["more"]
    assert content("<body><form><p>whole page</p><label>name</label></form></body>") == ["whole page"]
    assert content("<body><header>site</header><article><header><h1>title</h1></header><div class=header>by</div><footer>x</footer></article></body>") == ["title", "by"]


def test_copies_are_no_template(spark):
    """Copies of one page, and a group of copies within a host, keep their texts; what all of two different pages share is template."""
    page = "<html><body><h1>{}</h1><p>{}</p>{}</body></html>"
    pages = [(i, "https://copies.example/", page.format("head", "same", "")) for i in range(3)]
    pages += [(10 + i, "https://big.example/", page.format("head", f"text {i}", "")) for i in range(5)]
    pages += [(20 + i, "https://big.example/", page.format("head", "copied", "<div>only copies</div>")) for i in range(2)] + [(30, "https://big.example/", "")]
    pages += [(40, "https://one.example/", "<ul><li>x</li><li>x</li></ul>")]
    out = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i]["content"] == "head\nsame" and out[i]["n_fields"] == 2 for i in range(3))
    assert all(out[10 + i]["content"] == f"text {i}" for i in range(5))
    assert all(out[20 + i]["content"] == "copied\nonly copies" for i in range(2)) and out[30]["content"] == ""
    assert out[40]["content"] == "x\nx"


def test_every_page_keeps_its_article(spark, sf_dir):
    out = wrappers.op7_html_extraction(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert out.count() == pages.count() and out.where("content = ''").count() == 0
    for r in out.join(pages, "page_id").limit(20).collect():
        first = r["html"].split("<article>")[1].split("<p>")[1].replace("<b>", "").split("<")[0].split("&")[0]
        assert " ".join(first.split()) in r["content"]


def test_pipeline_odd(spark, odd, empty, sf_dir):
    """Nulls, repeated rows and ids, clashing names and an empty table through all stages."""
    more = spark.createDataFrame(
        [(2, "Etwas ganz anderes steht in diesem Text und er ist lang genug", "de", "a", 61), (None, "Some quite different text that is long enough to be told", "en", "b", 55), (None, "Another text without a number, and none of the others is like it", "en", "b", 64)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    names = [c for c in odd.columns if c not in more.columns]
    for table in (odd.unionByName(more.withColumns({n: F.lit("x") for n in names})), empty):
        kept, texts = table, {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, sf_dir)
            path = f"{shared_dir(spark)}/odd-{name}-{random.random()}"
            out.write.parquet(path)
            kept = spark.read.parquet(path)
            if name != "sentencepiece":
                assert kept.columns == table.columns
                texts[name] = [r["text"] for r in kept.select("text").collect()]
        # No two different texts here are near each other: each stays, once.
        assert sorted(texts["simhash_near_dedup"]) == sorted(set(texts["language_id"])) and len(texts["language_id"]) < table.count() + (table is empty)
        assert (kept.count() > 0) is (table is not empty)


def test_pipeline(spark, docs, sf_dir):
    """Each stage on what its predecessor kept, against brute force where SQL can't say it."""
    from evalweave.llm import language, sentencepieces, simhash

    kept, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{fresh([], 'x')}"
        stage(spark, kept, sf_dir).write.mode("overwrite").parquet(path)
        kept = stages[name] = spark.read.parquet(path)
    assert all(df.columns == docs.columns for name, df in stages.items() if name != "sentencepiece")
    good = {r["doc_id"] for r in language.identify(docs).where("not rejected").collect()}
    assert {r["doc_id"] for r in stages["language_id"].collect()} == good
    texts = {r["text"]: min(r["ids"]) for r in stages["language_id"].groupBy("text").agg(F.collect_list("doc_id").alias("ids")).collect()}
    assert sorted(r["doc_id"] for r in stages["exact_dedup"].collect()) == sorted(texts.values())
    gone = {r["doc_id"] for r in simhash.find_near(stages["exact_dedup"]).collect()}
    assert {r["doc_id"] for r in stages["simhash_near_dedup"].collect()} == set(texts.values()) - gone
    whole = _tokens(stages["simhash_near_dedup"])
    w = {s: mixing.WEIGHTS.get(s, 1) for s in whole}
    assert _tokens(stages["mix_sources"]) == {s: sum(whole.values()) * w[s] // sum(w.values()) for s in whole}
    mixed = sorted((r["doc_id"], r["text"]) for r in stages["mix_sources"].collect())
    assert sorted((r["doc_id"], r["decoded"]) for r in stages["sentencepiece"].collect()) == mixed
    assert corpus_pipeline.run(spark, sf_dir).count() == len(mixed)
    assert sentencepieces.MODEL.startswith("/opt/tokenizers")
