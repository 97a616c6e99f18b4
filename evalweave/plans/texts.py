"""Queries: corpus audit, scorers, persistence and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scanning
from ..functions import text as tx
from ..operators import audit, diagnostics, persistence, rubrics, scoring
from ..sources import tables as t
from .catalog import query
from .stats import rounded

# White space of the test tables is ASCII, where the engine's wider class is the same.
_NORM = "lower(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = "list_filter(list_transform(string_split({n}, ' '), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')"
_GRAMS = "list_distinct(CASE WHEN len(toks) < 5 THEN toks ELSE list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i+4], ' ')) END)"


def _prompts_sql(table: str, key: str) -> str:
    return f"(SELECT id, norm, {_GRAMS} AS grams FROM (SELECT *, {_TOKENS.format(n='norm')} AS toks FROM (SELECT {key} AS id, {_NORM.format(x='text')} AS norm FROM {table})))"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("text").alias("prompt"))


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("ord"), F.col("text").alias("prompt"))


@query("duplicate_prompts", f"SELECT md5(norm) AS group_id, list_sort(list(id)) AS ids, count(*) AS n FROM {_prompts_sql('documents', 'doc_id')} GROUP BY norm HAVING count(*) > 1")
def duplicate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_groups(_prompts(spark, sf_dir))


@query(
    "near_duplicates",
    f"""WITH p AS MATERIALIZED {_prompts_sql('documents', 'doc_id')}, g AS (SELECT id, norm, len(grams) AS size, unnest(grams) AS s FROM p),
    c AS (SELECT x.id AS a, y.id AS b, x.size AS sa, y.size AS sb, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.id < y.id AND x.norm <> y.norm GROUP BY ALL)
    SELECT a, b, round(greatest(common / sa, common / sb), 9) AS overlap FROM c WHERE greatest(common / sa, common / sb) >= 0.8""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.near_duplicates(_prompts(spark, sf_dir)), "overlap")


@query(
    "leakage",
    f"""WITH e AS MATERIALIZED {_prompts_sql('benchmark', 'item_id')}, d AS MATERIALIZED {_prompts_sql('documents', 'doc_id')},
    x AS (SELECT e.id, 'exact' AS match, min(d.id) AS training_id, 1.0::DOUBLE AS overlap FROM e JOIN d ON e.norm = d.norm GROUP BY e.id),
    g AS (SELECT e.id, len(e.grams) AS size, unnest(e.grams) AS s FROM e WHERE e.id NOT IN (SELECT id FROM x)), h AS (SELECT id AS training_id, unnest(grams) AS s FROM d),
    c AS (SELECT id, training_id, count(*) / size AS overlap FROM g JOIN h USING (s) GROUP BY id, training_id, size HAVING count(*) / size >= 0.65)
    SELECT * FROM x UNION ALL SELECT id, 'ngram', min(training_id), round(arg_min(overlap, training_id), 9) FROM c GROUP BY id""",
)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.leakage(_evaluation(spark, sf_dir), _prompts(spark, sf_dir)), "overlap")


@query("item_flags", f"WITH scores AS ({t.SCORES_SQL}), s AS (SELECT concat('s', x) AS scenario_id FROM range(0, 520) r(x)), p AS (SELECT scenario_id, avg(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS pass_rate FROM scores WHERE axis = 'N' AND runner_id = 'r1' GROUP BY 1) SELECT scenario_id, round(coalesce(pass_rate, 0), 9) AS pass_rate, CASE pass_rate WHEN 1 THEN 'too-easy' WHEN 0 THEN 'too-hard' END AS flag FROM s LEFT JOIN p USING (scenario_id)")
def item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.range(520).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scenario_id"))
    scored = t.scores(spark, sf_dir).where("axis = 'N' and runner_id = 'r1'").withColumn("value", (F.col("value") >= 0.5).cast("int"))
    return rounded(audit.item_flags(scenarios, scored), "pass_rate")


@query("coverage", "SELECT 'outcome' AS dimension, lang AS label, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'lane', l, count(*) FROM (SELECT unnest(list_distinct([lang, source])) AS l FROM documents) GROUP BY l")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(
        F.to_json(F.struct(F.concat(F.lit(" "), "lang").alias("outcomeType"), F.array("lang", F.concat("source", F.lit(" "))).alias("lanes"))).alias("meta"), F.to_json(F.struct(F.col("lang").alias("lane"))).alias("input_meta")
    )
    outcome = audit.coverage(docs.select(audit.outcome_type(F.col("meta")).alias("o")), "o").withColumn("dimension", F.lit("outcome"))
    lane = audit.coverage(docs.select(audit.lanes([F.col("meta"), F.col("input_meta")]).alias("l")), "l").withColumn("dimension", F.lit("lane"))
    return outcome.unionByName(lane).select("dimension", "label", "n")


@query(
    "scenario_diff",
    f"""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_NORM.format(x='text')} AS norm, md5(text) AS f FROM documents WHERE doc_id % 5 <> 0),
    a AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_NORM.format(x='text')} AS norm, md5(CASE WHEN doc_id % 11 = 0 THEN concat(text, '!') ELSE text END) AS f FROM documents WHERE doc_id % 7 <> 0)
    SELECT 'added' AS kind, id, NULL::VARCHAR AS other_id FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'removed', id, NULL FROM b WHERE id NOT IN (SELECT id FROM a)
    UNION ALL SELECT 'changed', b.id, NULL FROM b JOIN a ON a.id = b.id AND a.f <> b.f UNION ALL SELECT 'overlap', b.id, a.id FROM b JOIN a ON a.norm = b.norm AND a.id <> b.id""",
)
def scenario_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"), "doc_id")
    before = d.where("doc_id % 5 <> 0").withColumn("fingerprint", F.md5("prompt"))
    after = d.where("doc_id % 7 <> 0").withColumn("fingerprint", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt"))))
    return audit.scenario_diff(before.drop("doc_id"), after.drop("doc_id"))


@query(
    "ambiguous_prompts",
    f"""WITH p AS (SELECT doc_id, text, len({_TOKENS.format(n='norm')}) AS n FROM (SELECT doc_id, text, {_NORM.format(x='text')} AS norm FROM documents)),
    q AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty prompt' WHEN n < 6 THEN concat('only ', n, ' substantive tokens') WHEN regexp_matches(text, '(?i)\\b(?:todo|tbd|fixme|placeholder|lorem ipsum)\\b') THEN 'draft markers'
      WHEN regexp_matches(text, '(?i)\\{{\\{{[^}}]+\\}}\\}}|\\{{[a-z0-9_.-]+\\}}|<[^>\\s]+>') THEN 'template placeholders' END AS why FROM p) SELECT doc_id, why FROM q WHERE why IS NOT NULL""",
)
def ambiguous_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents")
    return d.select("doc_id", audit.ambiguous_prompt(F.col("text")).alias("why")).where("why is not null")


_RUBRICS = [
    '{"kind":"programmatic","checker":"keyword","params":{"expected":["the"]}}', '{"kind":"programmatic","checker":"contains","params":{"expected":["real evidence","the reason holds"]}}', '{"kind":"programmatic","checker":"exact-match","params":{"expected":7}}',
    '{"kind":"llm-judge","prompt":"rate it"}', '{"kind":"programmatic","checker":"keyword","params":{"expected":["a b","c d"],"forbidden":[["A  B"]]}}', '{"kind":"human","instructions":"be fair"}',
]
AUDIT = diagnostics.Options(now="2026-01-01", required_outcomes=["o0", "o9"], required_lanes=["l9"], plugins=[diagnostics.metadata_freshness(), diagnostics.mutations()])


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, doc: the benchmark's items as scenario documents, with rubrics, outcome types, lanes and facts of several kinds."""
    i = F.col("item_id")
    rubric = F.element_at(F.array(*[F.lit(r) for r in _RUBRICS]), (i % 6 + 1).cast("int"))
    outcome = F.when(i % 7 == 0, F.lit('"outcomeType":5,')).otherwise(F.concat(F.lit('"outcomeType":" o'), (i % 3).cast("string"), F.lit('",')))
    lane = F.when(i % 5 == 0, F.lit('"lane":7,')).when(i % 5 == 1, F.lit('"lanes":["l1"," [l2] "],')).otherwise(F.lit('"domainLane":"l1",'))
    fact = F.when(i % 4 == 0, F.concat(F.lit('"publicFacts":[{"id":"f'), i.cast("string"), F.lit('","observedAt":"2025-01-01","maxAgeDays":30},{"label":"fresh","asOf":"2025-12-30"}],'))).otherwise(F.lit(""))
    domain = F.when(i % 9 == 0, F.lit('"domainFacts":{"label":"old","asOf":"2024-01-01"}')).otherwise(F.lit('"domainFacts":[]'))
    doc = F.concat(F.lit('{"input":{"messages":['), F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), F.lit(']},"rubric":'), rubric, F.lit(',"meta":{'), outcome, lane, fact, domain, F.lit("}}"))
    return t.table(spark, sf_dir, "benchmark").select(i.alias("ord"), i.cast("string").alias("id"), doc.alias("doc"))


@query(
    "audit_findings",
    f"""WITH e AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS id, id AS ord, norm, grams, len({_TOKENS.format(n='norm')}) AS n FROM {_prompts_sql('benchmark', 'item_id')}), d AS MATERIALIZED {_prompts_sql('documents', 'doc_id')},
    raw AS (SELECT item_id AS ord, text FROM benchmark),
    x AS (SELECT DISTINCT e.id, e.ord FROM e JOIN d ON e.norm = d.norm),
    g AS (SELECT e.id, e.ord, len(e.grams) AS size, unnest(e.grams) AS s FROM e WHERE e.id NOT IN (SELECT id FROM x)), h AS (SELECT id AS training_id, unnest(grams) AS s FROM d),
    c AS (SELECT id, ord, training_id, count(*) / size AS overlap FROM g JOIN h USING (s) GROUP BY id, ord, training_id, size HAVING count(*) / size >= 0.65),
    l AS (SELECT id, ord, arg_min(overlap, training_id) AS overlap FROM c GROUP BY id, ord),
    pg AS (SELECT id, ord, norm, len(grams) AS size, unnest(grams) AS s FROM e),
    near AS (SELECT p.ord AS oa, q.ord AS ob, p.id AS a, q.id AS b, greatest(count(*) / p.size, count(*) / q.size) AS overlap FROM pg p JOIN pg q ON p.s = q.s AND p.ord < q.ord AND p.norm <> q.norm GROUP BY p.ord, q.ord, p.id, q.id, p.size, q.size HAVING greatest(count(*) / p.size, count(*) / q.size) >= 0.8),
    f AS (
      SELECT 0 AS stage, ord AS o1, 0 AS o2, 'outcome-coverage' AS kind, TRUE AS blocks, [id] AS ids, 'scenario is missing meta.outcomeType; publishable benchmark claims require outcome stratification' AS detail FROM e WHERE ord % 7 = 0
      UNION ALL SELECT 1, k, 0, 'outcome-coverage', TRUE, CAST([] AS VARCHAR[]), concat('required outcome type "', o, '" is not represented') FROM (VALUES (0, 'o0'), (1, 'o9')) v(k, o) WHERE o NOT IN (SELECT concat('o', ord % 3) FROM e WHERE ord % 7 <> 0)
      UNION ALL SELECT 2, ord, 0, 'lane-coverage', FALSE, [id], 'scenario has no lane metadata in lane, lanes, capabilityLane, capabilityLanes, domainLane, domainLanes' FROM e WHERE ord % 5 = 0
      UNION ALL SELECT 3, 0, 0, 'lane-coverage', TRUE, CAST([] AS VARCHAR[]), 'required lane "l9" is not represented'
      UNION ALL SELECT 4, min(ord), 0, 'duplicate-prompt', TRUE, list_sort(list(id)), concat(count(*), ' scenarios share identical prompt text') FROM e GROUP BY norm HAVING count(*) > 1
      UNION ALL SELECT 5, oa, ob, 'near-duplicate-prompt', FALSE, list_sort([a, b]), concat(a, ' and ', b, ' share ', CAST(floor(overlap * 100 + 0.5) AS BIGINT), '% prompt n-gram overlap') FROM near
      UNION ALL SELECT 6, ord, 2, 'possible-leakage', TRUE, [id], 'scenario prompt exactly matches a training prompt' FROM x
      UNION ALL SELECT 6, ord, 2, 'possible-leakage', TRUE, [id], concat('scenario prompt shares ', CAST(floor(overlap * 100 + 0.5) AS BIGINT), '% 5-gram overlap with a training prompt') FROM l
      UNION ALL SELECT 7, ord, 0, 'ambiguous-prompt', FALSE, [id], CASE WHEN n = 0 THEN 'prompt is empty' WHEN n < 6 THEN concat('prompt has only ', n, ' substantive tokens; expected task context may be underspecified')
        WHEN regexp_matches(text, '(?i)\\b(?:todo|tbd|fixme|placeholder|lorem ipsum)\\b') THEN 'prompt contains unresolved draft markers' ELSE 'prompt contains unresolved template placeholders' END FROM e JOIN raw USING (ord)
        WHERE n < 6 OR regexp_matches(text, '(?i)\\b(?:todo|tbd|fixme|placeholder|lorem ipsum)\\b') OR regexp_matches(text, '(?i)\\{{\\{{[^}}]+\\}}\\}}|\\{{[a-z0-9_.-]+\\}}|<[^>\\s]+>')
      UNION ALL SELECT 7, ord, 1, 'weak-rubric', TRUE, [id], 'contains checker is sign-blind and anti-bingo-capped; use keyword or mechanism scoring for claims' FROM e WHERE ord % 6 = 1
      UNION ALL SELECT 7, ord, 2, 'unverifiable-expected-outcome', TRUE, [id], CASE ord % 6 WHEN 2 THEN 'exact-match checker has no non-empty params.expected value' ELSE 'llm-judge rubric has no reference answer for independent verification' END FROM e WHERE ord % 6 IN (2, 3)
      UNION ALL SELECT 7, ord, 3, 'conflicting-rubric-gates', TRUE, [id], 'rubric both requires and forbids: a b' FROM e WHERE ord % 6 = 4
      UNION ALL SELECT 7, ord, 4, 'rubric-ambiguity', FALSE, [id], CASE ord % 6 WHEN 0 THEN 'keyword checker uses one-token expected terms that are easy to satisfy accidentally' WHEN 3 THEN 'llm-judge prompt does not interpolate the candidate response with {{response}}'
        ELSE 'human rubric instructions are too short to support consistent adjudication' END FROM e WHERE ord % 6 IN (0, 3, 5)
      UNION ALL SELECT 7, ord, 10, 'stale-public-fact', FALSE, [id], concat('public fact "f', ord, '" is 365 days old, above the 30-day freshness window') FROM e WHERE ord % 4 = 0
      UNION ALL SELECT 8, ord, 0, 'stale-domain-fact', FALSE, [id], 'domain fact "old" is 731 days old, above the 90-day freshness window' FROM e WHERE ord % 9 = 0
      UNION ALL SELECT 8, 1099511627776 + ord, 0, 'adversarial-mutation-probe', FALSE, [id], 'generic-adversarial-mutations generated 3 adversarial mutation probes' FROM e
    )
    SELECT concat('D', lpad(CAST(row_number() OVER (ORDER BY stage, o1, o2, ids, detail) AS VARCHAR), 3, '0')) AS finding_id, kind, CASE WHEN blocks THEN 'claim-blocking' ELSE 'advisory' END AS severity, ids, detail FROM f""",
)
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the audit over the benchmark's items, with the documents as training texts."""
    return diagnostics.audit_set(_scenarios(spark, sf_dir), AUDIT, training=_prompts(spark, sf_dir)).select("finding_id", "kind", "severity", "ids", "detail")


@query("token_ngrams", f"SELECT id, len(grams) AS n_grams, md5(array_to_string(list_sort(grams), '|')) AS digest FROM {_prompts_sql('benchmark', 'item_id')}")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluation(spark, sf_dir).select("id", tx.ngrams(tx.tokens(F.col("prompt")), 5).alias("g"))
    return e.select("id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


#: A negation is put before some documents, which have few of their own.
_OUTPUTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('We do not accept the ', text) WHEN 1 THEN concat('There is no real evidence. The reason holds, but ', text) ELSE text END AS output FROM documents"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    out = F.when(i == 0, F.concat(F.lit("We do not accept the "), "text")).when(i == 1, F.concat(F.lit("There is no real evidence. The reason holds, but "), "text")).otherwise(F.col("text"))
    return t.table(spark, sf_dir, "documents").select("doc_id", out.alias("output"))


def unnegated_sql(text: str, phrase: str) -> str:
    """The matcher in DuckDB's SQL, for a phrase of ASCII letters: RE2 has no lookbehind, so prefixes are built from the split text."""
    p = "(?i)\\b" + "\\s+".join(phrase.split()) + "\\b"
    clause = "regexp_replace(right(pre, 48), '(?is)^.*(?:[.!?;]|\\b(?:but|however|then)\\b)', '')"
    direct = f"regexp_matches({clause}, '(?i)\\b(?:do\\s+not|don''t|dont|never)\\b[\\w\\s''\",:()/-]*$')"
    bare = f"regexp_matches(regexp_replace({clause}, '(?i)\\bnot(\\s+(?:only|just|necessarily|merely|simply)\\b)', 'n0t\\1', 'g'), '(?i)\\bnot\\b[\\w\\s''\",:()/-]*$')"
    no = f"regexp_matches({clause}, '(?i)\\bno\\s+(?:[\\w-]+\\s+){{0,4}}$')"
    contrast = f"regexp_matches({clause}, '(?i)\\b(?:instead\\s+of|rather\\s+than)\\b[\\w\\s''\"()/-]*$')"
    prefix = "list_transform(range(1, len(m) + 1), lambda i: array_to_string(list_transform(range(greatest(1, i - 48), i + 1), lambda j: concat(coalesce(m[j - 1], ''), p[j])), ''))"
    return f"(SELECT list_bool_or(list_transform({prefix}, lambda pre: NOT ({direct} OR {bare} OR {no} OR {contrast}))) FROM (SELECT regexp_split_to_array({text}, '{p}') AS p, regexp_extract_all({text}, '{p}') AS m))"


@query("unnegated_match", f"SELECT doc_id, coalesce({unnegated_sql('output', 'the')}, false) AS the, coalesce({unnegated_sql('output', 'real evidence')}, false) AS evidence FROM ({_OUTPUTS})")
def unnegated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("output")
    found = outputs(spark, sf_dir).select("doc_id", scanning.hits(o, ["the", "real evidence"]).alias("h"))
    return found.select("doc_id", F.element_at("h", 1).alias("the"), F.element_at("h", 2).alias("evidence"))


@query(
    "programmatic_scores",
    f"""SELECT doc_id, CASE WHEN lower(trim(output)) = 'that it.' THEN 1.0 ELSE 0.0 END::DOUBLE AS exact,
    least(0.2, 1 - (CASE WHEN contains(lower(output), 'the') THEN 0 ELSE 1 END + CASE WHEN contains(lower(output), 'tion') THEN 0 ELSE 1 END + CASE WHEN contains(lower(output), 'zzz') THEN 0 ELSE 1 END) / 3)::DOUBLE AS contains,
    round(1 - (CASE WHEN coalesce({unnegated_sql('output', 'the')}, false) THEN 0 ELSE 1 END + CASE WHEN coalesce({unnegated_sql('output', 'real evidence')}, false) THEN 0 ELSE 1 END) / 2, 9)::DOUBLE AS keyword,
    CASE WHEN length(trim(output)) >= 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS non_empty FROM ({_OUTPUTS})""",
)
def programmatic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("output")
    return rounded(outputs(spark, sf_dir).select(
        "doc_id", scoring.exact_match(o, " That it. ").alias("exact"), scoring.contains(o, ["The", "tion", "zzz"]).alias("contains"),
        scoring.keyword(o, ["the", "real evidence"]).alias("keyword"), scoring.non_empty(o, 200).alias("non_empty"),
    ), "keyword")


CRITERIA = {
    "quantitative": [{"label": "rate", "matchers": ["/\\d{3,}/"]}, {"label": "evidence", "matchers": ["real evidence", "reason holds"]}],
    "disambiguation": [{"label": "that", "matchers": ["that it", "this is"]}],
    "actions": [{"label": "accept", "matchers": ["accept the"]}, {"label": "with", "matchers": ["with the"]}],
    "bingoTokens": ["the", "la"],
}
_Q = f"(CASE WHEN regexp_matches(output, '\\d{{3,}}') THEN 1 ELSE 0 END)"


@query(
    "mechanism_scores",
    f"""WITH g AS (SELECT doc_id, output, coalesce({unnegated_sql('output', 'real evidence')}, false) OR coalesce({unnegated_sql('output', 'reason holds')}, false) AS q2,
      coalesce({unnegated_sql('output', 'that it')}, false) OR coalesce({unnegated_sql('output', 'this is')}, false) AS d1,
      coalesce({unnegated_sql('output', 'accept the')}, false) AS a1, coalesce({unnegated_sql('output', 'with the')}, false) AS a2, regexp_matches(output, '(?i)\\b(?:the|la)\\b') AS bingo FROM ({_OUTPUTS})),
    s AS (SELECT *, CAST(q2 AS INT) AS q, CAST(d1 AS INT) AS d, CAST(a1 AS INT) + CAST(a2 AS INT) AS a FROM g)
    SELECT doc_id, round(CASE WHEN bingo AND q = 0 AND d = 0 THEN 0.2 WHEN q = 0 AND d = 0 THEN 0.0 ELSE 0.45 * q / 1 + 0.35 * d / 1 + 0.2 * a / 2 END, 9)::DOUBLE AS value,
      (CASE WHEN bingo AND q = 0 AND d = 0 THEN 0.2 WHEN q = 0 AND d = 0 THEN 0.0 ELSE 0.45 * q / 1 + 0.35 * d / 1 + 0.2 * a / 2 END) >= 0.5 AS passed, bingo AND q = 0 AND d = 0 AS bingo_guard_tripped FROM s""",
)
def mechanism_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = CRITERIA | {"quantitative": CRITERIA["quantitative"][1:]}
    return rounded(outputs(spark, sf_dir).select("doc_id", scoring.mechanism(F.col("output"), criteria).alias("s")).select("doc_id", "s.value", "s.passed", "s.bingo_guard_tripped"), "value")


def _missing(*cases: tuple[str, str]) -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {name!r} END' for c, name in cases)}], lambda x: x IS NOT NULL), '{{sep}}')"


_MECHANISM_MISSING = _missing(("NOT q1", "quant[rate]"), ("NOT q2", "quant[evidence]"), ("NOT d1", "disambig[that]"), ("NOT a1", "action[accept]"), ("NOT a2", "action[with]"), ("bingo AND NOT q1 AND NOT q2 AND NOT d1", rubrics.BINGO_MESSAGE)).format(sep="; ")
_KEYWORD_MISSING = _missing(("NOT k1", "the"), ("NOT k2", "real evidence")).format(sep=", ")


@query(
    "score_responses",
    f"""WITH h AS MATERIALIZED (SELECT doc_id, output, coalesce({unnegated_sql('output', 'the')}, false) AS k1, coalesce({unnegated_sql('output', 'real evidence')}, false) AS k2, coalesce({unnegated_sql('output', 'reason holds')}, false) AS k3,
      coalesce({unnegated_sql('output', 'that it')}, false) OR coalesce({unnegated_sql('output', 'this is')}, false) AS d1, coalesce({unnegated_sql('output', 'accept the')}, false) AS a1, coalesce({unnegated_sql('output', 'with the')}, false) AS a2,
      regexp_matches(output, '(?i)\\b(?:the|la)\\b') AS bingo, CAST(regexp_extract(output, '(\\d{{3,}})') <> '' AS BOOLEAN) AS q1 FROM ({_OUTPUTS})),
    g AS (SELECT *, k2 OR k3 AS q2 FROM h),
    v AS (SELECT *, CASE WHEN q1 OR q2 OR d1 THEN 0.45 * (CAST(q1 AS INT) + CAST(q2 AS INT)) / 2 + 0.35 * CAST(d1 AS INT) + 0.2 * (CAST(a1 AS INT) + CAST(a2 AS INT)) / 2 WHEN bingo THEN 0.2 ELSE 0.0 END::DOUBLE AS mv, bingo AND NOT q1 AND NOT q2 AND NOT d1 AS tripped FROM g),
    s AS (SELECT doc_id, concat('r', doc_id % 2) AS runner_id, concat('s', doc_id % 3) AS scenario_id,
      CASE doc_id % 3 WHEN 0 THEN 1 - (CASE WHEN k1 THEN 0 ELSE 1 END + CASE WHEN k2 THEN 0 ELSE 1 END) / 2 WHEN 1 THEN least(0.2, 1 - (CASE WHEN contains(lower(output), 'the') THEN 0 ELSE 1 END + CASE WHEN contains(lower(output), 'zzz') THEN 0 ELSE 1 END) / 2) ELSE mv END AS value,
      CASE doc_id % 3 WHEN 0 THEN CASE WHEN k1 AND k2 THEN 'all terms present (un-negated)' ELSE concat('missing or negated: ', {_KEYWORD_MISSING}) END
        WHEN 1 THEN concat('missing: ', CASE WHEN contains(lower(output), 'the') THEN '' ELSE 'the, ' END, 'zzz [contains capped at 0.2; use keyword/mechanism for benchmark scoring]')
        ELSE concat('quant=', CAST(q1 AS INT) + CAST(q2 AS INT), '/2, disambig=', CAST(d1 AS INT), '/1, action=', CAST(a1 AS INT) + CAST(a2 AS INT), '/2, bingo_guard=', tripped, ', score=', printf('%.2f', mv + 1e-9), CASE WHEN q1 AND q2 AND d1 AND a1 AND a2 THEN '' ELSE concat(' | missing: ', {_MECHANISM_MISSING}) END) END AS rationale FROM v),
    x AS (SELECT *, unnest(CASE scenario_id WHEN 's0' THEN [0, 1] ELSE [0] END) AS axis_ord FROM s)
    SELECT doc_id, runner_id, scenario_id, CAST(axis_ord AS INT) AS axis_ord, CASE WHEN scenario_id = 's2' OR axis_ord = 1 THEN 'care' ELSE 'recall' END AS axis, round(value, 9)::DOUBLE AS value, rationale, 'programmatic' AS claim_status FROM x""",
)
def score_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics of several kinds over documents as responses, fanned out over axes."""
    scenarios = [
        {"id": "s0", "axes": ["recall", "care"], "rubric": {"kind": "programmatic", "checker": "keyword", "params": {"expected": ["the", "real evidence"]}}},
        {"id": "s1", "axes": ["recall"], "rubric": {"kind": "programmatic", "checker": "contains", "params": {"expected": ["the", "zzz"]}}},
        {"id": "s2", "axes": ["care"], "rubric": {"kind": "mechanism", **CRITERIA}},
    ]
    responses = outputs(spark, sf_dir).select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")).alias("runner_id"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("scenario_id"), "output")
    return rounded(scoring.score_responses(responses, scenarios, keep=["doc_id"]), "value")


PERSISTENCE = [
    {"id": "fact", "kind": "fact-persistence", "targetTurnIndex": 2, "factPhrases": ["the"]},
    {"id": "disposition", "kind": "disposition-persistence", "targetTurnIndex": 3, "disposition": "hold", "holdPhrases": ["of the", "is"], "flipPhrases": ["with the"]},
    {"id": "constraint", "kind": "constraint-persistence", "targetTurnIndex": 1, "establishedAtTurn": 0, "constraint": "c", "violationPhrases": ["and the"], "acknowledgePhrases": ["to"]},
    {"id": "mechanism", "kind": "mechanism-persistence", "targetTurnIndex": 3, "mechanism": "m", "pressureTurnIndex": 1, "pressurePhrases": ["in"], "retainedInvariantPhrases": ["the"], "requiredMechanismPhrases": [["of", "for"]], "forbiddenReversalPhrases": ["with the"]},
    {"id": "evidence", "kind": "evidence-update", "targetTurnIndex": 2, "update": "u", "newEvidenceTurnIndex": 1, "newEvidencePhrases": ["a"], "updatedDiagnosisPhrases": ["is"], "staleDiagnosisPhrases": ["by the"]},
]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turns: pairs of a user's and an assistant's message as turns."""
    c = t.table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    pairs = c.groupBy("conv_id", F.floor(F.col("turn") / 2).cast("int").alias("turn_index")).agg(
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant_text"), F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_message"), F.min("turn").alias("turn_ord")
    )
    return persistence.turn_map(pairs, ["conv_id"])


_TURNS = "SELECT conv_id, CAST(turn // 2 AS INT) AS i, max(CASE WHEN role = 'assistant' THEN text END) AS a, max(CASE WHEN role = 'user' THEN text END) AS u FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL"


def _u(x: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"coalesce({unnegated_sql(x, p)}, false)" for p in phrases) + ")"


def _p(x: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i)\\b{p}\\b')" for p in [q.replace(" ", "\\s+") for q in phrases]) + ")"


_GONE = "WHEN t{i}.conv_id IS NULL THEN 'target-turn-missing' WHEN trim(coalesce(t{i}.a, '')) = '' THEN 'target-turn-empty'"
_EX = "concat(coalesce(t1.u, ''), chr(10), coalesce(t1.a, ''))"


_GRADES = f"""WITH t AS MATERIALIZED ({_TURNS}), c AS (SELECT DISTINCT conv_id FROM t), j AS (SELECT c.conv_id,
      CASE {_GONE.format(i=2)} WHEN {_p('t2.a', 'the')} THEN 'persisted' ELSE 'forgotten' END AS fact,
      CASE {_GONE.format(i=3)} WHEN {_u('t3.a', 'with the')} THEN 'flipped' WHEN {_u('t3.a', 'of the', 'is')} THEN 'persisted' ELSE 'forgotten' END AS disposition,
      CASE {_GONE.format(i=1)} WHEN NOT {_p("coalesce(t0.a, '')", 'to')} THEN 'establishment-missing' WHEN {_u('t1.a', 'and the')} THEN 'violated' WHEN {_p('t1.a', 'to')} THEN 'persisted' ELSE 'forgotten' END AS cons,
      CASE {_GONE.format(i=3)} WHEN NOT {_p(_EX, 'in')} THEN 'pressure-missing' WHEN {_u('t3.a', 'with the')} THEN 'flipped' WHEN NOT {_p('t3.a', 'the')} OR NOT {_p('t3.a', 'of', 'for')} THEN 'mechanism-missing' ELSE 'persisted' END AS mech,
      CASE {_GONE.format(i=2)} WHEN NOT {_p(_EX, 'a')} THEN 'evidence-missing' WHEN {_u('t2.a', 'by the')} THEN 'stale-diagnosis' WHEN NOT {_p('t2.a', 'is')} THEN 'mechanism-missing' ELSE 'persisted' END AS ev
      FROM c {" ".join(f"LEFT JOIN t t{i} ON t{i}.conv_id = c.conv_id AND t{i}.i = {i}" for i in range(4))})
    SELECT conv_id, criterion_id, CASE WHEN reason = 'persisted' THEN 'pass' ELSE 'fail' END AS verdict, reason FROM (
      SELECT conv_id, 'fact' AS criterion_id, fact AS reason FROM j UNION ALL SELECT conv_id, 'disposition', disposition FROM j UNION ALL SELECT conv_id, 'constraint', cons FROM j
      UNION ALL SELECT conv_id, 'mechanism', mech FROM j UNION ALL SELECT conv_id, 'evidence', ev FROM j)"""


@query("persistence_grades", _GRADES)
def persistence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.grade_all(conversations(spark, sf_dir), PERSISTENCE).select("conv_id", "criterion_id", "verdict", "reason")


@query("persistence_scores", f"SELECT conv_id, round(avg(CASE WHEN verdict = 'pass' THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS value FROM ({_GRADES}) GROUP BY conv_id")
def persistence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return rounded(persistence.scenario_scores(c, persistence.grade_all(c, PERSISTENCE), ["conv_id"]), "value")


@query("conversation_history", "SELECT conv_id, turn, count(*) OVER w AS n_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars, first_value(role) OVER w AS first_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = persistence.history(t.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_messages"), F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("n_chars"), F.element_at("history", 1)["role"].alias("first_role"))


@query("message_shaping", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS echo, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), 'Be brief.') AS system, count(*) FILTER (WHERE role <> 'system') AS n_turns FROM conversations GROUP BY conv_id")
def message_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("messages"))
    shaped = c.select("conv_id", persistence.stub_response(F.col("messages")).alias("echo"), persistence.split_messages(F.col("messages"), "Be brief.").alias("s"))
    return shaped.select("conv_id", "echo", "s.system", F.size("s.turns").cast("long").alias("n_turns"))


@query("collapsed_turns", "SELECT conv_id, arg_max(text, turn) AS output, count(*) AS turns, CAST(sum(turn * 10) AS BIGINT) AS latency_ms FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def collapsed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("assistant_text"), (F.col("turn") * 10).alias("latency_ms"))
    return persistence.collapse(c, ["conv_id"], "turn")


_SECRET = "concat('run --token=', md5(CAST(doc_id AS VARCHAR)), ' --model x Bearer ', md5(lang), ' key sk-', source, ' ', left(text, 40))"


@query("redaction", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_SECRET}, '(?i)(^|\\s)(--(?:api[_-]?key|token|secret|password|auth|credential))(=|\\s+)(?:\"[^\"]*\"|''[^'']*''|\\S+)', '\\1\\2\\3[REDACTED]', 'g'), '(?i)Bearer\\s+[A-Za-z0-9._~+/=-]+', '[REDACTED]', 'g'), '\\b(?:sk-[A-Za-z0-9._-]+|gh[ps]_[A-Za-z0-9_]+|xox[baprs]-[A-Za-z0-9-]+)\\b', '[REDACTED]', 'g') AS line FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("run --token="), F.md5(F.col("doc_id").cast("string")), F.lit(" --model x Bearer "), F.md5("lang"), F.lit(" key sk-"), "source", F.lit(" "), F.left("text", F.lit(40)))
    return t.table(spark, sf_dir, "documents").select("doc_id", tx.redact_command(line).alias("line"))


@query("escapes", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS xml, md5(replace(replace(replace(html, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS message, left(regexp_replace(url, '[^A-Za-z0-9_.:-]+', '-', 'g'), 200) AS stable FROM pages")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", F.md5(tx.xml(F.col("html"))).alias("xml"), F.md5(tx.workflow_message(F.col("html"))).alias("message"), tx.stable_id(F.col("url")).alias("stable"))
