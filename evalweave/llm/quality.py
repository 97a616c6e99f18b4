"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose share of something (symbols, capitals, ...)
exceeds a cutoff in thousandths. Cutoffs are chosen for every rule and stratum
(language) on the labelled documents: the strictest one whose false rejections
among good documents stay under ALPHA / rules by an exact binomial bound
(Clopper-Pearson) at level DELTA / (rules x strata). False rejections fall as a
cutoff is loosened, so cutoffs are tested from loose to strict and testing stops
at the first that fails: this order needs no further correction, Bonferroni
covers rules and strata, and the union of the rules keeps ALPHA per stratum with
confidence 1 - DELTA over all of them. A stratum with too few labels gets no
cutoff, and loses nothing.

Cases: null, empty and blank texts break no rule; a null language is a stratum
of its own; a document labelled more than once counts once for each label; null
labels don't count; rows that repeat are judged alike; without labels, or over
an empty table, nothing is rejected; further columns are not read.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, sized

#: Largest share of good documents that all rules together may reject in a stratum.
ALPHA = 0.02
#: Probability that the promise fails in any stratum.
DELTA = 0.05

SYMBOLS = "#$%&*|@^~=+<>{}[]_"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^ \t\n\x0B\f\r]+"
#: rule -> (what is counted, of how many)
RULES = {
    "capitals": ("n_capitals", "n_chars"),
    "exclamations": ("n_exclamations", "n_chars"),
    "repeated_lines": ("n_lines - n_distinct_lines", "n_lines"),
    "repeated_words": ("n_words - n_distinct_words", "n_words"),
    "symbols": ("n_symbols", "n_chars"),
}


def _count_of(chars: str) -> Column:
    return F.length("text") - F.length(F.translate("text", chars, ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the level of each rule: the largest cutoff, in thousandths, that the text exceeds (-1: none)."""
    words, lines = F.regexp_extract_all("text", F.lit(_WORDS), 0), F.split("text", "\n", -1)
    counted = docs.select(
        "doc_id", F.col("lang").cast("string").alias("stratum"),
        F.length("text").alias("n_chars"), _count_of(CAPITALS).alias("n_capitals"), _count_of("!").alias("n_exclamations"), _count_of(SYMBOLS).alias("n_symbols"),
        F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_distinct_lines"),
        F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct_words"),
    )
    levels = [F.expr(f"cast(case when ({part}) > 0 and ({whole}) > 0 then (cast({part} as bigint) * 1000 - 1) div ({whole}) else -1 end as int)").alias(rule) for rule, (part, whole) in RULES.items()]
    return counted.select("doc_id", "stratum", *levels)


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n and p."""
    i = np.arange(k + 1)
    log_choose = lgamma(n + 1) - np.array([lgamma(x + 1) + lgamma(n - x + 1) for x in i])
    return float(np.exp(log_choose + i * log(p) + (n - i) * log(1 - p)).sum())


def _passes(share: float, level: Column, k: str, n: str) -> Column:
    @F.pandas_udf("boolean")
    def passes(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.Series:
        # Beyond the mean the tail is about a half or more, and no level is that large.
        return pd.Series([bool(a <= b * share and binomial_at_most(int(a), int(b), share) <= c) for a, b, c in zip(k, n, level, strict=True)], dtype=bool)

    return passes(F.col(k), F.col(n), level)


def cutoffs(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rule, cutoff: the strictest safe cutoff of each rule in each stratum that has one."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("label_id"))
    held = levels.join(good, F.col("doc_id") == F.col("label_id")).drop("label_id")
    n_rules = len(RULES)
    long = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x")).select("stratum", "x.*")
    tallied = long.groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("m"))
    one = Window.partitionBy("stratum", "rule")
    falling = one.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # At cutoff level + 1 those of higher level are rejected; at 0 all whose level is 0 at least.
    at = tallied.select("stratum", "rule", (F.col("level") + 1).alias("cutoff"), F.coalesce(F.sum("m").over(falling), F.lit(0)).alias("k"), F.sum("m").over(one).alias("n"))
    strata = held.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tested = at.crossJoin(F.broadcast(strata)).withColumn("ok", _passes(ALPHA / n_rules, F.lit(DELTA) / (F.col("n_strata") * n_rules), "k", "n"))
    return tested.where("ok").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, failed (names of broken rules, by comma), keep: a row for each document."""
    levels, _ = materialise(features(docs))
    chosen, size = materialise(cutoffs(levels, labels).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")).select(F.col("stratum").alias("c_stratum"), "cut"))
    judged = levels.join(sized(chosen, size), F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
    broken = [F.when(F.col(r) >= F.try_element_at("cut", F.lit(r)), F.lit(r)) for r in sorted(RULES)]
    return judged.select("doc_id", "stratum", F.concat_ws(",", *broken).alias("failed")).withColumn("keep", F.col("failed") == "")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_SQL_LEVELS = ", ".join(f"CASE WHEN ({p}) > 0 AND ({w}) > 0 THEN (CAST({p} AS BIGINT) * 1000 - 1) // ({w}) ELSE -1 END AS {r}" for r, (p, w) in RULES.items())
OP3_SQL = f"""
WITH counted AS (
  SELECT doc_id, lang AS stratum, length(text) AS n_chars,
         length(text) - length(translate(text, '{CAPITALS}', '')) AS n_capitals,
         length(text) - length(translate(text, '!', '')) AS n_exclamations,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
         len(string_split(text, chr(10))) AS n_lines, len(list_distinct(string_split(text, chr(10)))) AS n_distinct_lines,
         len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words,
         len(list_distinct(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS n_distinct_words
  FROM documents
), levels AS (SELECT doc_id, stratum, {_SQL_LEVELS} FROM counted),
held AS (SELECT l.* FROM levels l JOIN labels g ON l.doc_id = g.doc_id AND g.quality = 1),
long AS ({" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS level FROM held" for r in RULES)}),
tallied AS (SELECT stratum, rule, level, count(*) AS m FROM long GROUP BY ALL),
at_cut AS (
  SELECT stratum, rule, level + 1 AS cutoff,
         CAST(coalesce(sum(m) OVER (PARTITION BY stratum, rule ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k,
         CAST(sum(m) OVER (PARTITION BY stratum, rule) AS BIGINT) AS n,
         (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held)) AS n_strata
  FROM tallied
), near AS (SELECT * FROM at_cut WHERE k <= n * {ALPHA / len(RULES)!r}),
chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM near
  WHERE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)!r}) + (n - i) * ln(1 - {ALPHA / len(RULES)!r})))) <= {DELTA} / (n_strata * {len(RULES)})
  GROUP BY stratum, rule
), cut AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (WHERE rule = '{r}') AS c_{r}" for r in RULES)} FROM chosen GROUP BY stratum)
SELECT l.doc_id, l.stratum,
       concat_ws(',', {", ".join(f"CASE WHEN l.{r} >= c.c_{r} THEN '{r}' END" for r in sorted(RULES))}) AS failed,
       concat_ws(',', {", ".join(f"CASE WHEN l.{r} >= c.c_{r} THEN '{r}' END" for r in sorted(RULES))}) = '' AS keep
FROM levels l LEFT JOIN cut c ON l.stratum IS NOT DISTINCT FROM c.stratum
"""
