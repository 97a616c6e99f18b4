"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are uniform, so fixed ranges of the
key range-sort each source into parts of like size without sampling; token
counts are summed within the parts, then over the parts, which gives every
document its interval of the source's tokens. A source's budget is its share of
all tokens; it is cut at exactly that many tokens, after as many whole epochs
as fit.

A token is a run of characters other than ASCII white space. Cases: a null or
blank text has no tokens and is never taken; a null source is a source of its
own; sources without tokens take no part; rows that repeat a doc_id are separate
documents, ordered by doc_id, tokens and text; without a doc_id a document's key
is its text's; an empty table gives an empty
result; further columns pass through ``mix_documents`` whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, quoted, read, sized

SEED = "mix-1"
#: Integer weights by source; a source not named has DEFAULT_WEIGHT.
WEIGHTS: dict[str, int] = {"src0": 3, "src1": 2}
DEFAULT_WEIGHT = 1
#: Rows that a part of the range sort is planned for.
PART_ROWS = 1 << 16

_TOKEN = r"[^ \t\n\x0B\f\r]+"


def _key() -> Column:
    """Hash of the doc_id; of the text where there is none, so that such documents spread over the parts too."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("text")), F.lit("null"))))


def _weight(weights: Mapping[str, int], source: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(source == F.lit(name), F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, n_tokens, th (hash of the text): all that ordering and sums need, no texts."""
    return docs.select(
        "doc_id", "source", _key().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(_TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("text").alias("th"),
    ).where("n_tokens > 0")


def _budgets(keyed: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """source, total, rows, budget: one row for each source that has tokens."""
    by = keyed.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("rows"))
    by = by.withColumn("weight", _weight(weights, F.col("source")))
    whole = by.agg(F.sum("total").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    return by.crossJoin(F.broadcast(whole)).select("source", "total", "rows", F.expr("cast(all_tokens * cast(weight as decimal(20,0)) div all_weight as long)").alias("budget"))


def _intervals(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """keyed with total, budget, start (the tokens of the source that come before the document) and tie (its place among rows that are equal in the order)."""
    b = budgets.select(F.col("source").alias("b_source"), "total", "budget", F.greatest(F.lit(1), F.ceil(F.col("rows") / PART_ROWS)).cast("long").alias("parts"))
    part = F.expr("conv(substr(key, 1, 8), 16, 10) * parts div 4294967296")
    parted = keyed.join(b, F.col("source").eqNullSafe(F.col("b_source"))).withColumn("part", part.cast("long"))
    sums = parted.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(F.col("source").alias("h_source"), F.col("part").alias("h_part"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "n_tokens", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("source", "part").orderBy("key", "doc_id", "n_tokens", "th")
    local = parted.withColumn("upto", F.sum("n_tokens").over(within)).withColumn("tie", F.row_number().over(order) - F.rank().over(order))
    return local.join(heads, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("part") == F.col("h_part"))).withColumn("start", F.col("head") + F.col("upto") - F.col("n_tokens"))


def _epochs() -> Column:
    """Epochs in which a document is taken, and from it the tokens of each: all of them but in the last."""
    full, rest = F.expr("budget div total"), F.col("budget") % F.col("total")
    return F.sequence(F.lit(0).cast("long"), full - F.when(F.col("start") < rest, 0).otherwise(1))


def _taken(intervals: DataFrame) -> DataFrame:
    rest = F.col("budget") % F.col("total")
    some = intervals.where((F.expr("budget div total") > 0) | (F.col("start") < rest))
    return some.withColumn("epoch", F.explode(_epochs())).withColumn(
        "take_tokens", F.when(F.col("epoch") < F.expr("budget div total"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), rest - F.col("start")))
    )


def mix_sources(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """doc_id, source, epoch, n_tokens, start, take_tokens: a row for each time that a document is taken.

    Over a source, take_tokens adds up to its budget exactly; only the last
    document of a source's last epoch may be taken in part.
    """
    keyed, _ = materialise(_keyed(docs))
    budgets, size = materialise(_budgets(keyed, weights))
    return _taken(_intervals(keyed, sized(budgets, size))).select("doc_id", "source", "epoch", "n_tokens", "start", "take_tokens")


def _first_tokens(text: pd.Series, n: pd.Series) -> pd.Series:
    """text up to the end of its n-th token."""
    return pd.Series([next(itertools.islice(re.finditer(_TOKEN, t), k - 1, None)).end() for t, k in zip(text, n, strict=True)], dtype="int64").combine(text, lambda end, t: t[:end])


def mix_documents(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each time that a document is taken.

    The document that a budget ends in keeps its first take_tokens tokens (and
    n_chars follows), so that the tokens of a source are its budget exactly.
    Texts don't move: the place of each source's cut goes to the documents.
    """
    columns = docs.columns
    keyed, _ = materialise(_keyed(docs))
    budgets, size = materialise(_budgets(keyed, weights))
    spans = _intervals(keyed, sized(budgets, size))
    rest = F.expr("budget % total")
    order = F.struct("key", "doc_id", "n_tokens", "th")
    edge = spans.where((F.col("start") < rest) & (F.col("start") + F.col("n_tokens") >= rest)).select(F.col("source").alias("e_source"), order.alias("edge"), F.col("tie").alias("edge_tie"), (rest - F.col("start")).alias("edge_take"))
    cuts, cut_size = materialise(budgets.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("c_source"), F.expr("budget div total").alias("whole"), "edge", "edge_tie", "edge_take"))
    # Columns go into a box under names of their own, so none of docs' names can clash.
    box = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    boxed = docs.select(box.alias("box"), "doc_id", "source", _key().alias("key"), F.coalesce(F.regexp_count("text", F.lit(_TOKEN)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("text").alias("th")).where("n_tokens > 0")
    side = F.when(F.col("edge").isNull() | (order > F.col("edge")), 1).when(order < F.col("edge"), -1).otherwise(0)
    placed = boxed.join(sized(cuts, cut_size), F.col("source").eqNullSafe(F.col("c_source"))).withColumn("side", side)
    off = placed.where("side <> 0").select("box", (F.col("whole") + (F.col("side") < 0).cast("long")).alias("n"))
    # Rows that are equal in all that orders them stand at the edge together, one after the other.
    at_edge = placed.where("side = 0").withColumn("tie", F.row_number().over(Window.partitionBy("source").orderBy("key")) - 1)
    fits = (F.col("tie") < F.col("edge_tie")) | ((F.col("tie") == F.col("edge_tie")) & (F.col("edge_take") == F.col("n_tokens")))
    on = at_edge.select("box", (F.col("whole") + fits.cast("long")).alias("n"))
    whole = off.unionByName(on).where("n > 0").withColumn("nth", F.explode(F.expr("sequence(cast(1 as bigint), n)")))
    plain = [F.col(f"box.c{i}").alias(c) for i, c in enumerate(columns)]
    partial = at_edge.where("tie = edge_tie and edge_take < n_tokens").withColumn("short", F.pandas_udf(_first_tokens, "string")(F.col(f"box.c{columns.index('text')}"), F.col("edge_take").cast("int")))
    changed = {"text": F.col("short"), "n_chars": F.length("short")}
    cut_down = [(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"box.c{i}")).alias(c) for i, c in enumerate(columns)]
    return whole.select(*plain).union(partial.select(*cut_down))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH keyed AS (
  SELECT doc_id, source, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), concat('null:', md5(text)), 'null'))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n_tokens, md5(text) AS th
  FROM documents
), filled AS (SELECT * FROM keyed WHERE n_tokens > 0),
weighted AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total,
         CASE {' '.join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END AS weight
  FROM filled GROUP BY source
), budgets AS (
  SELECT source, total, CAST((sum(total) OVER ()) * weight // (sum(weight) OVER ()) AS BIGINT) AS budget FROM weighted
), spans AS (
  SELECT s.doc_id, s.source, s.n_tokens, b.total, b.budget,
         CAST(sum(s.n_tokens) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.n_tokens, s.th ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.n_tokens AS start
  FROM filled s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
), taken AS (
  SELECT *, unnest(range(0, budget // total + CASE WHEN start < budget % total THEN 1 ELSE 0 END)) AS epoch FROM spans
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, n_tokens, start,
       CASE WHEN epoch < budget // total THEN n_tokens ELSE least(n_tokens, budget % total - start) END AS take_tokens
FROM taken
"""
