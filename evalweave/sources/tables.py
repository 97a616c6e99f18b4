"""The test tables read as evaluation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runner_id, scenario_id, axis, value, score_ord from lineitem; score_ord is a total order."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 4).cast("string")).alias("runner_id"),
        F.concat(F.lit("s"), (F.col("l_partkey") % 500).cast("string")).alias("scenario_id"),
        F.col("l_returnflag").alias("axis"),
        (F.col("l_discount") * 10).alias("value"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag").alias("score_ord"),
    )


SCORES_SQL = """
  SELECT concat('r', l_suppkey % 4) AS runner_id, concat('s', l_partkey % 500) AS scenario_id, l_returnflag AS axis,
         l_discount * 10 AS value, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag) AS score_ord
  FROM lineitem
"""


def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of another run, of one runner over somewhat other scenarios, from orders."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(
        F.lit("r0").alias("runner_id"),
        F.concat(F.lit("s"), (F.col("o_orderkey") % 510).cast("string")).alias("scenario_id"),
        F.expr("case o_custkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end").alias("axis"),
        (F.col("o_custkey") % 101 / 100).alias("value"),
        F.struct("o_orderkey").alias("score_ord"),
    )


SECOND_SQL = """
  SELECT 'r0' AS runner_id, concat('s', o_orderkey % 510) AS scenario_id,
         CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS axis, (o_custkey % 101) / 100 AS value, o_orderkey AS score_ord
  FROM orders WHERE o_orderkey % 7 <> 0
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses from events."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("runner_id"),
        F.col("event_type").alias("scenario_id"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("accessed_at"),
        F.col("event_id").alias("response_ord"),
        (F.col("event_type") == "error").alias("refusal"),
        k.alias("prompt_tokens"),
        F.when(k % 3 == 0, k * 2).alias("completion_tokens"),
        F.when(k % 5 != 0, k * 0.25).alias("cost_usd"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, F.lit("p-even")).otherwise(F.lit("p-odd")).alias("provider"),
    )


RESPONSES_SQL = """
  SELECT concat('r', user_id % 4) AS runner_id, event_type AS scenario_id, value AS latency_ms, ts AS accessed_at, event_id AS response_ord,
         event_type = 'error' AS refusal, k AS prompt_tokens, CASE WHEN k % 3 = 0 THEN k * 2 END AS completion_tokens,
         CASE WHEN k % 5 <> 0 THEN k * 0.25::DOUBLE END AS cost_usd, concat('model-', user_id % 3) AS model,
         CASE WHEN event_id % 2 = 0 THEN 'p-even' ELSE 'p-odd' END AS provider
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario_id, slices from part: brands of a scenario's parts (repeats stay), and one size class."""
    p = table(spark, sf_dir, "part").where("p_partkey % 500 < 400")
    return p.groupBy(F.concat(F.lit("s"), (F.col("p_partkey") % 500).cast("string")).alias("scenario_id")).agg(
        F.create_map(F.lit("brand"), F.sort_array(F.collect_list("p_brand")), F.lit("large"), F.array(F.max(F.col("p_size") > 40).cast("string"))).alias("slices")
    )


SLICES_SQL = """
  SELECT concat('s', p_partkey % 500) AS scenario_id, concat('brand=', p_brand) AS slice FROM part WHERE p_partkey % 500 < 400
  UNION ALL
  SELECT concat('s', p_partkey % 500), concat('large=', CAST(max(p_size) > 40 AS VARCHAR)) FROM part WHERE p_partkey % 500 < 400 GROUP BY 1
"""
