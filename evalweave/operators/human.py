"""Human labels: validation, adjudication, terminal labels and preference pairs.

Annotations: item_id, response_id, label, score, reviewer, scenario_hash,
rubric_version, annotated_at, status, adjudicated_at, annotation_ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ["pass", "fail", "tie", "invalid"]
STATUSES = ["pending", "agreed", "conflicted", "adjudicated", "rejected"]
KEY = ["item_id", "response_id"]


def errors() -> Column:
    """Everything that is wrong with an annotation row, as an array of text."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"{c} is empty")) for c in ("item_id", "response_id", "reviewer", "scenario_hash", "rubric_version")],
        F.when(~F.coalesce(F.col("label"), F.lit("")).isin(LABELS), F.lit("label is unknown")),
        F.when(~F.coalesce(F.col("status"), F.lit("")).isin(STATUSES), F.lit("status is unknown")),
        F.when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1), F.lit("score lies outside 0..1")),
        F.when(F.try_to_timestamp("annotated_at").isNull(), F.lit("annotated_at is no time")),
        F.when((F.col("status") == "adjudicated") & F.try_to_timestamp("adjudicated_at").isNull(), F.lit("adjudicated_at is no time")),
    ))


def validate(annotations: DataFrame) -> DataFrame:
    """annotation_ord, error: a row for each error."""
    return annotations.select("annotation_ord", F.explode(errors()).alias("error"))


def conflicts(annotations: DataFrame) -> DataFrame:
    """item_id, response_id, labels of responses whose final labels differ; what was adjudicated is settled."""
    final = F.when(F.col("status").isin("agreed", "pending", "conflicted"), F.col("label"))
    by = annotations.groupBy(*KEY).agg(F.array_sort(F.collect_set(final)).alias("labels"), F.max((F.col("status") == "adjudicated").cast("int")).alias("settled"))
    return by.where("size(labels) > 1 and settled = 0").select(*KEY, "labels")


def terminal(annotations: DataFrame) -> DataFrame:
    """The label that counts for each response: the newest adjudicated one, else the agreed one of highest score."""
    final = annotations.where("status in ('adjudicated', 'agreed')")
    when = F.coalesce(F.try_to_timestamp("adjudicated_at"), F.try_to_timestamp("annotated_at"))
    settled = F.col("status") == "adjudicated"
    order = Window.partitionBy(*KEY).orderBy(settled.desc(), F.when(settled, when).desc_nulls_last(), F.when(~settled, F.col("score")).desc_nulls_last(), F.col("annotation_ord"))
    return final.withColumn("pos", F.row_number().over(order)).where("pos = 1").drop("pos")


def preference_pairs(annotations: DataFrame) -> DataFrame:
    """item_id, chosen, rejected: the best passed against the worst failed response of each item that has both."""
    t = terminal(annotations)
    passed, failed = F.when(F.col("label") == "pass", F.struct(F.col("score"), (-F.col("annotation_ord")).alias("o"))), F.when(F.col("label") == "fail", F.struct("score", "annotation_ord"))
    by = t.groupBy("item_id").agg(
        F.max_by("response_id", passed).alias("chosen"), F.max(passed)["score"].alias("chosen_score"), F.min_by("response_id", failed).alias("rejected"), F.min(failed)["score"].alias("rejected_score")
    )
    return by.where("chosen_score is not null and rejected_score is not null")


def adjudicate(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """annotations with a row for each decision, which takes hash and rubric version from the response's first annotation where it has none."""
    first = annotations.groupBy(*KEY).agg(F.min_by(F.struct("scenario_hash", "rubric_version"), "annotation_ord").alias("f"))
    last = annotations.agg(F.coalesce(F.max("annotation_ord"), F.lit(0)).alias("last"))
    made = decisions.join(first, KEY, "left").crossJoin(F.broadcast(last)).select(
        *KEY, "label", "score", F.col("adjudicator").alias("reviewer"),
        F.coalesce(decisions["scenario_hash"], F.col("f.scenario_hash")).alias("scenario_hash"), F.coalesce(decisions["rubric_version"], F.col("f.rubric_version")).alias("rubric_version"),
        F.col("adjudicated_at").alias("annotated_at"), F.lit("adjudicated").alias("status"), "adjudicated_at", (F.col("last") + F.col("decision_ord")).alias("annotation_ord"),
    )
    return annotations.unionByName(made)
