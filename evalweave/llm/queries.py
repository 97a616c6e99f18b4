"""Queries of the corpus operators, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_shipped
from . import exact, language, language_model, licences, mixing, quality, sentencepieces, simhash, suffixes, wrappers

Query = Callable[[SparkSession, str], DataFrame]

_OPERATORS: dict[str, Query] = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        suffixes.op2_suffix_repeats,
        quality.op3_quality_rules,
        language_model.op4_lm_scoring,
        sentencepieces.op5_sentencepiece,
        language.op6_language_id,
        wrappers.op7_html_extraction,
        exact.op8_exact_dedup,
        simhash.op9_simhash_near_dedup,
        licences.op10_license_scan,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": mixing.OP1_SQL, "op3_quality_rules": quality.OP3_SQL, "op8_exact_dedup": exact.OP8_SQL}


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ensure_shipped(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    """opN_<name> for each operator, and the pipeline."""
    import corpus_pipeline

    return {name: _ready(q) for name, q in _OPERATORS.items()} | {"pipeline": _ready(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
