"""Small tables for the tests of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, rows, lang: str = "en", source: str = "web") -> DataFrame:
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, lang, source)[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in full], SCHEMA)
