"""The row-wise stages on streams: replies as they come in become typed answers, each batch written once.

Parsing keeps no state, so it runs on a stream as on a table; running scores keep sums by model under a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.answers import parse_typed


def typed_stream(replies: DataFrame, kind: str, raw_col: str = "reply", values: list[str] | None = None) -> DataFrame:
    """A stream of replies with ``value`` and ``ok``."""
    listed: Column | None = F.array(*map(F.lit, values)) if values else None
    return replies.withColumn("_v", parse_typed(F.lit(kind), F.col(raw_col), listed)).select("*", F.col("_v.value").alias("value"), F.col("_v.ok").alias("ok")).drop("_v")


def success_by_window(answers: DataFrame, time_col: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """How many answers each model gave and how many were read, by time windows."""
    return answers.withWatermark(time_col, late).groupBy(F.window(time_col, width), "model").agg(F.count("*").alias("n_answers"), F.count_if("ok").alias("n_ok"))


def write_stream(answers: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream to Parquet, each batch once even if it is run again."""
    return answers.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
