"""Frames that are written before they are read on, values that are worked out once inside an expression, and row numbers over whole tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder, so that what made it runs once and lost executors repeat none of it.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where none is configured and the session is local.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(folder)
    # Files of frames that nothing refers to any more are deleted, unless the session says otherwise.
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, which inside lambdas nothing else sees to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it has fewer: a single small file would keep one core busy. Larger inputs stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row. The optimizer copies an expression into all that use it and pushes filters into it, but not through a generator."""
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(row)).alias("_staged")).select(*kept, *(F.col("_staged")[n].alias(n) for n in columns))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's number from 0 in the order of columns, by ranges: a range's rows are sorted in one task, and only the ranges' sizes come to the driver."""
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    before, starts = 0, []
    for k in sorted(sizes):
        starts += [F.lit(k), F.lit(before)]
        before += sizes[k]
    start = F.create_map(*starts)[F.col("_range")] if starts else F.lit(0)
    row = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn(name, (start + row).cast("bigint")).drop("_range")
