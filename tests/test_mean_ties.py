"""Means at ties of rounding."""

from __future__ import annotations

from random import Random

import __spark_entry__

QUERIES = __spark_entry__.queries()


def test_means_at_ties_do_not_depend_on_order(spark, tmp_path):
    """The mean of 200 prices whose cents are 99 by 200 lies between two numbers of four digits, and its second digit depends on which it becomes."""
    draw, rows, want = Random(7), [], {}
    for supplier in range(40):
        cents = [draw.randrange(100_000, 10_000_000) for _ in range(199)]
        cents.append(5_000_000 + (99 - sum(cents)) % 200)
        rows += [(supplier, c / 100) for c in cents]
        # Half up to four digits, then to two, in whole numbers.
        n = (((sum(cents) * 200 // len(cents) + 1) // 2) + 50) // 100
        want[supplier] = f"{n // 100}.{n % 100:02d}"
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.l_suppkey: r["mean"] for r in QUERIES["column_means"](spark, str(tmp_path)).collect()} == want
