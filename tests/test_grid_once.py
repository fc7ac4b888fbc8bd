"""A table's cells are worked out once, whatever is then looked for in them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docloom.functions.text import composition
from docloom.functions.numeric import is_number_cell
from docloom.operators import tables as T

QUERIES = __spark_entry__.queries()


@pytest.mark.parametrize("name", ["table_cells", "table_rows", "table_structure", "table_line_items", "table_texts", "table_accessors", "column_texts", "element_features"])
def test_cells_are_made_in_one_place(spark, data_dir, name):
    plan = QUERIES[name](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(str(T._ROW)) == 2  # the ids of cells and of those that rows are padded with


def test_kinds_and_values_as_by_their_definitions(spark):
    texts = ["", " ", "\t", "1", "(5)", "5 (net)", "a1", "1/2", "-", "1.5%", "é", "é1", "(x)", "1 é", "12,5", " ", "€ 5", "5€", "/", "2000", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    c = composition(F.col("t"))
    kind = F.when(is_number_cell(F.col("t")), "numeric").when(c["text"] > 0, "text").when(c["special"] > 0, "special").otherwise("null")
    some = F.coalesce(F.trim(F.regexp_replace("t", r"\s", " ")) != "", F.lit(False))
    rows = d.select("t", T.cell_kind(F.col("t")).alias("kind"), kind.alias("kind2"), T.contains_value(F.struct(F.col("t").alias("val"))).alias("some"), some.alias("some2")).collect()
    assert [(r.t, r.kind, r.some) for r in rows] == [(r.t, r.kind2, r.some2) for r in rows]
