"""Columns of groups: those of equally wide parts without Python, all as by align()."""

from __future__ import annotations

from decimal import Decimal
from random import Random

from docloom.operators import detection as D

TABLES = "source_identifier string, element_index int, numeric_cols array<int>, line_items array<struct<caption:string,values:array<decimal(38,10)>>>, grid array<array<struct<num:decimal(38,10)>>>"
GROUPS = "source_identifier string, group_id int, detected_class string, element_index int, part int, collapse boolean, prob double"


def test_columns_as_aligned(spark):
    draw, tables, groups, want = Random(5), [], [], []
    for g in range(60):
        doc, collapse, parts = str(g // 2), g % 5 == 0, []
        width = draw.randrange(0, 4)
        for part in range(draw.randrange(1, 4)):
            e, n = 10 * (g % 2) + part, width if g % 3 else draw.randrange(0, 4)
            values = [[Decimal(draw.randrange(1000)) if draw.random() < 0.7 else None for _ in range(n)] for _ in range(draw.randrange(0, 4))]
            captions = [draw.choice("abc") for _ in values]
            tables.append((doc, e, list(range(1, n + 1)), list(zip(captions, values)), [[(v,) for v in [None, *row]] for row in values]))
            groups.append((doc, g % 2, "t", e, part, collapse, 0.8))
            means = [D._mean([row[c] for row in values]) for c in range(n)]
            parts.append({"element_index": e, "captions": captions, "columns": [{"col": c + 1, "values": [row[c] for row in values]} for c in range(n)], "means": means})
        want += [(doc, g % 2, "t", c["col_idx"], c["original"], c["element_index"], c["pairs"]) for c in D.align(parts, collapse)]
    out = D.output_columns(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(tables, TABLES))
    got = [(r.source_identifier, r.group_id, r.detected_class, r.col_idx, r.original_col, r.element_index, [tuple(p) for p in r.pairs]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
