"""The texts around a column of a structured table, as features of what the column means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.numeric import is_number_cell, is_year_cell
from docloom.functions.text import clean_for_vectors
from docloom.operators.tables import contains_value

REGIONS = (
    "before", "li_and_values", "top_li", "top_li_reworked", "top_data", "top_column_all", "top_column_pos_0", "top_column_pos_1", "top_column_pos_2",
    "total_header_values", "other_li", "other_values", "neighbor_col_top_left", "neighbor_col_top_right",
)


def _once(cells: Column) -> Column:
    """The cells' texts, each cell once, joined by blanks."""
    return F.array_join(F.transform(F.array_distinct(F.transform(cells, lambda c: F.struct(c["id"].alias("id"), c["val"].alias("val")))), lambda c: c["val"]), " ")


def meta_features(columns: DataFrame, base_year: int | None = None, number: str = "[number]", row_mark: str = "(row start)", cell_mark: str = "(cell start)", self_mark: str = "(cell main)", before_col: str | None = None) -> DataFrame:
    """columns: one row for each column ``original_col`` of a structured table (grid, numeric_cols, numeric_rows, header_rows, other_rows), with the cleaned texts of REGIONS."""
    grid, chosen = F.col("grid"), F.col("original_col")
    first = F.array_min("numeric_cols")
    row = lambda i: F.get(grid, i)
    rows = lambda which: F.transform(which, row)

    def region(which: str, keep) -> Column:
        """Cells of rows of a kind that ``keep`` (of cell and column) takes."""
        return F.flatten(F.transform(rows(which), lambda r: F.filter(F.transform(r, lambda c, i: F.when(keep(c, i), c)), lambda c: c.isNotNull())))

    header = rows("header_rows")
    in_column = lambda col: F.transform(header, lambda r: F.get(r, col))
    start = F.coalesce(F.array_min("numeric_rows") - 1, F.lit(0))
    above = F.filter(F.transform(F.when(start >= 0, F.sequence(start, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.get(row(i), chosen)), contains_value)
    reworked = F.flatten(
        F.transform(
            F.filter(header, lambda r: F.exists(F.slice(r, F.lit(1), first), contains_value)),
            lambda r: F.filter(F.transform(r, lambda c, i: F.when((i < first) & (c["id"] != F.get(r, first)["id"]), c)), lambda c: c.isNotNull()),
        )
    )
    marks = F.flatten(
        F.transform(
            F.filter(header, lambda r: F.exists(r, contains_value)),
            lambda r: F.concat(F.array(F.lit(row_mark)), F.flatten(F.transform("numeric_cols", lambda c: F.array(F.when(c == chosen, cell_mark + self_mark).otherwise(cell_mark), F.get(r, c)["val"])))),
        )
    )
    place = F.array_position("numeric_cols", chosen).cast("int") - 1
    neighbour = lambda k: F.when(F.get("numeric_cols", place + k).isNotNull() & (place + k >= 0), _once(in_column(F.get("numeric_cols", place + k))))
    texts = {
        "before": F.col(before_col) if before_col else F.lit(""),
        "li_and_values": _once(region("numeric_rows", lambda c, i: ~(is_number_cell(c["val"]) & ~is_year_cell(c["val"])))),
        "top_li": _once(region("header_rows", lambda c, i: i < first)),
        "top_li_reworked": _once(reworked),
        "top_data": _once(region("header_rows", lambda c, i: i >= first)),
        "top_column_all": _once(in_column(chosen)),
        **{f"top_column_pos_{k}": F.get(above, F.lit(k))["val"] for k in range(3)},
        "total_header_values": F.array_join(marks, " "),
        "other_li": _once(region("other_rows", lambda c, i: i < first)),
        "other_values": _once(region("other_rows", lambda c, i: i >= first)),
        "neighbor_col_top_left": neighbour(-1),
        "neighbor_col_top_right": neighbour(1),
    }
    return columns.select("*", *(clean_for_vectors(texts[r], base_year, number=number).alias(r) for r in REGIONS))
