"""Table structure: from rows of cells with column spans to numeric columns, header rows and line items.

All is done inside a table's row with array functions, so nothing is shuffled, however many tables there are. A cell that
spans several columns stays one cell: its copies share an id, and wherever "the same cell" matters ids are compared,
never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import let, staged
from docloom.functions.numeric import clean_number, is_number_cell, is_year_cell, match_key
from docloom.functions.text import clean_spaces, words

#: Ids of cells: a row's number times this plus the cell's place in it.
_ROW = 1 << 20


def cell_text(val: Column) -> Column:
    """A cell's text with plain blanks, one of them before a bracket."""
    plain = F.replace(F.coalesce(val, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return let(plain, lambda v: F.when(v.contains("("), F.regexp_replace(v, r"([^()\s]+)\((.+\))", "$1 ($2")).otherwise(v))


def cell_kind(val: Column) -> Column:
    """numeric, text, special (signs beside digits) or null."""
    words_only = F.when(val.rlike("[a-zA-Z]"), "text").otherwise("null")
    return F.when(~val.rlike("[0-9]"), words_only).when(is_number_cell(val), "numeric").when(val.rlike("[a-zA-Z]"), "text").when(val.rlike("[^ 0-9a-zA-Z]"), "special").otherwise("null")


def cell_value(cell: Column) -> Column:
    """A cell's number as text if it is numeric, else its trimmed text."""
    return F.when(cell["kind"] == "numeric", cell["num"].cast("string")).otherwise(F.trim(cell["val"]))


def contains_value(cell: Column) -> Column:
    return F.coalesce(cell["val"].rlike(r"\S"), F.lit(False))


def _cell(id_: Column, val: Column, clean: bool) -> Column:
    def whole(val: Column, kind: Column, number: Column) -> Column:
        return F.struct(id_.cast("bigint").alias("id"), val.alias("val"), kind.alias("kind"), number.alias("num"))

    if not clean:
        return whole(F.coalesce(val, F.lit("")), F.lit("text"), F.lit(None).cast("decimal(38,10)"))
    return let(cell_text(val), lambda v: let(cell_kind(v), lambda k: whole(v, k, F.when(k == "numeric", clean_number(v)))))


def _range(n: Column) -> Column:
    """0 .. n-1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grid(tables: DataFrame, rows_col: str = "rows", clean: bool = True) -> DataFrame:
    """tables with ``grid``: rows of cells (id, val, kind, num), spans expanded, short rows padded, repeated columns dropped; and ``kept``: the columns that were kept."""
    rows = F.coalesce(F.col(rows_col), F.array().cast(tables.schema[rows_col].dataType))
    cells = F.transform(rows, lambda r, i: F.flatten(F.transform(r["values"], lambda v, j: F.array_repeat(_cell(i * _ROW + j, v["val"], clean), F.coalesce(v["colspan"], F.lit(1))))))

    def padded(cells: Column) -> Column:
        blank = lambda r, i, w: F.transform(_range(w - F.size(r)), lambda j: _cell(-(i * _ROW + j) - 1, F.lit(""), clean))
        return let(F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)), lambda w: F.transform(cells, lambda r, i: F.when(F.size(r) < w, F.concat(r, blank(r, i, w))).otherwise(r)))

    def repeated(cells: Column, c: Column) -> Column:
        return (c > 0) & F.forall(cells, lambda r: (F.get(r, c)["id"] == F.get(r, c - 1)["id"]) | (~contains_value(F.get(r, c)) & ~contains_value(F.get(r, c - 1))))

    def kept(cells: Column) -> Column:
        columns = _range(F.coalesce(F.size(F.get(cells, F.lit(0))), F.lit(0)))
        return F.filter(columns, lambda c: ~F.coalesce(repeated(cells, c), F.lit(False))) if clean else columns

    def whole(cells: Column) -> Column:
        return let(kept(cells), lambda ks: F.struct(ks.alias("kept"), F.transform(cells, lambda r: F.transform(ks, lambda c: F.get(r, c))).alias("grid")))

    # Staged, or explosions of the grid would have all of this worked out again for the rows and cells that they look for.
    return staged(tables, _g=let(let(cells, padded), whole)).withColumns({"kept": F.col("_g.kept"), "grid": F.col("_g.grid")}).drop("_g")


def structure(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    """tables with ``grid``, ``numeric_cols``, ``empty_cols``, ``numeric_rows``, ``header_rows``, ``other_rows`` (row numbers) and ``line_items`` (row, caption, values)."""
    out = grid(tables, rows_col)
    cols = _range(F.size("kept"))

    def mostly(c: Column) -> Column:
        """Whether a column has numbers, and more of them than texts."""
        count = lambda kinds, kind: F.size(F.filter(kinds, lambda k: k == kind))
        return let(F.transform("grid", lambda r: F.get(r, c)["kind"]), lambda kinds: let(count(kinds, "numeric"), lambda n: (n >= 1) & (n > count(kinds, "text"))))

    out = out.withColumn("_n0", F.filter(cols, mostly))
    out = out.withColumn("empty_cols", F.when(F.size("grid") > 0, F.filter(cols, lambda c: F.forall("grid", lambda r: F.get(r, c)["kind"] == "null"))).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_ids", F.transform("_n0", lambda c: F.transform(F.filter("grid", lambda r: F.get(r, c)["kind"] == "numeric"), lambda r: F.get(r, c)["id"])))
    ids, n = F.col("_ids"), F.size("_n0")

    def inside(k: Column, j: Column) -> Column:
        return F.size(F.array_except(F.get(ids, k), F.get(ids, j))) == 0

    def surplus(k: Column) -> Column:
        after = (k < n - 1) & F.coalesce(inside(k, k + 1), F.lit(False))
        before = (k > 0) & F.coalesce((F.size(F.get(ids, k)) < F.size(F.get(ids, k - 1))) & inside(k, k - 1), F.lit(False))
        return after | before

    out = out.withColumn("numeric_cols", F.transform(F.filter(_range(n), lambda k: ~surplus(k)), lambda k: F.get("_n0", k))).drop("_n0", "_ids")
    types = F.transform(rows_col, lambda r: r["row_type"])

    def numeric(r: Column) -> Column:
        return F.exists("numeric_cols", lambda c: (F.get(r, c)["kind"] == "numeric") & ~is_year_cell(F.get(r, c)["val"]))

    out = out.withColumn("numeric_rows", F.filter(_range(F.size("grid")), lambda i: ~F.coalesce(F.get(types, i) == "header", F.lit(False)) & numeric(F.get("grid", i))))
    first = F.array_min("numeric_rows")
    out = out.withColumn("header_rows", F.when(first.isNotNull(), _range(first)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("other_rows", F.when(first.isNotNull(), F.array_except(F.filter(_range(F.size("grid")), lambda i: i >= first), F.col("numeric_rows"))).otherwise(F.array().cast("array<int>")))

    def caption(r: Column) -> Column:
        values = F.transform(F.filter("numeric_cols", lambda c: F.get(r, c)["kind"] == "numeric"), lambda c: F.get(r, c)["id"])
        own = let(values, lambda vs: F.array_distinct(F.transform(F.filter(r, lambda x: ~F.array_contains(vs, x["id"])), lambda x: F.struct(x["id"].alias("id"), x["val"].alias("val")))))
        text = clean_spaces(F.array_join(F.transform(own, lambda x: F.regexp_replace(x["val"], r"^\s+|\s+$", "")), " "))
        return let(text, lambda t: F.when(t != "", t).otherwise("n/a"))

    item = F.transform("numeric_rows", lambda i: let(F.get("grid", i), lambda r: F.struct(i.alias("row"), caption(r).alias("caption"), F.transform("numeric_cols", lambda c: F.get(r, c)["num"]).alias("values"))))
    return out.withColumn("line_items", item)


def cells(gridded: DataFrame, *keys: str) -> DataFrame:
    """One row for each final cell: the keys, row_idx, col_idx, cell_id, val, kind, num."""
    rows = gridded.select(*keys, F.posexplode("grid").alias("row_idx", "_r"))
    return rows.select(*keys, "row_idx", F.posexplode("_r").alias("col_idx", "_c")).select(*keys, "row_idx", "col_idx", F.col("_c.id").alias("cell_id"), F.col("_c.val").alias("val"), F.col("_c.kind").alias("kind"), F.col("_c.num").alias("num"))


def line_items(structured: DataFrame, *keys: str) -> DataFrame:
    """One row for each line item and value: the keys, li_idx, caption, col, value.

    Outer explosions: the optimizer would push tests for empty lists down into what makes the tables, again and again.
    """
    items = structured.select(*keys, "numeric_cols", F.posexplode_outer("line_items").alias("li_idx", "_i"))
    rows = items.select(*keys, "li_idx", F.col("_i.caption").alias("caption"), F.posexplode_outer("_i.values").alias("_k", "value"), "numeric_cols").where("_k is not null")
    return rows.select(*keys, "li_idx", "caption", F.get("numeric_cols", F.col("_k")).alias("col"), "value")


def merge_columns(row: Column, columns: list[int]) -> Column:
    """A row of cells in which the first of ``columns`` takes the first text among them and the others are gone."""
    first, *rest = columns
    texts = F.filter(F.array(*(F.when(contains_value(F.get(row, c)), F.get(row, c)["val"]) for c in columns)), lambda x: x.isNotNull())
    merged = _cell(F.get(row, first)["id"], F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit("")), True)
    return F.filter(F.transform(row, lambda x, i: F.when(i == first, merged).when(~i.isin(*rest) if rest else F.lit(True), x)), lambda x: x.isNotNull())


def has_values(row: Column, upto: int | None = None) -> Column:
    """Whether a cell up to a column says anything."""
    return F.exists(row if upto is None else F.slice(row, 1, upto + 1), contains_value)


def text(structured: Column | str = "grid") -> Column:
    """All cells' texts, joined by blanks."""
    return F.array_join(F.flatten(F.transform(structured, lambda r: F.transform(r, lambda c: c["val"]))), " ")


def text_with_numbers() -> Column:
    """A structured table for a prompt: its rows and numbered cells, without blank ones and empty columns."""

    def row(r: Column, i: Column) -> Column:
        kept = F.filter(F.transform(r, lambda c, k: F.when(~F.array_contains("empty_cols", k), c)), lambda c: c.isNotNull())
        parts = F.filter(F.transform(kept, lambda c, k: F.when(contains_value(c), F.concat(F.lit("(col "), k.cast("string"), F.lit("): "), c["val"]))), lambda x: x.isNotNull())
        return F.concat_ws(" ", F.concat(F.lit("(row "), i.cast("string"), F.lit(") \n")), parts, F.lit(" (row end);\n"))

    return F.concat(F.lit("table: "), F.regexp_replace(F.array_join(F.transform("grid", row), " "), " +", " "))


def text_without_numbers() -> Column:
    """The texts of cells that say something in words, without repeating the one before in the row."""

    def row(r: Column) -> Column:
        kept = F.filter(F.transform(r, lambda c, k: F.when(~F.array_contains("empty_cols", k), c["val"])), lambda v: v.isNotNull() & ~is_number_cell(v) & (F.size(words(v)) > 0))
        return F.filter(F.transform(kept, lambda v, k: F.when((k == 0) | ~v.eqNullSafe(F.get(kept, k - 1)), v)), lambda v: v.isNotNull())

    return F.concat(F.lit("table: "), F.regexp_replace(F.array_join(F.flatten(F.transform("grid", row)), ", "), " +", " "))


def dimension() -> Column:
    return F.struct(F.size("grid").alias("rows"), F.coalesce(F.size(F.get("grid", F.lit(0))), F.lit(0)).alias("columns"))


def column_values(c: Column) -> Column:
    """The numbers of a column, null where a cell has none."""
    return F.transform("grid", lambda r: F.get(r, c)["num"])


def numbers_for_matching() -> Column:
    """The keys by which a table's numbers match those of others, whatever their scale."""
    nums = F.flatten(F.transform("grid", lambda r: F.transform(F.filter(r, lambda c: c["num"].isNotNull()), lambda c: match_key(F.regexp_replace(F.format_string("%s", c["num"].cast("string")), r"\.?0+$", "")))))
    return nums


def header_end(items: Column) -> Column:
    """Of rows of value texts, the first that has a number which is no year; 0 if none has."""
    hits = F.filter(_range(F.size(items)), lambda i: F.exists(F.get(items, i), lambda v: is_number_cell(v) & ~is_year_cell(v)))
    return F.coalesce(F.array_min(hits), F.lit(0))


def rows_from_items(items: Column) -> Column:
    """Rows of pre-extracted line items (caption, values): the caption's cell first, header rows before the first number."""
    end = header_end(F.transform(items, lambda x: x["values"]))
    cell = lambda v: F.struct(v.alias("val"), F.lit(1).alias("colspan"))
    return F.transform(items, lambda x, i: F.struct(F.when(i >= end, "body").otherwise("header").alias("row_type"), F.concat(F.array(cell(x["caption"])), F.transform(x["values"], cell)).alias("values")))
