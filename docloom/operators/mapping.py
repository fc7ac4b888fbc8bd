"""Rows of tables in buckets, columns as tables, pivots, merges of columns, and matches by numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import cut
from docloom.schemas import NOT_SPECIFIED


def li_identifier(captions: Column) -> Column:
    """What names the sequence of a table's line items: a hash of "0: a, 1: b"."""
    return F.sha2(F.array_join(F.transform(captions, lambda c, i: F.concat(i.cast("string"), F.lit(": "), F.coalesce(c, F.lit("")))), ", "), 256)


def kv_identifier(pairs: Column) -> Column:
    """What names a column's items and values: a hash of their JSON text."""
    return F.sha2(F.to_json(pairs), 256)


def tables_from_columns(columns: DataFrame) -> DataFrame:
    """Columns (li_identifier, detected_class, pos, name, pairs) as tables: line_items, and columns in their order."""
    out = columns.groupBy("li_identifier", "detected_class").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "pairs"))).alias("columns"))
    return out.withColumn("line_items", F.transform(F.get("columns", F.lit(0))["pairs"], lambda p: p["line_item"]))


def column_name(meta: Column, col_idx: Column) -> Column:
    """ "class:value" of all meta entries by underscores, or "col" and the column's number."""
    joined = F.array_join(F.transform(meta, lambda m: F.concat(m["class_id"], F.lit(":"), m["class_value"])), "_")
    return F.when(F.size(meta) > 0, joined).otherwise(F.concat(F.lit("col"), col_idx.cast("string")))


def pivot(values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long values (keys, li_idx, line_item, name, pos, value) as one row a line item and a column a name; of equal names the last column counts."""
    picked = [F.max_by("value", F.when(F.col("name") == n, F.col("pos"))).alias(n) for n in names]
    return values.groupBy(*keys, "li_idx", "line_item").agg(*picked)


def buckets(values: DataFrame, mapping: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """Sums of values (table_id, li_idx, value) by the bucket (table_id, li_idx, bucket_id) of their item; nulls count as nothing.

    A table whose mapping has another number of items than its values gives no sums. With ``schema``
    (bucket_id, multiplier, method) sums are multiplied, or maxima taken, as it says; else neither applies.
    """
    n_values, n_map = values.groupBy("table_id").agg(F.count("*").alias("_nv")), mapping.groupBy("table_id").agg(F.count("*").alias("_nm"))
    whole = n_values.join(n_map, "table_id").where("_nv = _nm").select("table_id")
    rows = values.join(mapping, ["table_id", "li_idx"]).join(whole, "table_id", "left_semi")
    if schema is None:
        return rows.groupBy("table_id", "bucket_id").agg(F.sum(F.coalesce("value", F.lit(0))).alias("value"))
    rows = rows.join(schema, "bucket_id", "left").withColumn("_v", F.coalesce("value", F.lit(0)) * F.coalesce("multiplier", F.lit(1)))
    return rows.groupBy("table_id", "bucket_id").agg(F.when(F.first(F.coalesce("method", F.lit("SUM"))) == "MAX", F.max("_v")).otherwise(F.sum("_v")).alias("value"))


def roll_up(sums: DataFrame, schema: DataFrame, depth: int) -> DataFrame:
    """Sums by bucket with those of the buckets below them (schema: bucket_id, parent_id; ``depth``: levels of the tree)."""
    up = schema.select(F.col("bucket_id").alias("_b"), F.col("parent_id").alias("_p"))
    level, out = sums, sums
    for _ in range(depth - 1):
        level = level.join(up, F.col("bucket_id") == F.col("_b")).where("_p is not null").select("table_id", F.col("_p").alias("bucket_id"), "value")
        out = out.unionByName(level)
    return out.groupBy("table_id", "bucket_id").agg(F.sum("value").alias("value"))


def with_unclassified(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The choices (table_id, li_idx, bucket_id), and for items (table_id, li_idx) without any the bucket of what is not specified."""
    rest = items.join(chosen, ["table_id", "li_idx"], "left_anti").select("table_id", "li_idx", F.lit(NOT_SPECIFIED).alias("bucket_id"))
    return chosen.select("table_id", "li_idx", "bucket_id").unionByName(rest)


def mapping_schema(tables: DataFrame, items: DataFrame) -> DataFrame:
    """tables (detected_class) with the mapping schema of the first item (id, order, schema_id) of their class; tables without one are left out. Items are few: Spark broadcasts them by size."""
    first = items.where("schema_id is not null").groupBy(F.col("id").alias("detected_class")).agg(F.min_by("schema_id", "order").alias("schema_id"))
    return tables.join(first, "detected_class")


def allowed_meta(columns: DataFrame, predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions (column_id, class_id, class_value) of columns (column_id, detected_class) that their item (id, meta_ids) allows."""
    allowed = items.select(F.col("id").alias("detected_class"), F.explode("meta_ids").alias("class_id"))
    return predictions.join(columns, "column_id").join(allowed, ["detected_class", "class_id"], "left_semi")


def can_merge(a: Column, b: Column) -> Column:
    """Whether two columns' pairs are of one length and never both have a value."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x["value"].isNull() | y["value"].isNull()), lambda free: free)


def merged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x["line_item"].alias("line_item"), F.coalesce(x["value"], y["value"]).alias("value")))


def number_overlap(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Pairs of tables (id_a, id_b) with how many distinct number keys both have; inputs: id, keys. Without b the pairs of a's own tables, each once with id_a < id_b.

    The result itself is as large as the pairs that share a number. Tables with equal sets of keys are compared once, as numbers, and named again at the
    end; a number that very many of these have is split by Spark where it is skewed.
    """

    def sides(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The distinct sets' keys, and the tables that have a set."""
        named = d.select("id", F.array_sort(F.array_distinct("keys")).alias("_k")).where(F.size("_k") > 0).select("id", "_k", F.sha2(F.array_join(F.transform("_k", lambda k: k.cast("string")), ","), 256).alias("_s"))
        # Written, as numbers given by place must not change.
        once = cut(named.dropDuplicates(["_s"]).select("_s", "_k", F.monotonically_increasing_id().alias(name)))
        return once.select(name, F.explode("_k").alias("k")), named.select("id", "_s").join(once.select("_s", name), "_s").select("id", name)

    keys, tables = sides(a, "_sa")
    alone = b is None
    keys2, tables2 = (d.withColumnRenamed("_sa", "_sb") for d in (keys, tables)) if alone else sides(b, "_sb")
    met = keys.join(keys2, "k")
    common = (met.where("_sa <= _sb") if alone else met).groupBy("_sa", "_sb").agg(F.count("*").alias("common"))
    out = common.join(tables.withColumnRenamed("id", "id_a"), "_sa").join(tables2.withColumnRenamed("id", "id_b"), "_sb")
    if alone:
        out = out.where("_sa < _sb and id_a <> id_b or id_a < id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "common")
    return out.select("id_a", "id_b", "common")


def offsets(tables: DataFrame) -> DataFrame:
    """tables (group_id, table_order, n_items) with ``start``: the items of the tables before, where missing items are put in."""
    w = Window.partitionBy("group_id").orderBy("table_order").rowsBetween(Window.unboundedPreceding, -1)
    return tables.withColumn("start", F.coalesce(F.sum("n_items").over(w), F.lit(0)))
