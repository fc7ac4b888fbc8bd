"""Tables from delimited text, pre-extracted pages, and dataset files."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.tables import rows_from_items
from docloom.schemas import NOT_CONFIGURED, ROWS

#: Bytes of files after which their tables go on.
TOGETHER = 1 << 20


def delimiter(content: Column) -> Column:
    """Of comma and semicolon the more frequent (the latter for equals): struct of delim, share, total."""
    comma, semi = (F.length(content) - F.length(F.replace(content, F.lit(c), F.lit(""))) for c in (",", ";"))
    total = comma + semi
    return F.struct(F.when(comma > semi, ",").otherwise(";").alias("delim"), (F.greatest(comma, semi) / F.greatest(total, F.lit(1))).alias("share"), total.alias("total"))


def parse(data: bytes, max_rows: int | None = None) -> list[list[str]]:
    """Rows of a file's bytes, padded to one width: UTF-8 or else Windows-1254, the delimiter as sniffed or as counted."""
    try:
        text = data.decode("utf8")
    except UnicodeDecodeError:
        text = data.decode("windows-1254", "replace")
    comma, semi = text.count(","), text.count(";")
    by_count, total = "," if comma > semi else ";", comma + semi
    try:
        dialect: type[csv.Dialect] | None = csv.Sniffer().sniff(text, delimiters=",;|")
    except csv.Error:
        dialect = None
    delim = by_count if dialect is None or (total > 100 and max(comma, semi) / total > 0.6) else dialect.delimiter
    lines = text.splitlines(keepends=True)
    rows = list(csv.reader(lines, delimiter=delim) if dialect is None else csv.reader(lines, dialect, delimiter=delim))
    rows = rows if max_rows is None else rows[:max_rows]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def read_csv_tables(files: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Each file (source_identifier, content) as one table element with plain text cells. A file is parsed as a whole, as its rows have one width."""

    def ends(sizes: Iterator[int]) -> pa.Array:
        return pa.array(list(accumulate(sizes, initial=0)), pa.int32())

    def column(tables: list[list[list[str]] | None]) -> pa.Array:
        rows = [r for t in tables if t for r in t]
        vals = pa.array([v for r in rows for v in r], pa.string())
        cells = pa.StructArray.from_arrays([vals, pa.array(np.ones(len(vals), np.int32))], ["val", "colspan"])
        structs = pa.StructArray.from_arrays([pa.array(["body"] * len(rows), pa.string()), pa.ListArray.from_arrays(ends(map(len, rows)), cells)], ["row_type", "values"])
        return pa.ListArray.from_arrays(ends(len(t or ()) for t in tables), structs, mask=pa.array([t is None for t in tables], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small files go on together, large ones by themselves.
            tables, size, first = [], 0, 0
            for i, content in enumerate(batch.column("content")):
                data = content.as_py()
                tables.append(None if data is None else parse(data, max_rows))
                size += len(data or b"")
                if size > TOGETHER or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("source_identifier").slice(first, len(tables)), column(tables)], ["source_identifier", "rows"])
                    tables, size, first = [], 0, i + 1

    parsed = files.select("source_identifier", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"source_identifier {files.schema['source_identifier'].dataType.simpleString()}, rows {ROWS}")
    return parsed.select("source_identifier", F.lit("tabular").alias("source_type"), F.lit(0).alias("element_index"), F.lit("table").alias("el_type"), F.lit(None).cast("string").alias("text"), "rows")


def from_pages(paragraphs: DataFrame) -> DataFrame:
    """Elements of pages that another program has extracted: source_identifier, seq, kind (table, figure, other), text, items (caption, values), coordinates, page_idx, page_size."""
    kind = F.when(F.col("kind").isin("table", "figure"), F.col("kind")).otherwise("text")
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("source_identifier").orderBy("seq")) - 1
    return paragraphs.select("source_identifier", F.lit("pdf").alias("source_type"), index.alias("element_index"), kind.alias("el_type"), F.when(kind == "text", F.col("text")).alias("text"), "coordinates", F.struct("page_idx", "page_size").alias("other_info"), F.when(kind == "table", rows_from_items(F.col("items"))).alias("rows"))


FEATURE, ANSWER, KEYS = "FEATURE_", "ANSWER_", ("source_identifier", "template_id", "element_identifier")


def consistent(*frames: DataFrame) -> DataFrame:
    """Frames of dataset rows as one, with columns in order and what is missing marked as such; NUL becomes a blank."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    named = [*KEYS, *sorted(c for c in out.columns if c.startswith(ANSWER)), *sorted(c for c in out.columns if c.startswith(FEATURE))]
    return out.select(*(F.replace(F.coalesce(F.col(c).cast("string"), F.lit(NOT_CONFIGURED)), F.lit("\u0000"), F.lit(" ")).alias(c) for c in named))


def write_dataset(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Dataset rows as CSV with a header, quoted so that texts may have lines and quotes."""
    consistent(rows).write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)


def read_dataset(spark: SparkSession, *paths: str, indices: Iterable[int] | None = None, skip: Column | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Dataset rows with row_index (in file order); of them those with the given numbers, without skipped ones, preprocessed.

    A file whose texts have lines is read by one task in its order; only the files' sizes are brought together.
    """
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths)).withColumn("_f", F.col("_metadata.file_path")).withColumn("_m", F.monotonically_increasing_id())
    files = out.groupBy("_f").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).collect()
    before, starts = 0, []
    for f in sorted(files, key=lambda r: r["_f"]):
        starts += [F.lit(f["_f"]), F.lit(before - f["_first"])]
        before += f["_n"]
    start = F.create_map(*starts)[F.col("_f")] if starts else F.lit(0)
    out = out.withColumn("row_index", (F.col("_m") + start).cast("int")).drop("_f", "_m")
    if indices is not None:
        wanted = spark.createDataFrame([(int(i),) for i in sorted(set(indices))], "row_index int")
        out = out.join(wanted, "row_index", "left_semi")
    if skip is not None:
        out = out.where(~skip)
    return preprocess(out) if preprocess else out


def batches(rows: DataFrame, size: int, columns: list[str] | None = None) -> Iterator[list]:
    """Rows in lists of ``size`` (the last may be shorter), partition after partition, so that the driver holds one partition at a time."""
    held: list = []
    for r in (rows if columns is None else rows.select(*columns)).toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def stream_column(rows: DataFrame, name: str) -> Iterator:
    """The values of one column, as they come."""
    return (r[0] for r in rows.select(name).toLocalIterator())


def save_model(model, folder: str, settings: DataFrame) -> None:
    """A model of Spark's own library, and beside it the settings of the columns that it was fitted on (as scaling() gives them)."""
    model.write().overwrite().save(f"{folder}/model")
    settings.write.mode("overwrite").parquet(f"{folder}/columns")


def load_model(spark: SparkSession, folder: str, kind: type | None = None) -> tuple:
    """A saved model (a pipeline unless another kind is named) and its column settings."""
    from pyspark.ml import PipelineModel

    return (kind or PipelineModel).load(f"{folder}/model"), spark.read.parquet(f"{folder}/columns")


def columns_of(frame: DataFrame) -> dict[str, list[str]]:
    """Names of features and answers, without their prefixes."""
    return {k: sorted(c[len(p) :] for c in frame.columns if c.startswith(p)) for k, p in (("features", FEATURE), ("answers", ANSWER))}


def undersample(rows: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """About as many rows of each label as the rarest has."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    least = min(counts.values(), default=0)
    return rows.sampleBy(label, {k: least / n for k, n in counts.items()}, seed)


def scaling(frame: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """One row: minimum and maximum of numeric columns and the distinct values of others in the order of their names."""
    aggs = [f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max))]
    return frame.agg(*aggs, *(F.array_sort(F.collect_set(c)).alias(f"values_{c}") for c in categories))


def min_max(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 by their extremes, 0 where these are equal; the extremes, one row, are taken first."""
    ends = frame.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max)))).first()
    low, high = ({c: F.lit(ends[f"{n}_{c}"]) for c in columns} for n in "ab")
    return frame.select(*(F.coalesce(F.try_divide(F.col(c) - low[c], high[c] - low[c]), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in frame.columns))
