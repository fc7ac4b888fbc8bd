"""Documents from files and texts: types, identifiers, JSON of the normalized form, loaders and catalogs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import identifier
from docloom.schemas import DOCUMENT

#: A converter takes binaryFile rows with source_identifier and gives elements.
Converter = Callable[[DataFrame], DataFrame]
CONVERTERS: dict[str, Converter] = {}


def register_converter(source_type: str, converter: Converter) -> None:
    """Makes files of a type loadable; HTML is there from the start, PDF needs a backend."""
    CONVERTERS[source_type] = converter


#: The endings of each type's files; any other is "other".
EXTENSIONS = {"pdf": ("pdf", "png", "jpg", "jpeg"), "html": ("html", "xml"), "tabular": ("xlsx", "xls", "csv")}


def document_type(path: Column) -> Column:
    """pdf, html, tabular or other, by the extension whatever its case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    kind = F.when(F.lit(False), F.lit("other"))
    for name, endings in EXTENSIONS.items():
        kind = kind.when(ext.isin(*endings), name)
    return kind.otherwise("other")


def _glob(endings: tuple[str, ...]) -> str:
    """A pattern of file names with these endings in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in endings) + "}"


def choose_converter(source_type: str) -> Converter:
    if source_type not in CONVERTERS:
        raise ValueError(f"no converter for documents of type {source_type!r}")
    return CONVERTERS[source_type]


def from_text(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Each text as a document of one element."""
    return texts.select(identifier(F.col(text_col)).alias("source_identifier"), F.lit("text").alias("source_type"), F.lit(0).alias("element_index"), F.lit("text").alias("el_type"), F.col(text_col).alias("text"))


def read_files(spark: SparkSession, *paths: str, names: str | None = None) -> DataFrame:
    """Files (those with fitting names) with their type, identifier (hash of the bytes), path and content."""
    reader = spark.read.format("binaryFile")
    files = (reader if names is None else reader.option("pathGlobFilter", names)).load(list(paths))
    return files.select(document_type(F.col("path")).alias("source_type"), identifier(F.col("content")).alias("source_identifier"), F.col("path").alias("file_path"), "content")


def load_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Elements of files, each converted as its type says. Types without a converter are refused before any file's bytes are read; each file's are read once."""
    kinds = spark.read.format("binaryFile").load(list(paths)).select(document_type(F.col("path")).alias("t")).distinct()
    parts = []
    for t in sorted(r["t"] for r in kinds.collect()):
        convert = choose_converter(t)
        files = read_files(spark, *paths, names=_glob(EXTENSIONS[t])) if t in EXTENSIONS else read_files(spark, *paths).where(F.col("source_type") == t)
        parts.append(convert(files))
    if not parts:
        raise FileNotFoundError(f"no files in {', '.join(paths)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def from_loader(spark: SparkSession, pages: Iterable, source_type: str, source_identifier: str) -> DataFrame:
    """Pages of a loader (objects with page_content and metadata, or pairs of them) as text elements; metadata stay as JSON."""
    import json

    rows = []
    for i, page in enumerate(pages):
        text, meta = (page.page_content, page.metadata) if hasattr(page, "page_content") else page
        rows.append((source_identifier, source_type, i, "text", text, json.dumps(meta, default=str)))
    return spark.createDataFrame(rows, "source_identifier string, source_type string, element_index int, el_type string, text string, other_info string")


def read_json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Elements of documents in the normalized JSON form, one document a file; any unknown type of element is a table."""
    files = spark.read.text(list(paths), wholetext=True)
    return explode_documents(files.select(F.from_json("value", DOCUMENT).alias("d")).select("d.*"))


def explode_documents(docs: DataFrame) -> DataFrame:
    """Elements of documents that hold them as an array."""
    e = docs.select("source_type", "source_identifier", F.posexplode("elements").alias("_i", "_e"))
    kind = F.when(F.col("_e.el_type").isin("text", "figure"), F.col("_e.el_type")).otherwise("table")
    return e.select("source_identifier", "source_type", F.coalesce("_e.source.element_index", "_i").alias("element_index"), kind.alias("el_type"), F.col("_e.text").alias("text"), F.col("_e.source.xpath").alias("xpath"), F.col("_e.source.coordinates").alias("coordinates"), F.col("_e.source.other_info").alias("other_info"), F.col("_e.rows").alias("rows"))


def to_json_documents(elements: DataFrame) -> DataFrame:
    """One row a document: source_identifier and ``json`` in the normalized form."""
    have = set(elements.columns)
    col = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    from docloom.schemas import COORDINATES, OTHER_INFO, ROWS

    source = F.struct(F.col("source_type").alias("source_type"), col("coordinates", COORDINATES).alias("coordinates"), col("xpath", "string").alias("xpath"), F.col("element_index").alias("element_index"), col("other_info", OTHER_INFO).alias("other_info"))
    one = F.struct("element_index", F.struct(F.col("el_type"), source.alias("source"), F.col("text"), col("rows", ROWS).alias("rows")).alias("e"))
    docs = elements.groupBy("source_identifier", "source_type").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    return docs.select("source_identifier", F.to_json(F.struct("source_type", "source_identifier", F.transform("_l", lambda x: x["e"]).alias("elements"))).alias("json"))


class Catalog:
    """Documents, templates and answers in folders of Parquet, in place of a remote service."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def save(self, name: str, frame: DataFrame, mode: str = "overwrite") -> None:
        frame.write.mode(mode).parquet(f"{self.root}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def documents(self, identifiers: DataFrame) -> DataFrame:
        """The elements of the named documents; names without one are an error of missing()."""
        return self.load("elements").join(identifiers.select("source_identifier").distinct(), "source_identifier", "left_semi")

    def missing(self, identifiers: DataFrame) -> DataFrame:
        return identifiers.select("source_identifier").distinct().join(self.load("elements").select("source_identifier"), "source_identifier", "left_anti")

    def outputs(self, template_id: str) -> DataFrame:
        """The answers of a template that have a text."""
        return self.load("outputs").where((F.col("template_id") == template_id) & F.col("text").isNotNull())
