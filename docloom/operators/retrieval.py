"""Retrieval: the chunks nearest to a question, by cosine similarity of vectors, and budgets of images and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.checkpoints import numbered
from docloom.schemas import TOP_K

Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 where one is null or all zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def query_text(title: str, keywords: str | None) -> str:
    return title if keywords is None else f"{title}; {keywords}"


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A plain stand-in for an encoder: counts of words by hash bucket."""
    w = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(w, lambda x: x == i)).cast("float"))


#: Bytes of query vectors that are sent to all tasks at a time, and of similarities that a task holds.
QUERY_BYTES, BLOCK_BYTES = 32 << 20, 64 << 20


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1 as rows; null and zero ones, and those of another width, are zeros."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    good = np.flatnonzero(sizes == width)
    if len(good) and width:
        flat = vectors.take(pa.array(good)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        out[good] = flat.reshape(-1, width)
    norm = np.sqrt((out * out).sum(axis=1))
    out[norm > 0] /= norm[norm > 0, None]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores (to 9 digits), the smaller id of equal ones, and their ids. ids: (columns), or one row each."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(np.broadcast_to(ids, scores.shape), order, 1)


def _block_nearest(sent, k: int, kind: pa.DataType):
    """Runs over vectors (vec_id, vector) with the k nearest so far for each query of a block, and gives them at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        step = max(1, BLOCK_BYTES // (8 * max(1, len(queries))))
        scores, ids = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), object)
        for batch in batches:
            own = np.array(batch.column("vec_id").to_pylist(), object) if not pa.types.is_integer(kind) else batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("vector"), queries.shape[1])
            for a in range(0, len(own), step):
                s = queries @ vectors[a : a + step].T
                mine = own[a : a + step]
                if s.shape[1] > k:
                    # Only what is as good as the k-th best comes into question; of equal ones the first k by id.
                    mine = mine[o := np.argsort(mine, kind="stable")]
                    s = s[:, o]
                    r = np.round(s, 9)
                    kth = np.partition(r, -k, axis=1)[:, -k, None]
                    more = r > kth
                    equal = r == kth
                    take = more | (equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True)))
                    at = np.nonzero(take)[1].reshape(len(s), k)
                    s, mine = np.take_along_axis(s, at, 1), mine[at]
                else:
                    mine = np.broadcast_to(mine, s.shape)
                ids = ids.astype(mine.dtype) if not ids.shape[1] else ids
                scores, ids = _best(np.concatenate([scores, s], axis=1), np.concatenate([ids, mine], axis=1), k)
        n = scores.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(queries)), n))), pa.array(ids.ravel().tolist(), kind), pa.array(scores.ravel())], ["query_id", "vec_id", "similarity"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """For each query (query_id, query_vector) the k nearest rows (vec_id, vector) of all: query_id, vec_id, similarity, rank.

    Exact, as products of matrices: queries are sent in blocks of QUERY_BYTES, for each of which every task passes its vectors once and
    keeps k rows a query, so that only these are shuffled, whatever the number of vectors. Ties (to 9 digits) go to the smaller id. A null, zero or shorter vector has similarity 0.
    """
    spark = vectors.sparkSession
    row = queries.select(F.size("query_vector").alias("w")).agg(F.max("w"), F.count("*")).first()
    width, n = max(row[0] or 0, 0), row[1]
    blocks = max(1, -(-n * max(1, width) * 8 // QUERY_BYTES))
    cols = vectors.select("vec_id", "vector")
    id_type, q_type = cols.schema["vec_id"].dataType, queries.schema["query_id"].dataType
    kind = to_arrow_type(id_type)
    parts = []
    for b in range(blocks):
        mine = queries.select("query_id", "query_vector")
        block = (mine.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else mine).toArrow()
        names = block.column("query_id").combine_chunks()
        sent = spark.sparkContext.broadcast((names, _matrix(block.column("query_vector").combine_chunks(), width)))
        parts.append(cols.mapInArrow(_block_nearest(sent, k, kind), f"query_id {q_type.simpleString()}, vec_id {id_type.simpleString()}, similarity double"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def everything(elements: DataFrame, _: DataFrame | None = None) -> DataFrame:
    """No retrieval: all elements as they are."""
    return elements


def from_start(elements: DataFrame, tables_only: bool) -> DataFrame:
    """All elements in order; for detection tables alone."""
    return elements.where(F.col("el_type") == "table") if tables_only else elements


#: Queries that nearest_elements() compares with each chunk: they come from a template's items.
MOST_QUERIES = 1000


def nearest_elements(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, encoder: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Of each document and query (query_id, query_text) the elements of the k nearest chunks in the order of similarity: source_identifier, query_id, element_index, rank.

    Queries are a template's items: they become literals beside each chunk. More than MOST_QUERIES are refused.
    """
    asked = queries.select("query_id", "query_text").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    named = F.array(*(F.struct(F.lit(q.query_id).alias("query_id"), encoder(F.lit(q.query_text)).alias("q")) for q in asked)) if asked else F.array().cast("array<struct<query_id:string,q:array<float>>>")
    v = chunks.select("source_identifier", F.col("chunk_id").alias("vec_id"), "elements", encoder(F.col("text")).alias("vector"), F.explode(named).alias("_q"))
    pairs = v.select("source_identifier", "_q.query_id", "vec_id", "elements", cosine(F.col("vector"), F.col("_q.q")).alias("_s"))
    w = Window.partitionBy("source_identifier", "query_id").orderBy(F.desc(F.round("_s", 9)), F.desc("vec_id"))
    top = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("source_identifier", "query_id", "_r", F.posexplode("elements").alias("_p", "element_index"))
    order = Window.partitionBy("source_identifier", "query_id").orderBy("_r", "_p")
    return top.select("source_identifier", "query_id", "element_index", F.row_number().over(order).alias("rank"))


def by_relevance(identifiers: DataFrame) -> DataFrame:
    """Documents in a stable order: by their identifiers."""
    return numbered(identifiers.select("source_identifier").distinct(), ["source_identifier"], "doc_order")


def image_pages(elements: DataFrame, most: int) -> DataFrame:
    """The distinct pages of each document in the order of their first element, at most ``most``: source_identifier, page_idx, page_order."""
    first = elements.where("page_idx is not null").groupBy("source_identifier", "page_idx").agg(F.min("element_index").alias("_first"))
    w = Window.partitionBy("source_identifier").orderBy("_first", "page_idx")
    return first.withColumn("page_order", F.row_number().over(w)).where(F.col("page_order") <= most).drop("_first")


def split_images(images: DataFrame, most: int | None) -> DataFrame:
    """images (request, doc_order, image_order) that a request may show: all if they fit, else an equal share a document, the last one filling up what is left."""
    if most is None:
        return images
    r = Window.partitionBy("request")
    d = images.withColumn("_all", F.count("*").over(r)).withColumn("_last", F.max("doc_order").over(r)).withColumn("_docs", F.size(F.collect_set("doc_order").over(r))).withColumn("_n", F.count("*").over(Window.partitionBy("request", "doc_order")))
    share = F.floor(F.lit(most) / F.col("_docs"))
    used = F.sum(F.when((F.col("image_order") == 1) & (F.col("doc_order") < F.col("_last")), F.least(F.col("_n"), share))).over(r)
    room = F.when((F.col("doc_order") == F.col("_last")) & (F.col("_n") > share), F.lit(most) - F.coalesce(used, F.lit(0))).otherwise(share)
    return d.withColumn("_room", room).where((F.col("_all") <= most) | (F.col("image_order") <= F.col("_room"))).select(*images.columns)


def split_tokens(docs: DataFrame, most: int) -> DataFrame:
    """docs (request, doc_order, tokens: array) with ``kept``: all tokens if a request's documents fit, else an equal share of the budget each."""
    r = Window.partitionBy("request")
    share = F.floor(F.lit(most) / F.count("*").over(r)).cast("int")
    fits = F.sum(F.size("tokens")).over(r) <= most
    return docs.withColumn("kept", F.when(fits, F.col("tokens")).otherwise(F.slice("tokens", F.lit(1), share)))
