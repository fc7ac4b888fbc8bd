"""Exact dedup by recipes of content-defined chunks.

Each text is cut where a rolling hash of its last 32 bytes has zero low bits, so equal texts get equal chunks. A text's
recipe is the ordered list of its chunks' identifiers. Whole texts never move: digests of 16 bytes are compared first,
and only the chunks of texts whose recipe occurs twice are gathered, each distinct chunk once per map task, to
verify that a digest stands for one content. A digest that stands for several gets one identifier per content.

Defined cases: a null text equals no other text; empty texts equal each other; of equal texts the row with the smallest
id stays (nulls last), and of several rows with that id and text one stays; other columns are ignored here and kept by
the stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map, cut, join_checked, keep_one, size_of, slices, text_of

#: A cut where these bits of the rolling hash are zero: 2 KB on average. A chunk of more than MAX_CHUNK is cut at its multiples.
CUT_BITS = 11
MAX_CHUNK = 1 << 16
_GEAR = np.random.default_rng(20_240_601).integers(0, 1 << 32, 256, dtype=np.uint32)


def digest128(chunk: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int = CUT_BITS, most: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, with the end of the data after them, and each row's first chunk. An empty row has none."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if len(h) > s else h[s:]
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[(at - offsets[np.minimum(row, len(offsets) - 2)] >= 32) & (at < offsets[-1])] if len(at) else at
    starts = np.unique(np.concatenate([at, offsets[:-1][np.diff(offsets) > 0]]))
    ends = np.append(starts, offsets[-1])[1:]
    long = np.flatnonzero(ends - starts > most)
    if len(long):
        starts = np.unique(np.concatenate([starts, *(np.arange(starts[i], ends[i], most) for i in long)]))
    return np.append(starts, offsets[-1]), np.searchsorted(starts, offsets)


def _recipes(digest: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column("_t"))
            hashes, counts = [], [np.zeros(1, np.int64)]
            for a, b in slices(offsets):
                d = data[offsets[a] : offsets[b]]
                edges, first = cut_points(d, offsets[a : b + 1] - offsets[a])
                view, e = memoryview(d), edges.tolist()
                hashes += [digest(view[x:y]) for x, y in zip(e, e[1:])]
                counts.append(np.diff(first))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(hashes, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_k"), pa.array(np.diff(offsets)), lists], ["_id", "_k", "_bytes", "_chunks"])

    return run


def _contents(digest: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column("_t"))
            for a, b in slices(offsets, 8 << 20):
                d = data[offsets[a] : offsets[b]]
                view, e = memoryview(d), cut_points(d, offsets[a : b + 1] - offsets[a])[0].tolist()
                seen = {(digest(view[x:y]), bytes(view[x:y])) for x, y in zip(e, e[1:])}
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.binary()), pa.array([y for _, y in seen], pa.binary())], ["_chunk", "_content"])

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable = digest128) -> DataFrame:
    """Rows _id, _k, _keep, _rows, _keep_id: the members of each group of equal texts, as keep_one() takes them."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_k"), F.col(text_col).alias("_t"))
    id_type = texts.schema["_id"].dataType.simpleString()
    recipes = cut(arrow_map(texts, _recipes(digest), f"_id {id_type}, _k bigint, _bytes bigint, _chunks array<binary>"))
    shared = ["_bytes", "_chunks"]
    groups = recipes.groupBy("_id", "_k", *shared).agg(F.count("*").alias("_rows"))
    # A text can only have a copy if its recipe, taken by digests, occurs twice.
    recipe = F.xxhash64("_bytes", "_chunks").alias("_r")
    twice = recipes.select(recipe).groupBy("_r").count().where("count > 1").select("_r")
    groups = groups.withColumn("_r", recipe).join(twice, "_r", "left_semi").drop("_r")
    groups = cut(groups)
    n = size_of(groups.select("_id", "_k"))
    wanted = groups.select(F.col("_id").alias("_gid"), F.col("_k").alias("_gk"))
    moved = join_checked(texts, wanted, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_k") == F.col("_gk")), "left_semi", n)
    contents = arrow_map(moved.select("_t"), _contents(digest), "_chunk binary, _content binary").distinct()
    ambiguous = cut(contents.groupBy("_chunk").count().where("count > 1").select("_chunk"))
    if not ambiguous.isEmpty():
        groups = _verified(groups, texts, contents.join(ambiguous, "_chunk", "left_semi"), digest, n)
    w = Window.partitionBy(*shared)
    groups = groups.withColumn("_first", F.min(F.struct(F.col("_id").isNull(), "_id", "_k")).over(w)).withColumn("_all", F.sum("_rows").over(w)).where("_all > 1")
    return groups.select("_id", "_k", (F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_k") == F.col("_first._k"))).alias("_keep"), "_rows", F.col("_first._id").alias("_keep_id"))


def _verified(groups: DataFrame, texts: DataFrame, ambiguous: DataFrame, digest: Callable, n: int) -> DataFrame:
    """groups with the chunks whose digest has several contents renamed by the content's rank among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column("_t"))
            for i in range(batch.num_rows):
                d = data[offsets[i] : offsets[i + 1]]
                e = cut_points(d, np.array([0, len(d)]))[0].tolist()
                parts = [bytes(d[x:y]) for x, y in zip(e, e[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, 1).take(pa.array([0] * len(parts), pa.int64())), batch.column("_k").slice(i, 1).take(pa.array([0] * len(parts), pa.int64())), pa.array(range(len(parts)), pa.int32()), pa.array([digest(memoryview(p)) for p in parts], pa.binary()), pa.array(parts, pa.binary())], ["_id", "_k", "_at", "_chunk", "_content"])

    id_type = texts.schema["_id"].dataType.simpleString()
    keys = groups.select(F.col("_id").alias("_gid"), F.col("_k").alias("_gk"))
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_k") == F.col("_gk"))
    placed = arrow_map(join_checked(texts.dropDuplicates(["_id", "_k"]), keys, same, "left_semi", n), run, f"_id {id_type}, _k bigint, _at int, _chunk binary, _content binary")
    ranked = ambiguous.withColumn("_rank", F.row_number().over(Window.partitionBy("_chunk").orderBy("_content")))
    placed = placed.join(ranked, ["_chunk", "_content"], "left").select("_id", "_k", "_at", F.concat("_chunk", F.coalesce(F.col("_rank"), F.lit(0)).cast("string").cast("binary")).alias("_chunk"))
    lists = placed.groupBy(F.col("_id").alias("_gid"), F.col("_k").alias("_gk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_chunk"))), lambda x: x["_chunk"]).alias("_verified"))
    out = groups.join(lists, same, "left")
    return out.select("_id", "_k", "_bytes", F.coalesce("_verified", "_chunks").alias("_chunks"), "_rows")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document whose text another one with a smaller id has too: doc_id, keep_doc_id."""
    return copies(docs, id_col, text_col).where("not _keep").select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_doc_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; all columns as they came."""
    return keep_one(docs, copies(docs, id_col, text_col), id_col, text_col)
