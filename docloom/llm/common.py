"""What the corpus operators share: checkpoints, size-checked joins, words of Arrow batches as numpy arrays."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of the side of a join that is still broadcast; beyond it the join shuffles both sides.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch to Python; a longer row comes alone.
BATCH_BYTES = 4 << 20
#: Bytes of text that the numpy kernels take at a time, so that their temporaries stay in the cache.
SLICE_BYTES = 1 << 20

U64 = np.uint64
K1, K2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
INF = U64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; in as many partitions as there are cores where it has fewer, as a single small file would keep one core busy."""
    df, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if name != "documents" or df.rdd.getNumPartitions() >= n else df.repartition(n)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where none is configured
    and the session is local.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(folder)
    # Files of frames that nothing refers to any more are deleted, unless the session says otherwise.
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def size_of(df: DataFrame) -> int:
    """Bytes of all rows, about; 0 if there are none. One pass over a frame that should have been cut."""

    def width(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(16)

    return int(df.agg(F.sum(sum((width(n, k) for n, k in df.dtypes), F.lit(8)).cast("bigint"))).first()[0] or 0)


def join_checked(big: DataFrame, small: DataFrame, on: Column | str | list[str], how: str, size: int) -> DataFrame:
    """Joins with ``small`` broadcast if it has no more than BROADCAST_BYTES (``size``, as size_of() gives it), else leaves the join to shuffle."""
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def arrow_map(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES, unless the session has a limit of its own: 10,000 long texts are more than a worker should hold."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(lean(run), schema)


def lean(run: Callable) -> Callable:
    """A mapInArrow function after whose task the worker gives freed memory back: workers live on and share their executor's limit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


def text_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; a null is an empty text."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"").cast(pa.large_binary())
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``limit`` bytes each; a longer row comes alone or ends its range."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


#: Bytes that aren't part of a word of letters and digits; all bytes beyond ASCII are.
SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs of bytes but those of ``between``) and each row's first word, one more at the end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    sp = between[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = sp[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = sp[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    np.logical_not(sp, out=sp)
    starts = np.flatnonzero(sp & before)
    ends = np.flatnonzero(sp & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of word_spans, over all their bytes."""
    n = ends - starts
    h = n.astype(np.uint64) * K2
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at, left, live = starts, n, None
    while len(at):
        chunk = padded[at[:, None] + np.arange(8)].view("<u8")[:, 0] & _LOW[np.minimum(left, 8)]
        part = (h if live is None else h[live]) ^ chunk
        part *= K1
        part ^= part >> U64(29)
        if live is None:
            h = part
        else:
            h[live] = part
        more = left > 8
        live = np.flatnonzero(more) if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; the last k-1 are short and mean nothing."""
    h = words.copy()
    for j in range(1, k):
        h *= K1
        h[: len(h) - j] += words[j:]
    return mix(h)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def room(first: np.ndarray) -> np.ndarray:
    """How many words its row has from each word on, itself included."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def reduce_rows(op: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """op over each row's values; rows without any get ``empty``."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    has = np.diff(first) > 0
    if has.any():
        out[has] = op.reduceat(values, first[:-1][has], axis=0)
    return out


def int_list(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat).cast(kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-D byte array as a binary column."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * w), pa.py_buffer(np.ascontiguousarray(rows))])


def keep_one(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that ``members`` marks as surplus.

    members: _id, _k (xxhash64 of the text), _keep, _rows (rows of docs that have this id and text). Of a kept
    member with several such rows one stays. Rows that aren't members stay as they are.
    """
    members = cut(members)
    n = size_of(members)
    if not n:
        return docs
    m = members.select(F.col("_id").alias("_mid"), F.col("_k").alias("_mk"), F.col("_keep").alias("_mkeep"), F.col("_rows").alias("_mrows"))
    keyed = docs.select(F.struct("*").alias("_d"), F.col(id_col).alias("_i"), F.xxhash64(F.col(text_col)).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("_mid")) & (F.col("_h") == F.col("_mk"))
    joined = join_checked(keyed, m, same, "left", n)
    out = joined.where(F.col("_mk").isNull() | (F.col("_mkeep") & (F.col("_mrows") == 1)))
    twice = m.where("_mkeep and _mrows > 1")
    k = size_of(twice)
    if k:
        again = join_checked(keyed, twice, same, "inner", k).dropDuplicates(["_i", "_h"])
        out = out.select("_d").unionByName(again.select("_d"))
    return out.select("_d.*")
