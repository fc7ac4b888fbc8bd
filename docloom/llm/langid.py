"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled rows, about SAMPLE_PER_LANG whole texts a language (those
whose hash of id and text is below the share that gives so many), and makes one matrix of log probabilities, (buckets, languages), which is
broadcast; its size is fixed by the parameters. Scoring is sparse: for each batch the n-grams are hashed to
row numbers of the matrix, as the column indices of a CSR matrix whose row pointers are the texts, and the matrix rows
are summed text by text in numpy. Texts are taken whole, in lower case.

A text is rejected ("und") if it has no letter (null, empty, only digits and signs), if the best language's posterior is under MIN_POSTERIOR, or
if its mean log probability per n-gram is too low for that language: under the mean that the matrix itself gives, less MARGIN and DEVIATIONS
standard errors, so that short texts have more room. This is what rejects other languages and gibberish, whose posterior is near 1, too; real
text that is as unlike the training rows as another language is goes with it. Repeated rows are scored each; ties go to the
language first in the alphabet; without labelled rows every text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import K1, K2, U64, arrow_map, reduce_rows, slices, text_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 1000
ALPHA = 0.5
MIN_POSTERIOR = 0.6
#: How far, in nats per n-gram, a text may lie under its language's mean, and how many standard errors of the mean besides.
MARGIN, DEVIATIONS = 1.1, 6.0


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, bucket numbers of all n-grams, text after text, and each text's first. An n-gram holds a letter and no line end.

    data: UTF-8 in lower case. Blanks, digits and signs count as one blank; runs of them give no n-gram of their own.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = lead[offsets]
    letter = ((chars >= 97) & (chars <= 122)) | (chars >= 0xAA)
    chars[~letter] = 32
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(chars))
    h = np.zeros(len(chars), np.uint64)
    out, owner = [], []
    any_letter = np.zeros(len(chars), bool)
    for n in range(1, max(ORDERS) + 1):
        part = chars[n - 1 :].astype(np.uint64)
        h = h[: len(chars) - n + 1] if len(chars) >= n else h[:0]
        h = (h ^ part) * K1
        h ^= h >> U64(31)
        any_letter = any_letter[: len(h)] | letter[n - 1 :][: len(h)]
        if n in ORDERS:
            ok = np.flatnonzero((left[: len(h)] >= n) & any_letter)
            out.append(((h[ok] * K2) >> U64(64 - buckets.bit_length() + 1)).astype(np.int32))
            owner.append(np.searchsorted(ok, first))
    return out, owner


def _counts(langs: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), buckets), np.int64)
        for batch in batches:
            data, offsets = text_of(pc.utf8_lower(batch.column("_t").fill_null("")))
            lang = np.array([langs.index(x) for x in batch.column("_l").to_pylist()], np.int64)
            for a, b in slices(offsets):
                feats, firsts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                for f, first in zip(feats, firsts):
                    np.add.at(total, (np.repeat(lang[a:b], np.diff(first)), f), 1)
        li, bi = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(li.astype(np.int32)), pa.array(bi.astype(np.int32)), pa.array(total[li, bi])], ["_l", "_b", "_n"])

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANG, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix of log probabilities, (buckets, languages). Priors are equal."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    have = {r["_l"]: r["count"] for r in rows.groupBy(F.col(lang_col).alias("_l")).count().collect()}
    langs = sorted(have)
    if not langs:
        return [], np.zeros((buckets, 0), np.float32)
    wanted = F.lit(False)
    for lang in langs:
        share = sample / have[lang]
        bound = (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * (1 << 64))
        wanted = wanted | ((F.col("_l") == lang) & (F.col("_key") <= F.lit(bound)))
    chosen = rows.select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"), key.alias("_key")).where(wanted).drop("_key")
    counts = arrow_map(chosen, _counts(langs, buckets), "_l int, _b int, _n bigint").groupBy("_l", "_b").agg(F.sum("_n").alias("_n"))
    table = counts.toArrow()
    m = np.full((buckets, len(langs)), ALPHA)
    m[table.column("_b").to_numpy(), table.column("_l").to_numpy()] += table.column("_n").to_numpy()
    return langs, np.log(m / m.sum(axis=0)).astype(np.float32)


def score(data: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities, (texts, languages), and the number of n-grams of each text."""
    sums = np.zeros((len(offsets) - 1, matrix.shape[1]), np.float64)
    count = np.zeros(len(offsets) - 1, np.int64)
    bucket_bits = matrix.shape[0]
    feats, firsts = features(data, offsets, bucket_bits)
    for f, first in zip(feats, firsts):
        for j in range(matrix.shape[1]):
            sums[:, j] += reduce_rows(np.add, matrix[:, j][f].astype(np.float64), first, 0.0)
        count += np.diff(first)
    return sums, count


def expected(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each language: mean and standard deviation of the log probability of an n-gram drawn from it."""
    logs = matrix.astype(np.float64)
    p = np.exp(logs)
    mean = (p * logs).sum(axis=0)
    return mean, np.sqrt(np.maximum((p * logs**2).sum(axis=0) - mean**2, 0))


def _classify(spread, min_posterior: float, text_col: str):
    def text(batch: pa.RecordBatch) -> pa.Array:
        whole = batch.column("_d").field(text_col) if "_d" in batch.schema.names else batch.column("_t")
        return pc.utf8_lower(whole.cast(pa.string()).fill_null(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, columns, mean, deviation = spread.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            data, offsets = text_of(text(batch))
            best, prob = [], []
            for a, b in slices(offsets):
                s, n = score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], columns)
                if not len(langs):
                    best.append(np.zeros(b - a, np.int64))
                    prob.append(np.zeros(b - a))
                    continue
                top = s.argmax(axis=1)
                p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                p[n == 0] = 0
                m = np.maximum(n, 1)
                typical = s.max(axis=1) / m >= mean[top] - MARGIN - DEVIATIONS * deviation[top] / np.sqrt(m)
                best.append(np.where((p >= min_posterior) & typical & (n > 0), top, len(langs)))
                prob.append(p)
            best, prob = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, prob))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_t"), pa.array(names[best], pa.string()), pa.array(prob, pa.float64())], [*(c for c in batch.schema.names if c != "_t"), "_lang", "_posterior"])

    return run


def classify(rows: DataFrame, model: tuple[list[str], np.ndarray], min_posterior: float = MIN_POSTERIOR, text_col: str = "text") -> DataFrame:
    """rows with _lang and _posterior. The text is a column _t, which goes, or the field text_col of a column _d, which stays."""
    spread = rows.sparkSession.sparkContext.broadcast((model[0], np.asfortranarray(model[1]), *expected(model[1])))
    schema = StructType([f for f in rows.schema if f.name != "_t"]).add("_lang", "string").add("_posterior", "double")
    return arrow_map(rows, _classify(spread, min_posterior, text_col), schema)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, predicted, posterior, accepted."""
    model = model or train(docs, id_col, text_col)
    out = classify(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), model)
    return out.select(F.col("_id").alias("doc_id"), F.col("_lang").alias("predicted"), F.col("_posterior").alias("posterior"), (F.col("_lang") != "und").alias("accepted"))


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known; all columns as they came."""
    model = model or train(docs, id_col, text_col)
    out = classify(docs.select(F.struct("*").alias("_d")), model, text_col=text_col)
    return out.where("_lang <> 'und'").select("_d.*")
