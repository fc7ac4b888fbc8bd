"""Merkle fixity audit of WARC replicas.

Pages are laid out as records of WARC files, RECORDS_PER_FILE consecutive ids a file. Each record's bytes are hashed
where they lie; a leaf holds the record's range of offsets in its file and its digest, in the order of offsets. Replicas are
compared by their files' roots; only files that differ are looked into, and in them only the branches that differ. The
records in these are paired by page and digest, then by page alone, wherever they lie: a record that is lost or put in
moves those behind it and changes none. Bytes are never shuffled, only a digest and a length a record.

Defined cases: a null url or html counts as empty; pages with one id are records of their own, in the order of their
digests; pages without an id make a file of their own; a record that only one replica has is missing or extra; one that
only lies elsewhere has moved; of records with one id that have no equal in the other replica, those first in the order of digests
are changed ones of each other; empty tables have no files; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.merkle import descend, levels

RECORDS_PER_FILE = 1024


def record(id_: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows _file, _page, _start, _end, _digest: where each record lies and what it holds."""
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.floor(F.col("page_id") / per_file).cast("bigint").alias("_file"), F.col("page_id").alias("_page"), F.octet_length(rec).cast("bigint").alias("_size"), F.sha2(rec, 256).alias("_digest"))
    order = Window.partitionBy("_file").orderBy("_page", "_digest").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_end", F.sum("_size").over(order)).select("_file", "_page", (F.col("_end") - F.col("_size")).alias("_start"), "_end", "_digest")


def trees(recs: DataFrame) -> DataFrame:
    """One row a file: _file, _records in the order of offsets, _levels of the tree over them."""
    lists = recs.groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_start", "_end", "_page", "_digest"))).alias("_records"))
    leaf = F.transform("_records", lambda r: F.sha2(F.concat(F.lit("r"), r["_start"].cast("string"), F.lit("-"), r["_end"].cast("string"), F.lit(":"), r["_digest"]), 256))
    return lists.withColumn("_levels", levels(leaf))


def _paired(recs: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The n-th record of each key in either replica: the key, _x and _y, of which one may be null."""
    n = F.row_number().over(Window.partitionBy(*by, "_side").orderBy(*order))
    held = F.struct("_start", "_end", "_digest")
    one = lambda side: F.first(F.when(F.col("_side") == side, held), ignorenulls=True)
    return recs.withColumn("_n", n).groupBy(*by, "_n").agg(one(0).alias("_x"), one(1).alias("_y"))


def audit(first: DataFrame, second: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """The records in which two replicas of pages differ: warc_file, page_id, start_offset and end_offset (in the first replica where it has the record), state."""
    a, b = (trees(records(x, per_file)).select(F.col("_file").alias(f"_f{n}"), F.col("_records").alias(f"_r{n}"), F.col("_levels").alias(f"_l{n}")) for x, n in ((first, "a"), (second, "b")))
    both = a.join(b, F.col("_fa").eqNullSafe(F.col("_fb")), "full")
    none = F.array().cast("array<array<string>>")
    la, lb = F.coalesce("_la", none), F.coalesce("_lb", none)
    differ = both.where(~F.get(F.element_at("_la", -1), 0).eqNullSafe(F.get(F.element_at("_lb", -1), 0)))
    numbers = differ.select(F.coalesce("_fa", "_fb").alias("_f"), "_ra", "_rb", descend(la, lb).alias("_at"))

    def side(n: int, held: str) -> DataFrame:
        return numbers.select("_f", F.lit(n).alias("_side"), F.explode(F.transform("_at", lambda i: F.get(held, i))).alias("_r")).where("_r is not null")

    recs = side(0, "_ra").unionByName(side(1, "_rb")).select("_f", F.col("_r._page").alias("_page"), F.col("_r._digest").alias("_digest"), "_side", F.col("_r._start").alias("_start"), F.col("_r._end").alias("_end"))
    # Everything below is by file and page, so that records move once.
    recs = recs.repartition("_f", "_page")
    pairs = _paired(recs, ["_f", "_page", "_digest"], "_start")
    moved = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    alike = pairs.where(moved & ((F.col("_x._start") != F.col("_y._start")) | (F.col("_x._end") != F.col("_y._end")))).select("_f", "_page", "_x", F.lit("moved").alias("state"))
    rest = pairs.where(~moved).select("_f", "_page", F.when(F.col("_x").isNull(), 1).otherwise(0).alias("_side"), F.coalesce("_x", "_y").alias("_r")).select("_f", "_page", "_side", "_r.*")
    state = F.when(F.col("_x").isNull(), "extra").when(F.col("_y").isNull(), "missing").otherwise("changed")
    others = _paired(rest, ["_f", "_page"], "_digest", "_start").select("_f", "_page", F.coalesce("_x", "_y").alias("_x"), state.alias("state"))
    found = alike.unionByName(others)
    return found.select(F.col("_f").alias("warc_file"), F.col("_page").alias("page_id"), F.col("_x._start").alias("start_offset"), F.col("_x._end").alias("end_offset"), "state")
