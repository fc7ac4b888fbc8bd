"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's share of the total token budget is its target weight; without given weights these are the (whole) square
roots of the sources' tokens. Complete epochs come first: every document is taken floor(budget / tokens) times. What is
left of the budget is filled with documents in the order of exponential keys -ln(u) / weight, where u is a hash of the id and the
weight follows from the quality label, as long as the sum of tokens stays within it.

No source is sorted as a whole: keys are mapped to SLOTS ranges in their order, by the mean of the distributions that the
weights give them, so that documents of no weight pile up in one; the ranges' tokens are summed up, and only the range in
which the budget ends is sorted. Texts are never shuffled, not by source either: what a source's rows are compared with is its
last key, which is broadcast as long as the sources are few enough.

Defined cases: rows of one id in a source are taken or left together; a null id hashes as the empty string; a null source
is a source of its own; a null or empty text has no tokens and comes with its source's epochs; a source without tokens has no budget and is
taken once; several labels of a document count as the best one; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, join_checked, size_of

#: Weight in the sampling by the quality label.
QUALITY = {1: 1.0, 0: 0.25, None: 0.5}
SLOTS = 4096
SEED = "mix-1"


def tokens(text: Column) -> Column:
    """Words: runs of anything but blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def uniform(id_: Column) -> Column:
    """A number in (0, 1), the same in any engine: 52 bits of MD5."""
    hex_ = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hex_, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _best(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_lid")).agg(F.max("quality").alias("_q"))


def _key() -> Column:
    weight = F.when(F.col("_q") == 1, QUALITY[1]).when(F.col("_q") == 0, QUALITY[0]).otherwise(QUALITY[None])
    return -F.log(uniform(F.col("_id"))) / weight


def _keyed(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow rows _id, _source, _tokens, _key."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), tokens(F.col(text_col)).alias("_tokens"))
    rows = rows.join(_best(labels), F.col("_id") == F.col("_lid"), "left")
    return rows.select("_id", "_source", "_tokens", _key().alias("_key"))


def plan(docs: DataFrame, labels: DataFrame, weights: dict[str, int] | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The narrow rows, and for each source: _s, _epochs, and the _last (key, id) of the partial epoch or null."""
    rows = cut(_keyed(docs, labels, id_col, text_col, source_col))
    slot = _slot()
    slots = cut(rows.groupBy(F.col("_source").alias("_s"), slot.alias("_slot")).agg(F.sum("_tokens").alias("_n")))
    per = slots.groupBy("_s").agg(F.sum("_n").alias("_have"))
    if weights is None:
        share = F.floor(F.sqrt(F.col("_have").cast("double")))
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("_s")], F.lit(0)) if weights else F.lit(0)
    per = cut(per.withColumn("_w", share.cast("decimal(38,0)")))
    sums = per.agg(F.sum("_w").alias("w"), F.sum("_have").alias("n")).first()
    per = per.withColumn("_ws", F.lit(sums["w"]).cast("decimal(38,0)")).withColumn("_all", F.lit(sums["n"] if budget is None else budget).cast("decimal(19,0)"))
    per = per.withColumn("_want", F.when(F.col("_ws") > 0, F.expr("_all * cast(_w as decimal(18,0)) div _ws")).otherwise(F.lit(0)))
    per = per.select("_s", F.when(F.col("_have") > 0, F.expr("_want div _have")).otherwise(F.lit(1)).alias("_epochs"), F.when(F.col("_have") > 0, F.expr("_want % _have")).otherwise(F.lit(0)).alias("_rest"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_slot"))
    ends = slots.withColumn("_upto", upto).join(per.withColumnRenamed("_s", "_ps"), F.col("_s").eqNullSafe(F.col("_ps")))
    # The first range that goes beyond the rest, and what is left at its start; where none does, all is taken, which can't be: rest < have.
    ends = ends.where(F.col("_upto") > F.col("_rest")).groupBy("_s", "_epochs", "_rest").agg(F.min_by(F.struct("_slot", (F.col("_upto") - F.col("_n")).alias("_before")), "_slot").alias("_end"))
    ends = cut(ends)
    n_ends = size_of(ends)
    at = join_checked(rows.withColumn("_slot", slot), ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_end._slot")), "inner", n_ends)
    order = Window.partitionBy("_s").orderBy(F.col("_key"), F.col("_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    inside = at.withColumn("_cum", F.sum("_tokens").over(order) + F.col("_end._before")).where(F.col("_cum") <= F.col("_rest"))
    last = inside.groupBy(F.col("_s").alias("_ls")).agg(F.max(F.struct("_key", "_id")).alias("_last"))
    full = per.withColumnRenamed("_s", "_fs").join(ends.select("_s", F.col("_end._slot").alias("_slot")), F.col("_fs").eqNullSafe(F.col("_s")), "left")
    full = full.join(last, F.col("_fs").eqNullSafe(F.col("_ls")), "left")
    return rows, cut(full.select(F.col("_fs").alias("_s"), "_epochs", F.coalesce("_slot", F.lit(0)).alias("_slot"), "_last"))


def _slot() -> Column:
    """The range of a key, the same for equal keys and never smaller for larger ones."""
    weights = sorted(set(QUALITY.values()))
    left = sum((F.exp(-F.col("_key") * w) for w in weights), F.lit(0.0)) / len(weights)
    return F.floor((1 - left) * SLOTS).cast("int")


def _planned(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (_source) with their source's plan. Sources are few; were they not, Spark would shuffle rows by source and split those of hot ones."""
    return join_checked(rows, per, F.col("_source").eqNullSafe(F.col("_s")), "inner", size_of(per))


def _copies() -> Column:
    """How often a keyed row joined with its source's plan is taken."""
    slot = _slot()
    in_last = F.col("_last").isNotNull() & (F.struct("_key", "_id") <= F.col("_last"))
    return (F.col("_epochs") + ((slot < F.col("_slot")) | in_last).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, int] | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each taken copy: doc_id, source, epoch (0 on), n_tokens."""
    rows, per = plan(docs, labels, weights, budget, id_col, text_col, source_col)
    out = _planned(rows, per).withColumn("_copies", _copies()).where("_copies > 0")
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch"), F.col("_tokens").alias("n_tokens"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, int] | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as it is taken; all columns as they came. Labels and sources are joined to the rows, texts stay in place unless labels are too many to broadcast."""
    _, per = plan(docs, labels, weights, budget, id_col, text_col, source_col)
    best = cut(_best(labels))
    keyed = docs.select(F.struct("*").alias("_d"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    keyed = join_checked(keyed, best, F.col("_id") == F.col("_lid"), "left", size_of(best))
    out = _planned(keyed.withColumn("_key", _key()), per).withColumn("_copies", _copies())
    return out.where("_copies > 0").select("_d", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_n")).select("_d.*")
