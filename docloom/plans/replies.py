"""Replies to prompts as typed rows: answers, locations, meta values and buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import let, staged
from docloom.functions.answers import parse_typed
from docloom.functions.json_repair import find_array, find_dict, items
from docloom.functions.numeric import digits_int
from docloom.operators.mapping import with_unclassified
from docloom.plans.prompts import MAIN
from docloom.plans.template import Item


def plain(json: Column) -> Column:
    """A JSON value as text: strings without quotes, others as they are."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x"), json)


def _typed(item: Item, raw: Column) -> Column:
    return parse_typed(item.type, raw, F.array(*map(F.lit, item.values)) if item.values else None, item.default)


def _meta_of(id_: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(id_).alias("class_id"), v["value"].alias("class_value"), F.when(v["ok"], 0.8).otherwise(0.0).alias("prob"))


def answers(replies: DataFrame, item: Item, elements: DataFrame | None = None) -> DataFrame:
    """Replies (source_identifier, model, reply) to a question as answers: class_id, class_value, raw_value, parse_successful, meta, sources, seq (the place in the reply).

    A reply is a JSON object with the answer under a key that holds "main_question", or a list of such objects under "answers".
    ok is that of the last key that was parsed. Sources are the numbers listed, with ``elements`` those that the document has.
    """
    replies = staged(replies, _body=find_dict(F.col("reply")))
    body = F.col("_body")
    blocks = F.when(F.get_json_object(body, "$.answers").startswith("["), items(F.get_json_object(body, "$.answers"))).when(F.array_contains(F.map_keys(F.from_json(body, F.lit("map<string,string>"))), MAIN), F.array(body))
    listed = F.get_json_object(body, "$.sources")
    numbers = F.filter(F.transform(F.when(listed.startswith("["), items(listed)), lambda x: F.when(plain(x).rlike(r"^\d+$"), plain(x)).try_cast("int")), lambda x: x.isNotNull())
    rows = replies.select("source_identifier", "model", F.col("reply").alias("raw_value"), F.coalesce(numbers, F.array().cast("array<int>")).alias("sources"), F.posexplode(blocks).alias("seq", "_b"))
    pairs = F.map_entries(F.from_json("_b", F.lit("map<string,string>")))
    rows = staged(rows, _p=pairs).where("_p is not null")

    def last_of(test) -> Column:
        return F.try_element_at(F.filter("_p", test), F.lit(-1))["value"]

    main_raw = last_of(lambda e: e["key"].contains(MAIN))
    rows = staged(rows, _raw=main_raw)
    rows = rows.withColumn("_main", F.when(F.col("_raw").isNotNull(), _typed(item, F.col("_raw"))))
    known = {m.id: m for m in item.meta}
    meta = []
    for m in known.values():
        raw = last_of(lambda e: (e["key"] == m.id) & ~e["key"].contains(MAIN))
        meta.append(F.when(raw.isNotNull(), let(_typed(m, raw), _meta_of(m.id))))
    rows = staged(rows, meta=F.filter(F.array(*meta), lambda m: m.isNotNull()) if meta else F.array().cast("array<struct<class_id:string,class_value:string,prob:double>>"))
    # Of the keys in their order the last parsed one decides about success.
    last_key = F.try_element_at(F.filter(F.transform("_p", lambda e: e["key"]), lambda k: k.contains(MAIN) | (k.isin(*known) if known else F.lit(False))), F.lit(-1))
    ok = F.when(last_key.contains(MAIN), F.col("_main.ok")).otherwise(F.coalesce(F.try_element_at(F.transform(F.filter("meta", lambda m: m["class_id"] == last_key), lambda m: m["prob"] > 0), F.lit(1)), F.lit(False)))
    out = rows.where("_main is not null").select("source_identifier", "model", F.lit(item.id).alias("class_id"), F.col("_main.value").alias("class_value"), "raw_value", ok.alias("parse_successful"), "meta", "sources", F.col("seq").cast("bigint").alias("seq"))
    if elements is None:
        return out
    size = elements.groupBy("source_identifier").agg(F.count("*").alias("_size"))
    out = out.join(size, "source_identifier", "left")
    return out.withColumn("sources", F.filter("sources", lambda x: x < F.coalesce("_size", F.lit(0)))).drop("_size")


def answer_sources(answers_: DataFrame, elements: DataFrame) -> DataFrame:
    """Answers' sources as the places of the elements that they name."""
    return answers_.select("source_identifier", "model", "class_id", F.explode("sources").alias("element_index")).join(elements, ["source_identifier", "element_index"])


def locations(replies: DataFrame, detected_class: str, elements: DataFrame, prob: float = 0.8) -> DataFrame:
    """Replies to a detection prompt as locations: numbers in the JSON arrays of the reply's lines that the document has; partial if there are several."""
    arrays = F.transform(F.split("reply", r"\r\n|[\n\r]"), lambda line: F.transform(items(find_array(line)), lambda x: F.when(x.rlike(r"^-?\d+$"), x).try_cast("int")))
    numbers = F.filter(F.flatten(F.filter(arrays, lambda a: a.isNotNull())), lambda x: x.isNotNull())
    rows = replies.select("source_identifier", "model", F.posexplode(numbers).alias("seq", "element_index"))
    rows = rows.join(elements.select("source_identifier", "element_index"), ["source_identifier", "element_index"], "left_semi")
    from pyspark.sql import Window

    several = F.count("*").over(Window.partitionBy("source_identifier", "model")) > 1
    return rows.select("source_identifier", "model", F.lit(detected_class).alias("detected_class"), "element_index", F.lit(prob).alias("prob"), F.when(several, 0.6).otherwise(0.0).alias("partial_prob"), F.col("seq").cast("bigint").alias("seq"))


def assigned_locations(truth: DataFrame) -> DataFrame:
    """True locations (source_identifier, detected_class, partial_prob, element_index), each once, with the probability that marks them as given."""
    from pyspark.sql import Window

    once = truth.dropDuplicates(["source_identifier", "detected_class", "partial_prob", "element_index"])
    seq = F.row_number().over(Window.partitionBy("source_identifier").orderBy("element_index", "detected_class")) - 1
    return once.select("source_identifier", F.lit("assigned").alias("model"), "detected_class", "element_index", F.lit(2.0).alias("prob"), F.col("partial_prob").cast("double").alias("partial_prob"), seq.cast("bigint").alias("seq"))


def assigned_answers(truth: DataFrame) -> DataFrame:
    """True answers (source_identifier, class_id, class_value, meta, sources, and seq if they have an order) as answers."""
    seq = F.col("seq") if "seq" in truth.columns else F.lit(0)
    meta = F.transform("meta", lambda m: F.struct(m["class_id"].alias("class_id"), m["class_value"].alias("class_value"), F.lit(1.0).alias("prob")))
    return truth.select("source_identifier", F.lit("assigned").alias("model"), "class_id", "class_value", F.col("class_value").alias("raw_value"), F.lit(True).alias("parse_successful"), meta.alias("meta"), "sources", seq.cast("bigint").alias("seq"))


def meta_values(replies: DataFrame, metas: list[Item]) -> DataFrame:
    """Replies (column_id, reply) as meta values: lines "k) value" for the k-th item; of several lines of one number the last."""
    line = F.transform(F.split("reply", r"\r\n|[\n\r]"), lambda x: F.struct(F.regexp_extract(x, r"(\d+)\) *(.+)", 1).try_cast("int").alias("k"), F.regexp_extract(x, r"(\d+)\) *(.+)", 2).alias("v")))
    rows = replies.select("column_id", F.posexplode(line).alias("_at", "_l")).where(F.col("_l.k").between(1, len(metas)))
    last = rows.groupBy("column_id", F.col("_l.k").alias("_k")).agg(F.max_by("_l.v", "_at").alias("_v"))
    parsed = reduce(lambda c, km: c.when(F.col("_k") == km[0], _typed(km[1], F.col("_v"))), enumerate(metas, 1), F.when(F.lit(False), _typed(metas[0], F.col("_v"))))
    name = F.element_at(F.array(*(F.lit(m.id) for m in metas)), F.col("_k"))
    return last.withColumn("_p", parsed).select("column_id", name.alias("class_id"), F.col("_p.value").alias("class_value"), F.when(F.col("_p.ok"), 0.8).otherwise(0.0).alias("prob"))


def bucket_choices(replies: DataFrame, bucket_ids: list[str], line_items: DataFrame) -> DataFrame:
    """Replies (table_id, reply) as buckets of line items (table_id, li_idx); those that no bucket has are not specified."""
    replies = staged(replies, _body=find_dict(F.col("reply")))
    body = F.col("_body")
    lists = F.array(*(F.struct(F.lit(b).alias("b"), F.get_json_object(body, f"$['{b}']").alias("v")) for b in bucket_ids))
    rows = replies.select("table_id", F.explode(lists).alias("_x")).where(F.col("_x.v").startswith("["))
    chosen = rows.select("table_id", F.col("_x.b").alias("bucket_id"), F.explode(items(F.col("_x.v"))).alias("_i")).select("table_id", digits_int(F.col("_i")).alias("li_idx"), "bucket_id").where("li_idx is not null")
    readable = replies.where(body.isNotNull()).select("table_id").distinct()
    return with_unclassified(line_items.join(readable, "table_id", "left_semi"), chosen)
