"""Answers against truth: matching with fallbacks, scores by document and model, and totals by model.

answers: source, model ("assigned" is the truth), class_id, key (of the meta values), value, seq (the order in which answers came up); meta_n: how
many meta values an answer has; full_key, if keys were shortened: the key of all of its meta values. What is collected in
one row are the answers of one reply to one question, whose number the reply's length bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import let

TRUTH = "assigned"
#: By class, what says whether an expected and an actual value are the same.
Comparators = dict[str, Callable[[Column, Column], Column]]


def first_answers(answers: DataFrame) -> DataFrame:
    """One answer for each source, model, class and key: the first one, or where keys were shortened the last whose key was."""
    kept = F.struct("value", "meta_n", "seq")
    first = F.min_by(kept, "seq")
    if "full_key" in answers.columns:
        first = F.coalesce(F.max_by(kept, F.when(F.col("full_key") != F.col("key"), F.col("seq"))), first)
    # By source, as all that follows is, so that answers are moved once.
    one = answers.repartition("source").groupBy("source", "model", "class_id", "key").agg(first.alias("_a"))
    return one.select("source", "model", "class_id", "key", "_a.value", "_a.seq", "_a.meta_n")


def _beside_truth(answers: DataFrame, compare: Comparators | None) -> DataFrame:
    """One row a source, model and class: _n (answers), and where the class has a truth _missing, _order (of the class) and _m: each true answer with the one it is matched with."""
    given = answers.groupBy("source", "class_id", "model").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "value", "meta_n"))).alias("_all"))
    # All models' answers to a question stand in one row, so that the truth is beside them without a join.
    asked = given.groupBy("source", "class_id").agg(F.collect_list(F.struct("model", "_all")).alias("_models"), F.first(F.when((F.col("model") == TRUTH) & F.col("source").isNotNull() & F.col("class_id").isNotNull(), F.col("_all")), ignorenulls=True).alias("_true"))
    both = asked.select("source", "class_id", "_true", F.inline("_models"))
    alone = (F.size("_true") == 1) & (F.size("_all") == 1)

    def same(t: Column, x: Column, status: Column) -> Column:
        equal = t["value"].eqNullSafe(x["value"])
        for cls, f in (compare or {}).items():
            equal = F.when((status == "key") & (F.col("class_id") == cls), f(t["value"], x["value"])).otherwise(equal)
        return F.coalesce(equal, F.lit(False))

    def match(t: Column) -> Column:
        by_key = F.get(F.filter("_all", lambda x: x["key"].eqNullSafe(t["key"])), F.lit(0))
        by_value = F.get(F.filter("_all", lambda x: x["value"].eqNullSafe(t["value"])), F.lit(0))
        found = let(F.struct(by_key.alias("k"), by_value.alias("v")), lambda f: F.struct(F.when(f["k"].isNotNull(), "key").when(alone, "single").when(f["v"].isNotNull(), "value").alias("status"), F.when(f["k"].isNotNull(), f["k"]).when(alone, F.get("_all", F.lit(0))).otherwise(f["v"]).alias("x")))
        return let(found, lambda f: F.struct(t["key"].alias("key"), t["value"].alias("expected_value"), f["x"]["value"].alias("actual_value"), f["x"]["key"].alias("actual_key"), f["status"].alias("status"), t["meta_n"].alias("meta_n"), (f["status"].isNotNull() & same(t, f["x"], f["status"])).alias("correct")))

    return both.select("source", "model", "class_id", F.size("_all").alias("_n"), F.greatest(F.size("_true") - F.size("_all"), F.lit(0)).alias("_missing"), F.array_min(F.transform("_true", lambda t: t["seq"])).alias("_order"), F.transform("_true", match).alias("_m"))


def matched(answers: DataFrame, compare: Comparators | None = None) -> DataFrame:
    """Each true answer with each model's answer to it: status "key" (by key), "single" (one against one), "value" (an equal value under another key) or null (missing).

    ``compare`` is asked about answers that were matched by key; other values must be equal.
    """
    return _beside_truth(answers, compare).select("source", "model", "class_id", F.explode("_m").alias("_x")).select("source", "model", "class_id", "_x.*")


def error_log(matches: DataFrame) -> DataFrame:
    """What is wrong: source, model, class_id, type ("main question" or "meta"), expected, actual."""
    main = F.when(F.col("status").isNotNull() & ~F.col("correct"), F.struct(F.lit("main question").alias("type"), F.col("expected_value").alias("expected"), F.col("actual_value").alias("actual")))
    meta = F.when(F.col("status").isin("single", "value"), F.struct(F.lit("meta").alias("type"), F.col("key").alias("expected"), F.col("actual_key").alias("actual")))
    return matches.select("source", "model", "class_id", F.explode(F.filter(F.array(meta, main), lambda x: x.isNotNull())).alias("_e")).select("source", "model", "class_id", "_e.*")


def by_source(answers: DataFrame, compare: Comparators | None = None, sum_missing: bool = False) -> DataFrame:
    """Scores of each source that has a truth, and model: completion, total_correct, total_correct_meta_found, missing_answers.

    Missing answers are those of the last of the true classes that the model has answered, as in the original; with ``sum_missing`` all classes' count.
    """
    rows = _beside_truth(answers, compare)
    pick = F.sum("_missing") if sum_missing else F.max_by("_missing", F.when(F.col("_order").isNotNull(), F.struct("_order", "class_id")))
    count = lambda test: F.sum(F.coalesce(F.size(F.filter("_m", test)), F.lit(0)))
    met = lambda x: (x["status"] == "key") & (x["key"] != "") & (x["meta_n"] > 0)
    scores = rows.groupBy("source", "model").agg(F.count("*").alias("_n"), count(lambda x: x["correct"]).alias("total_correct"), count(met).alias("total_correct_meta_found"), F.coalesce(pick, F.lit(0)).alias("missing_answers"))
    true = F.max(F.when(F.col("model") == TRUTH, F.col("_n"))).over(Window.partitionBy("source"))
    return scores.withColumn("_t", true).where("_t is not null").select("source", "model", (F.col("_n") / F.col("_t")).alias("completion"), "total_correct", "total_correct_meta_found", "missing_answers")


def totals(scores: DataFrame) -> DataFrame:
    """Scores of each model over all sources, and their shares of the truth's. The models' sums are one row, however many sources there are."""
    sums = scores.groupBy("model").agg(F.count("*").alias("n"), F.sum("completion").alias("c"), *(F.sum(c).alias(c) for c in ("total_correct", "total_correct_meta_found", "missing_answers")))
    rows = sums.agg(F.collect_list(F.struct(*sums.columns)).alias("_all"))
    out = rows.select(F.explode("_all").alias("_s"), F.get(F.filter("_all", lambda x: x["model"] == TRUTH), F.lit(0)).alias("_true")).where("_true is not null")
    tc, tm, miss, right, meta = F.col("_true.total_correct"), F.col("_true.total_correct_meta_found"), F.col("_s.missing_answers"), F.col("_s.total_correct"), F.col("_s.total_correct_meta_found")
    return out.select(
        F.col("_s.model").alias("model"),
        (F.col("_s.c") / F.col("_true.n")).alias("completion"),
        right.alias("total_correct"),
        meta.alias("total_correct_meta_found"),
        miss.alias("missing_answers"),
        F.try_divide(tc - miss, tc).alias("completeness"),
        F.try_divide(right, tc).alias("total_correct_percent"),
        F.try_divide(meta, tm).alias("total_correct_meta_found_percent"),
        F.try_divide(right, tc - miss).alias("total_correct_percent_ex_missing"),
        F.try_divide(meta, F.when(tm > 0, tm - miss)).alias("total_correct_meta_found_percent_ex_missing"),
    )


def evaluate(answers: DataFrame, compare: Comparators | None = None, sum_missing: bool = False) -> DataFrame:
    return totals(by_source(first_answers(answers), compare, sum_missing))


def costs(expenses: DataFrame) -> DataFrame:
    """Sums of amounts by service and class."""
    return expenses.groupBy("service", "class_id").agg(F.sum("amount").alias("amount"), F.count("*").alias("calls"))


def call_cost(tokens_in: Column, tokens_out: Column, images: Column, price_in: Column, price_out: Column, price_image: Column) -> Column:
    """The price of a call: tokens by the thousand and images."""
    one = lambda n, p: F.coalesce(n, F.lit(0)).cast("decimal(18,0)") * F.coalesce(p, F.lit(0)).cast("decimal(18,8)")
    return (one(tokens_in, price_in) / 1000 + one(tokens_out, price_out) / 1000 + one(images, price_image)).cast("decimal(38,10)")
