"""Answers are moved once, by their source; the truth stands beside them without a join."""

from __future__ import annotations

from docloom.operators import evaluation as E

ANSWERS = "source string, model string, class_id string, key string, value string, seq int, meta_n int"


def _some(spark):
    rows = [("s", "assigned", "c", "", "1", 0, 0), ("s", "m", "c", "", "1", 0, 0), ("s", "n", "c", "k", "2", 0, 1), ("s", "m", "d", "", "9", 1, 0), ("t", "m", "c", "", "1", 0, 0), (None, "assigned", "c", "", "1", 0, 0), (None, "m", "c", "", "1", 0, 0)]
    return spark.createDataFrame(rows, ANSWERS).repartition(3)


def test_one_exchange(spark):
    for out, most in ((E.matched(E.first_answers(_some(spark))), 1), (E.by_source(E.first_answers(_some(spark))), 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == most and "Join" not in plan and "Scan ExistingRDD" in plan


def test_matches(spark):
    got = {(r.source, r.model, r.class_id, r.status, r.correct) for r in E.matched(E.first_answers(_some(spark))).collect()}
    assert got == {("s", "assigned", "c", "key", True), ("s", "m", "c", "key", True), ("s", "n", "c", "single", False)}  # no truth: t; nothing is told of a null source
    assert {r.model: r.total_correct for r in E.evaluate(_some(spark)).collect()} == {"assigned": 1, "m": 1, "n": 0}
