"""Shares of character classes: lengths are taken once, runs at a time."""

from __future__ import annotations

import re
from random import Random

from pyspark.sql import functions as F

import __spark_entry__
from docloom.functions.text import composition, words


def test_texts_are_searched_once(spark, data_dir):
    plan = __spark_entry__.queries()["composition"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_shares_and_words(spark):
    draw = Random(1)
    texts = ["", " ", "%", None, *("".join(draw.choice("aZ09 .,é%€\n") for _ in range(draw.randrange(30))) for _ in range(200))]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", composition(F.col("t")).alias("c"), words(F.col("t")).alias("w"))
    for r in d.collect():
        n, digits = (len(re.sub(p, "", r.t or "")) for p in ("[^0-9a-zA-Z]", "[^0-9]"))
        signs = len(re.sub("[ 0-9a-zA-Z]", "", r.t or ""))
        assert tuple(r.c) == ((digits / n, (n - digits) / n, signs / len(r.t)) if n else (0.0, 0.0, 0.0))
        assert r.w == (None if r.t is None else re.findall("[%$£€¥0-9a-zA-Z]+", r.t))
