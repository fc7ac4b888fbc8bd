"""Texts in languages without labels, and gibberish, are rejected; short clean ones aren't."""

from __future__ import annotations

import os
import random

import pytest

from docloom.llm import langid
from tests.llm.util import docs

PATH = "/root/testdata/sf0.01/documents.parquet"
FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Tanto gentile e onesta pare la donna mia quando ella altrui saluta.",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
]
SHORT = [("A.", "en"), ("That it.", "en"), ("A.\nAll rights reserved.", "en"), ("Von.", "de"), ("Erinst resh.", "en")]


def test_rejects_and_short_texts(spark):
    if not os.path.exists(PATH):
        pytest.skip("no data")
    rng = random.Random(5)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(10)]
    rows = list(enumerate(FOREIGN + noise + [t for t, _ in SHORT]))
    d = spark.read.parquet(PATH)
    model = langid.train(d)
    out = {r.doc_id: r.predicted for r in langid.identify(docs(spark, rows), model).collect()}
    bad = len(FOREIGN) + len(noise)
    assert [out[i] for i in range(bad)] == ["und"] * bad
    assert "und" not in [out[i] for i in range(bad, len(rows))]
    own = langid.identify(d.where("length(text) > 100"), model)
    assert own.where("accepted").count() >= 0.995 * own.count()
