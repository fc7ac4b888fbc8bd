"""Every operator and stage on tables with nulls, empty and very long texts, ties, repeated rows and clashing columns, and on empty ones."""

from __future__ import annotations

import json

import pytest

import corpus_pipeline
from docloom.llm import chat_parts, exact_dedup, fm_index, langid, license_scan, merkle, mixing, sentencepiece_codec, simhash, warc
from docloom.llm.queries import TOKENIZERS
from tests.llm.util import SCHEMA, docs

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
LONG = "many words of a very long text " * 30_000
ROWS = [
    (1, "the first plain text", "en", "web"), (1, "the first plain text", "en", "web"), (2, None, "en", "web"), (3, "", None, "web"), (4, LONG, "en", None), (None, "no id", "en", "web"),
    (None, None, None, None), (5, "\n\n \t\n", "de", "books"), (6, "ein anderer Text auf deutsch", "de", "books"), (6, "zweiter Text", "de", "books"), (7, "ÄÖ ß \u0000 \U0001f600 " * 3, "de", "web"), (8, LONG, "en", "books"),
]


def nasty(spark, extra: bool):
    df = docs(spark, ROWS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("_id", "_t", "_d", "_k", "_keep", "_key", "_lang", "_node", "_s", "quality", "odd name, with: signs"):
            df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark, rows=((1, 1, 0), (1, 0, 0), (None, 1, 1), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "fingerprints": lambda s, d: merkle.fingerprints(d),
    "edits": lambda s, d: merkle.edits(d, d.limit(3)),
    "identify": lambda s, d: langid.identify(d),
    "mix": lambda s, d: mixing.mix(d, labels(s)),
    "encode": lambda s, d: sentencepiece_codec.encode(d, MODEL),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "license": lambda s, d: license_scan.scan(d),
    "repeats": lambda s, d: fm_index.repeats(d),
    "exact": lambda s, d: exact_dedup.duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_nasty_and_empty_tables(spark, name):
    f = OPERATORS[name]
    plain = sorted(map(str, f(spark, nasty(spark, False)).collect()))
    assert sorted(map(str, f(spark, nasty(spark, True)).collect())) == plain
    assert f(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_stages_on_nasty_and_empty_tables(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = nasty(spark, True)
        out = stage(spark, df, str(tmp_path))
        out.collect()
        empty = stage(spark, spark.createDataFrame([], df.schema), str(tmp_path))
        assert empty.count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name


def test_chat_on_nasty_and_empty_tables(spark):
    schema = f"conv_id bigint, turn bigint, role string, parts {chat_parts.PARTS}, _c string, _m int"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 2, None, [part("text", None), part("image", ref="a.png", w=29, h=28), part("image")], "x", 1),
        (1, 1, "system", [part("video", ref="no"), part(None), None, part("audio", ref='b:;"', s=1.01), part("document", ref="c", p=2), part("text", "tail")], "x", 1),
        (1, 2, "assistant", None, "x", 1),
        (None, None, "user", [], "x", 1),
        (None, None, "user", [], "x", 1),
    ]
    got = {r.conv_id: r for r in chat_parts.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].formatted == "<|system|>\n<|audio_1|><|document_1|>tail<|end|>\n<|assistant|>\n<|end|>\n<|user|>\n<|image_1|><|image_2|><|end|>\n"
    attached = [(x["placeholder"], x["ref"], x["tokens"]) for x in json.loads(got[1].attachments)]
    assert attached == [("audio_1", "b:;\"", 26), ("document_1", "c", 512), ("image_1", "a.png", 4), ("image_2", "", 2)]
    assert (got[1].n_turns, got[1].n_attachments, got[1].n_tokens) == (3, 4, 3 * 4 + 26 + 512 + 1 + 4 + 2)
    assert (got[None].n_turns, got[None].n_tokens, got[None].attachments) == (2, 8, "[]")
    assert chat_parts.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_warc_on_nasty_and_empty_tables(spark):
    schema = "page_id bigint, url string, html string, _file string"
    a = spark.createDataFrame([(1, "u", "abc", ""), (2, None, None, ""), (2, None, None, ""), (None, "v", "x", ""), (3, "w", "y" * 100_000, "")], schema)
    b = spark.createDataFrame([(1, "u", "abd", ""), (2, None, None, ""), (2, None, None, ""), (None, "v", "x", ""), (3, "w", "y" * 100_000, ""), (4, "z", "", "")], schema)
    assert [(r.page_id, r.state) for r in warc.audit(a, b).collect()] == [(1, "changed"), (4, "extra")] or {(r.page_id, r.state) for r in warc.audit(a, b).collect()} == {(1, "changed"), (4, "extra")}
    assert {(r.page_id, r.state) for r in warc.audit(b, a).collect()} == {(1, "changed"), (4, "missing")}
    assert warc.audit(a, a).count() == 0
    empty = spark.createDataFrame([], schema)
    assert warc.audit(empty, empty).count() == 0
    assert {r.state for r in warc.audit(empty, a).collect()} == {"extra"}
