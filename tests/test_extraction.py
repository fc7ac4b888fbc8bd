"""HTML to answers, columns and buckets; chats; streams; dataset files."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import json_repair as J
from docloom.operators.tables import structure
from docloom.plans import chat, extraction, models
from docloom.plans.template import Bucket, Item, Mapping, Table, create_template, from_json
from docloom.sources import html, tabular
from docloom.sources.documents import explode_documents, from_text, to_json_documents
from docloom.streaming import answers as streaming

PAGE = """<html><body><h1>Report 2023</h1><p>All figures in USD.</p>
<table><thead><tr><th></th><th colspan="1">2023</th><th>2022</th></tr></thead>
<tbody><tr><td>Revenue</td><td>1,200.50</td><td>1,000</td></tr><tr><td>Costs</td><td>(300)</td><td>(250)</td></tr><tr style="display:none"><td>x</td></tr></tbody></table>
<p>End of the report.</p><div style="display: none">hidden</div></body></html>"""


@pytest.fixture(scope="module")
def elements(spark):
    pages = spark.createDataFrame([("d1", PAGE), ("d2", "<p>Only text: total is 12.5 EUR</p>"), ("d3", None), ("d4", "")], "source_identifier string, html string")
    return html.extract(pages, "source_identifier", "html").withColumn("source_type", F.lit("html")).cache()


def test_html_elements(elements):
    got = {(r.source_identifier, r.element_index): r for r in elements.collect()}
    kinds = [got[k].el_type for k in sorted(got) if k[0] == "d1"]
    assert kinds.count("table") == 1 and "hidden" not in " ".join(r.text or "" for r in got.values())
    assert got[("d2", 0)].text == "Only text: total is 12.5 EUR" and not any(k[0] in ("d3", "d4") for k in got)


def test_table_structure(elements):
    t = structure(elements.where("el_type = 'table'")).first()
    assert [(i.caption, [float(v) for v in i["values"]]) for i in t.line_items] == [("Revenue", [1200.5, 1000.0]), ("Costs", [-300.0, -250.0])]
    assert t.header_rows == [0] and t.numeric_cols == [1, 2]


def _answer(prompt: str) -> str | None:
    if "main_question" in prompt:
        return '{"answers": [{"main_question": "The total is: 1,200.50", "meta1": "usd"}], "sources": [0, 99]}' if '"meta1"' in prompt else '{"main_question": "12.5", "sources": [0]}'
    if "JSON array of numbers" in prompt:
        return f"[{re.search(r'\[(\d+)\] before', prompt).group(1)}]"
    if "Buckets:" in prompt:
        return '{"in": ["LI0"], "out": ["LI1"]}'
    return "1) USD"


SPEC = models.Spec("rules", price_in=1)


def factory(_: models.Spec) -> models.Rules:
    return models.Rules(_answer)


def test_run_with_single_model(spark, elements):
    currency = Item("currency", "list", values=("USD", "EUR"))
    mapping = Mapping("m", "profit", (Bucket("in", "Income"), Bucket("out", "Expenses")))
    template = create_template([Item("What is the total?", "numeric", meta=(currency,))], [Table("Profit and loss", mapping=mapping, meta=(currency,))])
    assert from_json(template.to_json()) == template
    out = extraction.run_with_single_model(spark, elements, template, SPEC, factory)
    a = {r.source_identifier: r for r in out.answers.collect()}
    assert a["d1"].class_value == "1200.5" and a["d1"].parse_successful and [(m.class_id, m.class_value) for m in a["d1"].meta] == [("meta1", "USD")]
    assert a["d1"].sources == [0]
    columns = out.columns.orderBy("col_idx").collect()
    assert [[(p.line_item, float(p.value)) for p in c.pairs] for c in columns] == [[("Revenue", 1200.5), ("Costs", -300.0)], [("Revenue", 1000.0), ("Costs", -250.0)]]
    assert all(c.meta[0].class_value == "USD" for c in columns)
    assert sorted((r.li_idx, r.bucket_id) for r in out.buckets.collect()) == [(0, "in"), (1, "out")]


def test_custom_prompt(spark, elements):
    out = extraction.run_custom_prompt(spark, elements, "What is it?", SPEC, factory)
    assert {r.class_value for r in out.collect()} == {"12.5"}


def test_chat_falls_back_to_the_model_that_answers(spark, elements):
    def limited(_):
        class Never:
            def ask(self, prompt, images):
                raise models.RateLimited

        return Never()

    specs = [models.Spec(m, attempts=2, wait=(0, 0)) for m in ("a", "b", "c")]
    ref = "array<struct<source_identifier:string,element_index:int>>"
    messages = spark.createDataFrame([("c1", 0, "Hello", [("d1", None)]), ("c1", 1, "And?", [("d2", 0)])], f"conv_id string, turn int, text string, references {ref}")
    texts = elements.where("el_type = 'text'")
    out = chat.run_chat(messages, texts, [(specs[0], limited), (specs[1], lambda s: models.Rules(lambda p: "seen" if "12.5 EUR" in p and "Hello" in p else None)), (specs[2], limited)], 1000).collect()
    assert [(r.conv_id, r.text, r.author) for r in out] == [("c1", "seen", "b")]


def test_asking_retries_and_remembers():
    calls = []

    class Client:
        def ask(self, prompt, images):
            calls.append(prompt)
            if prompt == "never":
                raise models.RateLimited
            return prompt

    ask = models.asking(models.Spec("x", attempts=2), lambda s: Client(), sleep=lambda s: None)
    assert ask("123") == ask("123") == "123" and calls == ["123"]
    with pytest.raises(models.RetryError):
        ask("never")
    assert calls == ["123", "never", "never"]


MERGE = [
    (['```json\n[{"k": 1}, {"k": 2}]\n```', '```json\n{"k": 3},\n {"k": 4}\n]\n```'], 4),
    (['[{"k": 1}]'], 1), (['{"k": 1}'], 1), ([], 0), (["[]", "[]"], 0), (['[{"k": 1}]', "no JSON here", '{"k": 2}, {"k": 3}],'], 3), (['{"k": 3}, {"k": 4}] and more'], 1),
]


@pytest.mark.parametrize(("replies", "n"), MERGE)
def test_merging_objects(spark, replies, n):
    df = spark.createDataFrame([(replies,)], "r array<string>").select(F.from_json(J.merge_objects(F.col("r")), F.lit("array<struct<k:bigint>>")).alias("o"))
    assert sum(x.k is not None for x in df.first().o) == n


def test_streaming_answers(spark, tmp_path):
    spark.createDataFrame([("I think: 5",), ("none",)], "reply string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("reply string").parquet(f"{tmp_path}/in")
    streaming.write_stream(streaming.typed_stream(stream, "int"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("I think: 5", "5", True), ("none", "n/a", False)]


def test_dataset_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "q", 'x "y"\nz', "1"), ("b", "t", "q", None, "2")], "source_identifier string, template_id string, element_identifier string, FEATURE_full_prompt string, ANSWER_assigned string")
    tabular.write_dataset(rows, f"{tmp_path}/d")
    back = tabular.read_dataset(spark, f"{tmp_path}/d").orderBy("source_identifier").collect()
    assert [(r.source_identifier, r.FEATURE_full_prompt) for r in back] == [("a", 'x "y"\nz'), ("b", "[NOT_CONFIGURED]")]


def test_rows_of_several_files_batches_and_models(spark, tmp_path):
    base = spark.createDataFrame([(f"s{i:02d}", "t", "q", f"p{i}") for i in range(20)], "source_identifier string, template_id string, element_identifier string, FEATURE_full_prompt string")
    for part in range(2):
        tabular.write_dataset(base.where(f"int(substr(source_identifier, 2)) % 2 = {part}").coalesce(1), f"{tmp_path}/d{part}")
    rows = tabular.read_dataset(spark, f"{tmp_path}/d0", f"{tmp_path}/d1")
    order = [f"s{i:02d}" for i in (*range(0, 20, 2), *range(1, 20, 2))]
    assert [(r.row_index, r.source_identifier) for r in rows.orderBy("row_index").collect()] == list(enumerate(order))
    some = tabular.read_dataset(spark, f"{tmp_path}/d0", f"{tmp_path}/d1", indices=[11, 3], skip=F.col("source_identifier") == "s06", preprocess=lambda d: d.select("row_index", "source_identifier"))
    assert [tuple(r) for r in some.collect()] == [(11, "s03")]
    assert [len(b) for b in tabular.batches(rows, 8)] == [8, 8, 4] and sorted(tabular.stream_column(rows, "source_identifier")) == sorted(order)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, x * 2 AS y FROM __THIS__")]).fit(spark.createDataFrame([(1,)], "x int"))
    tabular.save_model(model, f"{tmp_path}/m", tabular.scaling(spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, c string"), ["x"], ["c"]))
    back, columns = tabular.load_model(spark, f"{tmp_path}/m")
    assert back.transform(spark.createDataFrame([(4,)], "x int")).first().y == 8 and (columns.first().min_x, columns.first().values_c) == (1.0, ["a", "b"])


def test_csv_and_json_documents(spark):
    files = spark.createDataFrame([("f", bytearray(b"a;b\n1;2;3\n"))], "source_identifier string, content binary")
    rows = tabular.read_csv_tables(files).first().rows
    assert [[c.val for c in r["values"]] for r in rows] == [["a", "b", ""], ["1", "2", "3"]]
    docs = to_json_documents(from_text(spark.createDataFrame([("hello",)], "text string")))
    from docloom.schemas import DOCUMENT

    e = explode_documents(docs.select(F.from_json("json", DOCUMENT).alias("d")).select("d.*")).first()
    assert (e.el_type, e.text, e.element_index) == ("text", "hello", 0)


def test_files_are_loaded_by_their_type(spark, tmp_path):
    from docloom.sources.documents import CONVERTERS, load_documents, register_converter

    (tmp_path / "a.HTML").write_text("<p>one</p>")
    (tmp_path / "b.html").write_text("<p>two</p><table><tr><td>1</td></tr></table>")
    assert sorted((r.el_type, r.text) for r in load_documents(spark, str(tmp_path)).where("el_type = 'text'").collect()) == [("text", "one"), ("text", "two")]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="tabular"):
        load_documents(spark, str(tmp_path))
    register_converter("tabular", tabular.read_csv_tables)
    try:
        assert sorted(r.el_type for r in load_documents(spark, str(tmp_path)).collect()) == ["table", "table", "text", "text"]
    finally:
        del CONVERTERS["tabular"]
