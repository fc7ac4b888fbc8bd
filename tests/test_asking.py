"""How often models are asked, what services are sent, and scores of models' replies."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.plans import chat, extraction, models, providers
from docloom.plans.template import Bucket, Item, Mapping, Table, create_template
from tests.test_extraction import PAGE, _answer


class Counting:
    """Answers by a function and leaves a file for each call."""

    def __init__(self, folder: str, answer, name: str = "m") -> None:
        self.folder, self.answer, self.name = folder, answer, name

    def ask(self, prompt, images):
        import uuid

        with open(f"{self.folder}/{self.name}-{uuid.uuid4()}", "w") as f:
            f.write(prompt)
        out = self.answer(prompt)
        if out is None:
            raise models.RateLimited
        return out


def calls(folder, name: str = "m") -> list[str]:
    return [open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith(f"{name}-")]


def _factory(folder, answer):
    return lambda spec: Counting(str(folder), answer, spec.model_id)


def test_equal_prompts_are_asked_once(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)] + [(99, None)], "k int, prompt string").repartition(4)
    out = models.ask(prompts, models.Spec("m", price_in=1), _factory(tmp_path, lambda p: f"re {p}"))
    assert out.where("reply = concat('re ', prompt)").count() == 30 and out.where("reply is null").count() == 1
    out.join(out.select("k", F.col("reply").alias("again")), "k").collect()
    assert sorted(calls(tmp_path)) == ["p0", "p1", "p2"]


def test_stored_replies_are_not_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store, factory = f"{tmp_path}/store", _factory(tmp_path / "calls", lambda p: None if p == "never" else p.upper())
    spec = models.Spec("m", attempts=1)
    first = spark.createDataFrame([("a",), ("never",)], "prompt string")
    assert {r.reply for r in models.ask(first, spec, factory, failed_as_null=True, store=store).collect()} == {"A", None}
    second = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert {r.reply for r in models.ask(second, spec, factory, store=store).collect()} == {"A", "B"}
    assert sorted(calls(tmp_path / "calls")) == ["a", "b", "never"]


def test_images_are_shown_to_models_that_take_them(spark):
    prompts = spark.createDataFrame([("p", [bytearray(b"one"), bytearray(b"two")]), ("p", [bytearray(b"one")])], "prompt string, images array<binary>")

    class Client:
        def ask(self, prompt, images):
            return models.Reply(",".join(i.decode() for i in images), 1000, 0)

    seen = models.ask(prompts, models.Spec("m", "gpt", multimodal=True, price_in=2, price_image=1), lambda s: Client(), images_col="images")
    assert sorted((r.reply, float(r.cost)) for r in seen.collect()) == [("one", 3.0), ("one,two", 4.0)]
    assert {r.reply for r in models.ask(prompts, models.Spec("m"), lambda s: Client(), images_col="images").collect()} == {""}


def test_fallback_asks_as_often_as_allowed(spark, tmp_path):
    prompts = spark.createDataFrame([("x",), ("y",)], "prompt string")
    specs = [models.Spec(m, attempts=2, wait=(0, 0)) for m in ("a", "b", "c")]
    factories = [_factory(tmp_path, f) for f in (lambda p: None, lambda p: p if p == "x" else None, lambda p: "late")]
    out = models.ask_with_fallback(prompts, list(zip(specs, factories)))
    assert sorted((r.prompt, r.reply, r.model) for r in out.collect()) == [("x", "x", "b"), ("y", "late", "c")]
    assert [len(calls(tmp_path, m)) for m in ("a", "b", "c")] == [4, 3, 1]


def test_extraction_asks_each_prompt_once(spark, tmp_path):
    from docloom.sources import html

    elements = html.extract(spark.createDataFrame([("d1", PAGE)], "source_identifier string, html string"), "source_identifier", "html").withColumn("source_type", F.lit("html"))
    currency = Item("currency", "list", values=("USD", "EUR"))
    mapping = Mapping("m", "profit", (Bucket("in", "Income"), Bucket("out", "Expenses")))
    template = create_template([Item("What is the total?", "numeric", meta=(currency,)), Item("And the other?", "numeric")], [Table("Profit and loss", mapping=mapping, meta=(currency,))])
    out = extraction.run_with_single_model(spark, elements, template, models.Spec("m"), _factory(tmp_path, _answer))
    for _ in range(2):
        assert (out.answers.count(), out.columns.count(), out.buckets.count()) == (2, 2, 2)
    asked = calls(tmp_path)
    assert len(asked) == len(set(asked)) == 2 + 1 + 2 + 1


def _rows(spark):
    rows = [(f"d{i}", "t", f"q{j}", f"prompt {i} {j}", json.dumps({"main_question": str(10 * i + j)}), "n/a" if i else None) for i in range(2) for j in range(3)]
    return spark.createDataFrame(rows, "source_identifier string, template_id string, element_identifier string, FEATURE_full_prompt string, ANSWER_assigned string, ANSWER_a string")


def _template():
    return create_template([Item(f"Question {j}", "int", id=f"q{j}") for j in range(3)])


def test_evaluation_of_two_models_asks_each_prompt_once(spark, tmp_path):
    def good(p):
        _, i, j = p.split()
        return json.dumps({"main_question": f"it is {10 * int(i) + int(j)}"})

    registry = models.Registry([models.Spec("a"), models.Spec("b", temperature=1)], {"custom": lambda s: Counting(str(tmp_path), good if s.model_id == "a" else lambda p: '{"main_question": "0"}' if p.endswith("0") else "none", s.model_id)})
    scores, answered = extraction.evaluate_models(_rows(spark), _template(), registry, ["a", "b"], write_to=f"{tmp_path}/written")
    got = {r.model: r for r in scores.collect()}
    assert (got["a"].total_correct, got["a"].completion, got["assigned"].total_correct) == (6, 1.0, 6)
    assert (got["b"].total_correct, round(got["b"].completion, 6), round(got["b"].total_correct_percent, 6)) == (1, round(1 / 3, 6), round(1 / 6, 6))
    assert answered.where("ANSWER_b = 'none'").count() == 4
    assert [len(calls(tmp_path, m)) for m in "ab"] == [6, 6]
    from docloom.sources.tabular import read_dataset

    back = read_dataset(spark, f"{tmp_path}/written")
    assert back.count() == 6 and "ANSWER_b" in back.columns


def test_saved_replies_comparators_and_unknown_questions(spark, tmp_path):
    registry = models.Registry([models.Spec("a")], {"custom": _factory(tmp_path, lambda p: '{"main_question": "1"}')})
    rows = _rows(spark).withColumn("ANSWER_a", F.when(F.col("source_identifier") == "d0", F.lit('{"main_question": "0"}')).otherwise("n/a"))
    near = lambda a, b: F.abs(a.cast("int") - b.cast("int")) <= 1
    scores, _ = extraction.evaluate_models(rows, _template(), registry, ["a"], use_saved=True, compare={"q1": near})
    assert {r.model: r.total_correct for r in scores.collect()}["a"] == 2 and not calls(tmp_path, "a")
    extraction.evaluate_models(rows, _template(), registry, ["a"], use_saved=True, retry_na=True)[0].collect()
    assert len(calls(tmp_path, "a")) == 3
    with pytest.raises(Exception, match="no such question"):
        extraction.evaluate_models(rows.withColumn("element_identifier", F.lit("zz")), _template(), registry, ["a"])


def test_assigned_and_custom_models(spark):
    docs = spark.createDataFrame([("d1", "text", 0, "text", "hello", None)], "source_identifier string, source_type string, element_index int, el_type string, text string, rows array<struct<row_type:string,values:array<struct<val:string,colspan:int>>>>")
    truth = spark.createDataFrame([("d1", "question1", "42", [], [0])], "source_identifier string, class_id string, class_value string, meta array<struct<class_id:string,class_value:string>>, sources array<int>")
    template = create_template([Item("What?", "int")]).with_truth()
    out = extraction.Extraction(spark, template, models.Registry(), truth_answers=truth).run(docs)
    assert [(r.model, r.class_value, r.parse_successful) for r in out.answers.collect()] == [("assigned", "42", True)]
    with pytest.raises(ValueError, match="no true answers"):
        extraction.Extraction(spark, template, models.Registry()).answers(docs)
    own = models.Custom(answers=lambda e, item: extraction.R.assigned_answers(truth.where(F.col("class_id") == item.id)).withColumn("model", F.lit("own")))
    out = extraction.Extraction(spark, create_template([Item("What?", "int")]).with_model("own"), models.Registry(custom={"own": own})).run(docs)
    assert [(r.model, r.class_value) for r in out.answers.collect()] == [("own", "42")]


def test_page_by_page_asks_each_page_once(spark, tmp_path):
    pages = spark.createDataFrame([("c", k, f"page {k}", bytearray(b"x")) for k in range(3)], "conv_id string, page_order int, prompt string, image binary")
    out = chat.page_by_page(pages, models.Spec("m"), _factory(tmp_path, lambda p: f'[{p[-1]}]'))
    assert [r.text for r in out.collect()] == ["[0, 1, 2]"] and out.count() == 1
    asked = sorted(calls(tmp_path), key=lambda p: p[-1])
    assert len(asked) == 3 and "ends with: [0]" in asked[1] and "ends with" not in asked[0]


REPLIES = {
    "gpt": {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}},
    "anthropic": {"content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 7, "output_tokens": 2}},
    "cohere": {"text": "hi", "meta": {"billed_units": {"input_tokens": 7, "output_tokens": 2}}},
    "google": {"candidates": [{"content": {"parts": [{"text": "h"}, {"text": "i"}]}}], "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 2}},
    "ollama": {"message": {"content": "hi"}, "prompt_eval_count": 7, "eval_count": 2},
    "replicate": {"output": ["h", "i"], "metrics": {"input_token_count": 7, "output_token_count": 2}},
}
REPLIES |= {k: REPLIES["gpt"] for k in ("azure", "mistral", "together")}


@pytest.mark.parametrize("kind", sorted(providers.SERVICES))
def test_services(kind):
    sent = []

    def transport(url, headers, body):
        sent.append((url, headers, json.dumps(body)))
        return (429, {}) if len(sent) == 1 else (200, REPLIES[kind])

    able = kind not in models.TEXT_ONLY
    spec = models.Spec("m", kind, "name", multimodal=able, max_images=1, system="be brief", attempts=2, wait=(0, 0), endpoint="https://e" if kind == "azure" else None, api_version="1" if kind == "azure" else None, api_key="secret")
    ask = models.asking(spec, providers.factories(transport)[kind], sleep=lambda s: None)
    assert ask("question", (b"\x89PNG..", b"second")) == models.Reply("hi", 7, 2)
    assert ask("question", (b"\x89PNG..", b"second")).text == "hi" and len(sent) == 2
    url, headers, body = sent[-1]
    assert "name" in url + body and "question" in body and ("be brief" in body) and "secret" not in url + body
    assert ("iVBORy" in body or "iVBOR" in body) == (able and kind != "cohere") and "c2Vjb25k" not in body
    with pytest.raises(models.RetryError):
        models.asking(spec, providers.factories(lambda *a: (429, {}))[kind], sleep=lambda s: None)("q", ())
    with pytest.raises(providers.ServiceError):
        models.asking(spec, providers.factories(lambda *a: (400, {"error": "no"}))[kind])("q", ())
