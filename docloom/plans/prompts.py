"""Prompts: their parts, texts and budgets. Texts of data are columns, instructions are made on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.answers import example, possible_values
from docloom.plans.template import Item, Mapping, Table

MAIN = "main_question"
#: A small table and what sorts its rows into buckets, for samples in prompts; never changed.
SAMPLE_ROWS = (("Sales of goods", ("120", "100")), ("Wages", ("-40", "-35")), ("Other items", ("3", None)))
SAMPLE_BUCKETS = (("income", "Income"), ("expenses", "Expenses"))


def history(messages: Column) -> Column:
    """Earlier messages between marks; nothing if there are none."""
    return F.when(F.size(F.coalesce(messages, F.array().cast("array<string>"))) > 0, F.concat(F.lit("[PREVIOUS MESSAGES]\n"), F.array_join(messages, "\n"), F.lit("\n [END PREVIOUS MESSAGES]\n"))).otherwise("")


def instructions(intro: Column, task: Column, info: Column, sample: Column) -> Column:
    """The parts of a prompt before its data; a missing one is left out."""
    part = lambda c: F.coalesce(F.concat(c, F.lit(" \n")), F.lit(""))
    return F.concat(part(intro), F.lit(" "), task, F.lit(" \n "), part(info), F.lit(" "), part(sample))


def tokenize(text: Column) -> Column:
    """A plain stand-in for a tokenizer: a word with the white space before it, or a sign, is a token; joining them gives the text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(\s*[\p{L}\p{N}_]+|\s*[^\s\p{L}\p{N}_]|\s+$)"), F.lit(1))


def truncated(past: Column, told: Column, data: Column, most: int) -> Column:
    """Struct of prompt and n_tokens within a budget: instructions before all, then data, then history.

    Too long instructions are cut and stand alone; if they and the data fit, history is cut; else history goes and data are cut.
    """
    h, i, d = tokenize(past), tokenize(told), tokenize(data)
    text = lambda t, n: F.array_join(F.slice(t, F.lit(1), F.greatest(n, F.lit(0))), "")
    n = F.size(h) + F.size(i) + F.size(d)
    cut = F.when(F.size(i) > most, text(i, F.lit(most)))
    cut = cut.when(n <= most, F.concat_ws(" ", past, told, data))
    cut = cut.when(F.size(i) + F.size(d) <= most, F.concat_ws(" ", text(h, F.lit(most) - F.size(i) - F.size(d)), told, data))
    cut = cut.otherwise(F.concat(told, F.lit(" \n "), text(d, F.lit(most) - F.size(i))))
    return F.struct(cut.alias("prompt"), F.least(n, F.lit(most)).alias("n_tokens"))


def fragments(elements: DataFrame) -> DataFrame:
    """One row a document: ``data``, its elements' llm_text between their numbers, in the order of rank."""
    line = F.concat(F.lit("["), F.col("element_index").cast("string"), F.lit("]: "), F.col("llm_text"), F.lit(" [/"), F.col("element_index").cast("string"), F.lit("]\n"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("t"))))
    return elements.groupBy("source_identifier").agg(F.concat(F.lit("Fragments to answer from (blank cells are left out, cells over several columns are repeated):\n"), F.array_join(F.transform(lines, lambda x: x["t"]), "")).alias("data"))


def answer_json(item: Item, value: str, meta: dict[str, str], sources: list[int] | None) -> str:
    """A reply as a model should give it."""
    one = {MAIN: value} | {m.id: meta.get(m.id, "n/a") for m in item.meta}
    out: dict = {"answers": [one]} if item.meta else one
    return json.dumps(out | ({} if sources is None else {"sources": sources}))


def question_parts(item: Item, images: bool = False) -> tuple[str, str, str]:
    """Introduction, task and sample of a question."""
    intro = "Answer a question from images that are given below." if images else "Answer a question from numbered fragments of a document. A fragment begins with its number in brackets and ends with the same number behind a slash, as in [3]: text [/3]; lower numbers come earlier in the document."
    task = f"Question: {item.title}{f' (note: {item.info})' if item.info.strip() else ''}; {possible_values(item.type, list(item.values))}"
    if item.meta:
        task += "\nFor each answer also give, under the key named in brackets:" + "".join(f"\n({m.id}): {m.title} {m.info} {possible_values(m.type, list(m.values))}" for m in item.meta)
    sample = answer_json(item, example(item.type, list(item.values), item.example), {m.id: example(m.type, list(m.values), m.example) for m in item.meta}, None if images else [241, 423])
    where = "" if images else " List the numbers of the fragments used under 'sources'."
    return intro, task, f"Reply with a JSON object; the answer stands under '{MAIN}'{' in each entry of the list under answers' if item.meta else ''}.{where} A reply could be: {sample}"


def detection_parts(item: Table) -> tuple[str, str, str]:
    """Introduction, task and sample for finding a table."""
    return ("Tables of a document follow, each with its number, the text before it and the words in it.", f'Which of them, one or several together, are "{item.title}"?{f" Note: {item.info}" if item.info.strip() else ""}', "Reply with a JSON array of numbers, such as [10] or [241, 1204].")


def detection_data(features: DataFrame) -> DataFrame:
    """One row a document: the tables (element_index, text_before, text) as detection prompts list them."""
    line = F.concat(F.lit("["), F.col("element_index").cast("string"), F.lit("] before: "), F.coalesce("text_before", F.lit("")), F.lit("; words: "), F.col("text"), F.lit(" [end of item]\n"))
    lines = F.sort_array(F.collect_list(F.struct("element_index", line.alias("t"))))
    return features.groupBy("source_identifier").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "").alias("data"))


def meta_parts(items: list[Item]) -> tuple[str, str, str]:
    """Introduction, task and sample for what a column's header says."""
    task = "".join(f"{k}) {m.title}.{f' Note: {m.info}.' if m.info.strip() else ''} {possible_values(m.type, list(m.values))}\n" for k, m in enumerate(items, 1))
    return "One column of a table is described below.", f"Tell from the texts:\n{task}", "Reply with the number of each question and one allowed value, for example:\n" + "".join(f"{k}) {example(m.type, list(m.values), m.example)}\n" for k, m in enumerate(items, 1))


def meta_data() -> Column:
    """The texts around a column that a meta prompt shows (columns as meta_features() names them)."""
    return F.concat(F.lit("Column: "), F.col("col_idx").cast("string"), F.lit('\nHeader above it: "'), F.col("top_column_all"), F.lit('"\nRows without numbers: '), F.col("li_and_values"), F.lit('\nAbove the captions: "'), F.col("top_li_reworked"), F.lit('"\nBefore the table: "'), F.coalesce("before", F.lit("")), F.lit('"\n'))


def mapping_parts(mapping: Mapping) -> tuple[str, str, str]:
    """Introduction, task and sample for sorting rows into buckets."""
    ids = [b.id for b in mapping.buckets]
    listed = "".join(f"{b.id}: {b.caption}{f' ({b.description})' if b.description and b.description.strip() else ''}\n" for b in sorted(mapping.buckets, key=lambda b: b.order))
    sample = json.dumps({i: [f"LI{k}"] for k, i in enumerate(ids[:2])} | {i: [] for i in ids[2:]})
    return "Sort the rows of a table into buckets, each row into one.", f"Buckets:\n{listed}", f"Reply with a JSON object that lists for each bucket the ids of its rows, such as {sample}"


def mapping_data(items: Column) -> Column:
    """A table's rows (caption, values) as JSON: the id and caption of each, then its values."""
    return F.to_json(F.transform(items, lambda x, i: F.concat(F.array(F.concat(F.lit("LI"), i.cast("string"), F.lit(": "), x["caption"])), F.transform(x["values"], lambda v: F.coalesce(v.cast("string"), F.lit("None"))))))
