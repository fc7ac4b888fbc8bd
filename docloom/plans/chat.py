"""Conversations about documents: what a message refers to, what of it is shown, and replies by one model or the first that answers.

messages: conv_id, turn, text, references (array of source_identifier, element_index). elements as elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import cut
from docloom.operators.neighbours import allowed, capped, to_string
from docloom.operators.retrieval import split_tokens
from docloom.plans import prompts as P
from docloom.plans.models import ClientFactory, Spec, ask_with_fallback, asking
from docloom.schemas import MAX_ELEMENTS

TAIL = 500


def references(messages: DataFrame, current_only: bool = False) -> DataFrame:
    """What the last message of each conversation refers to, or all of them together, each once: conv_id, source_identifier, element_index."""
    last = messages.withColumn("_last", F.max("turn").over(Window.partitionBy("conv_id")))
    rows = last.where(F.col("turn") == F.col("_last")) if current_only else last
    return rows.select("conv_id", F.explode("references").alias("_r")).select("conv_id", "_r.source_identifier", "_r.element_index").distinct()


def shown_documents(refs: DataFrame, elements: DataFrame, most_tokens: int, show_index: bool = False, most_elements: int = MAX_ELEMENTS) -> DataFrame:
    """One row a conversation: ``data``, its documents' texts between marks, cut to equal shares if they are too long together."""
    pairs = refs.select("conv_id", F.col("source_identifier").alias("_doc"), "element_index")
    mine = elements.join(pairs.select("conv_id", "_doc").distinct(), F.col("source_identifier") == F.col("_doc")).withColumn("_src", F.col("source_identifier"))
    key = F.concat_ws("|", "conv_id", "_src")
    mine = mine.withColumn("source_identifier", key).drop("_doc")
    named = pairs.select(F.concat_ws("|", "conv_id", "_doc").alias("source_identifier"), "element_index")
    kept = capped(allowed(mine, named), most_elements)
    text = to_string(kept.select("source_identifier", "element_index", "text"), show_index)
    text = text.join(kept.select("source_identifier", "conv_id", "_src").distinct(), "source_identifier")
    docs = text.withColumn("doc_order", F.row_number().over(Window.partitionBy("conv_id").orderBy("_src")) - 1).withColumn("request", F.col("conv_id")).withColumn("tokens", P.tokenize(F.col("content")))
    shares = split_tokens(docs, most_tokens)
    one = F.concat(F.lit("[START OF DOCUMENT with index "), F.col("doc_order").cast("string"), F.lit("]\n"), F.array_join("kept", ""), F.lit("[END OF DOCUMENT with index "), F.col("doc_order").cast("string"), F.lit("]\n\n"))
    return shares.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_order", one.alias("t")))), lambda x: x["t"]), "").alias("data"))


def run_chat(messages: DataFrame, elements: DataFrame, models: list[tuple[Spec, ClientFactory]], most_tokens: int, current_only: bool = False, show_index: bool = False) -> DataFrame:
    """A reply to each conversation's last message: conv_id, text, author (the model), cost. Conversations that no model answers have none."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = messages.withColumn("_past", F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    last = turns.where("_n = 1").select("conv_id", "text", "_past")
    data = shown_documents(references(messages, current_only), elements, most_tokens, show_index)
    none = F.lit(None).cast("string")
    told = P.instructions(none, F.col("text"), none, none)
    full = last.join(data, "conv_id", "left").withColumn("_p", P.truncated(P.history(F.col("_past")), told, F.coalesce("data", F.lit("")), min(s.max_tokens for s, _ in models)))
    asked = ask_with_fallback(full.select("conv_id", F.col("_p.prompt").alias("prompt")), models)
    return asked.where("reply is not null").select("conv_id", F.col("reply").alias("text"), F.col("model").alias("author"), "cost")


def page_by_page(pages: DataFrame, spec: Spec, factory: ClientFactory, merge: Callable | None = None) -> DataFrame:
    """Replies to conversations whose pages (conv_id, page_order, prompt, image) are shown one after the other, each with the end of the reply before it; merged to one: conv_id, text.

    Pages of a conversation wait for each other; conversations don't. ``merge`` makes one column of the array of replies; by default JSON is merged.
    """
    from docloom.functions.json_repair import merge_pieces

    def run(table: pa.Table) -> pa.Table:
        one = asking(spec, factory)
        rows = sorted(table.to_pylist(), key=lambda r: r["page_order"])
        replies: list[str] = []
        for k, r in enumerate(rows):
            told = f"Page {k + 1} of {len(rows)}." + (f" The reply so far ends with: {replies[-1][-TAIL:]}" if replies else "")
            got = one(f"{told}\n{r['prompt']}", (r["image"] or b"",))
            replies.append(got if isinstance(got, str) else got.text)
        return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.string()), "replies": pa.array([replies], pa.list_(pa.string()))})

    asked = pages.select(F.col("conv_id").cast("string").alias("conv_id"), "page_order", "prompt", F.col("image").cast("binary").alias("image")).groupBy("conv_id").applyInArrow(run, "conv_id string, replies array<string>")
    asked = cut(asked)
    return asked.select("conv_id", (merge or merge_pieces)(F.col("replies")).alias("text"))
