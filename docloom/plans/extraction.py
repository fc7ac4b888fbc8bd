"""Whole runs: a template's questions and tables over documents, by one model or several.

Three branches that don't wait for each other's rows: answers; columns with their meta values; buckets of rows. Elements are
prepared once, all questions of a model are asked together, and replies are written before they are parsed, so that
no call is repeated. The model "assigned" takes what is given as true in place of replies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.checkpoints import cut
from docloom.functions.text import meta_key
from docloom.operators import retrieval
from docloom.operators.detection import assemble, output_columns
from docloom.operators.evaluation import Comparators, evaluate
from docloom.operators.mapping import kv_identifier, li_identifier
from docloom.operators.meta_features import meta_features
from docloom.operators.neighbours import chunks, surrounding_text, text_before, words_around
from docloom.operators.tables import structure, text, text_with_numbers, text_without_numbers
from docloom.plans import prompts as P
from docloom.plans import replies as R
from docloom.plans.models import ASSIGNED, ClientFactory, Registry, Spec, ask
from docloom.plans.template import Item, Template, create_template
from docloom.sources.tabular import write_dataset


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with structured tables: ``text`` and ``text_simple`` of tables come from their cells."""
    out = structure(elements)
    is_table = F.col("el_type") == "table"
    return out.withColumn("text_simple", F.when(is_table, text_without_numbers()).otherwise(F.col("text"))).withColumn("_llm", F.when(is_table, text_with_numbers()).otherwise(F.col("text"))).withColumn("text", F.when(is_table, text()).otherwise(F.col("text")))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Results:
    answers: DataFrame | None
    columns: DataFrame | None
    buckets: DataFrame | None


class Extraction:
    """A template with the clients of its models."""

    def __init__(self, spark: SparkSession, template: Template, registry: Registry, top_k: int = retrieval.TOP_K, encoder=retrieval.hashed_vector, truth_answers: DataFrame | None = None, truth_locations: DataFrame | None = None, store: str | None = None) -> None:
        """truth_answers, truth_locations: what the model "assigned" answers; store: a folder in which replies are kept from run to run."""
        self.spark, self.template, self.registry, self.top_k, self.encoder = spark, template, registry, top_k, encoder
        self.truth_answers, self.truth_locations, self.store = truth_answers, truth_locations, store

    def _client(self, model_id: str) -> tuple[Spec, ClientFactory]:
        spec = self.registry.spec(model_id)
        return spec, self.registry.factory(spec)

    def _ask(self, prompts: DataFrame, model_id: str) -> DataFrame:
        return ask(prompts, *self._client(model_id), store=self.store)

    def _prompted(self, docs: DataFrame, parts: tuple[str, str, str], most: int) -> DataFrame:
        """docs with ``data`` as prompts within a budget."""
        intro, task, sample = map(F.lit, parts)
        told = P.instructions(intro, task, F.lit(None).cast("string"), sample)
        return docs.withColumn("_p", P.truncated(F.lit(""), told, F.col("data"), most)).withColumn("prompt", F.col("_p.prompt")).drop("_p", "data")

    def _retrieved(self, elements: DataFrame, title: str, keywords: str | None, search: str, tables_only: bool) -> DataFrame:
        """source_identifier, element_index and rank of the elements to show."""
        if search == "start":
            return retrieval.from_start(elements, tables_only).select("source_identifier", "element_index", F.col("element_index").alias("rank"))
        query = self.spark.createDataFrame([("q", retrieval.query_text(title, keywords))], "query_id string, query_text string")
        return retrieval.nearest_elements(chunks(elements, tables_only=tables_only), query, self.top_k, self.encoder).drop("query_id")

    def question_prompts(self, elements: DataFrame, item: Item, most: int) -> DataFrame:
        shown = surrounding_text(elements.withColumn("text", F.col("_llm")).select("source_identifier", "element_index", "el_type", "text"))
        shown = shown.join(self._retrieved(elements, item.title, item.keywords, item.search, False), ["source_identifier", "element_index"])
        return self._prompted(P.fragments(shown), P.question_parts(item), most)

    def answers(self, docs: DataFrame, elements: DataFrame | None = None) -> DataFrame | None:
        elements, out = cut(prepared(docs)) if elements is None else elements, None
        for model_id, items in self.template.models().items():
            if model_id == ASSIGNED:
                if self.truth_answers is None:
                    raise ValueError("no true answers are given")
                parts = [R.assigned_answers(self.truth_answers.where(F.col("class_id").isin([i.id for i in items])))]
            elif model_id in self.registry.custom:
                parts = [self.registry.custom[model_id].answers(elements, item) for item in items]
            else:
                most = self._client(model_id)[0].max_tokens
                prompts = _union([self.question_prompts(elements, item, most).withColumn("class_id", F.lit(item.id)) for item in items])
                replies = self._ask(prompts, model_id).withColumn("model", F.lit(model_id))
                parts = [R.answers(replies.where(F.col("class_id") == item.id), item, elements) for item in items]
            got = _union(parts)
            out = got if out is None else out.unionByName(got)
        return out

    def locations(self, elements: DataFrame) -> DataFrame | None:
        parts = []
        for t in self.template.tables:
            if t.model == ASSIGNED:
                if self.truth_locations is None:
                    raise ValueError("no true locations are given")
                parts.append(R.assigned_locations(self.truth_locations.where(F.col("detected_class") == t.id)))
                continue
            if t.model in self.registry.custom:
                parts.append(self.registry.custom[t.model].locations(elements, t))
                continue
            shown = words_around(elements.select("source_identifier", "element_index", "el_type", "text", "text_simple"), number="NUMBER")
            shown = shown.where(F.col("el_type") == "table").join(self._retrieved(elements, t.title, t.keywords, t.search, True), ["source_identifier", "element_index"])
            data = P.detection_data(shown.withColumn("text", F.col("text_simple")))
            replies = self._ask(self._prompted(data, P.detection_parts(t), self._client(t.model)[0].max_tokens), t.model).withColumn("model", F.lit(t.model))
            parts.append(R.locations(replies, t.id, elements))
        return _union(parts) if parts else None

    def columns(self, docs: DataFrame, elements: DataFrame | None = None) -> DataFrame | None:
        if not self.template.tables:
            return None
        elements = cut(prepared(docs)) if elements is None else elements
        groups = assemble(self.locations(elements), elements, self.template.detection())
        cols = output_columns(groups, elements.where(F.col("el_type") == "table"))
        named = cols.withColumn("li_identifier", li_identifier(F.transform("pairs", lambda p: p["line_item"]))).withColumn("kv_identifier", kv_identifier(F.col("pairs")))
        named = cut(named.withColumn("column_id", F.concat_ws("|", "source_identifier", "group_id", "col_idx")))
        empty = named.withColumn("meta", F.array().cast("array<struct<class_id:string,class_value:string,prob:double>>"))
        out = None
        for t in self.template.tables:
            mine = (empty if not t.meta or (t.meta[0].model or t.model) == ASSIGNED else self._with_meta(named, elements, t)).where(F.col("detected_class") == t.id)
            out = mine if out is None else out.unionByName(mine)
        return out

    def _with_meta(self, cols: DataFrame, elements: DataFrame, table) -> DataFrame:
        metas = list(table.meta)
        place = ["source_identifier", "element_index"]
        before = text_before(elements.select(*place, "el_type", "text"), 200).select(*place, F.coalesce("text_before", F.lit("")).alias("_before"))
        tables = elements.select(*place, "grid", "numeric_cols", "numeric_rows", "header_rows", "other_rows")
        shown = meta_features(cols.where(F.col("detected_class") == table.id).join(tables, place).join(before, place), before_col="_before")
        data = shown.select("column_id", P.meta_data().alias("data"))
        spec = self._client(metas[0].model or table.model)[0]
        values = R.meta_values(self._ask(self._prompted(data, P.meta_parts(metas), spec.max_tokens), spec.model_id), metas)
        lists = values.groupBy("column_id").agg(F.sort_array(F.collect_list(F.struct("class_id", "class_value", "prob"))).alias("meta"))
        return cols.join(lists, "column_id", "left").withColumn("meta", F.coalesce("meta", F.array().cast("array<struct<class_id:string,class_value:string,prob:double>>")))

    def buckets(self, columns: DataFrame) -> DataFrame | None:
        """Buckets of line items, asked once for each class and sequence of items."""
        out = None
        for t in self.template.tables:
            if t.mapping is None or (t.mapping_model or t.model) == ASSIGNED:
                continue
            mine = columns.where(F.col("detected_class") == t.id)
            tables = mine.groupBy("li_identifier").agg(F.min_by("pairs", F.struct("source_identifier", "group_id", "col_idx")).alias("_p"))
            rows = F.transform("_p", lambda p: F.struct(p["line_item"].alias("caption"), F.array(p["value"]).alias("values")))
            data = tables.select(F.col("li_identifier").alias("table_id"), P.mapping_data(rows).alias("data"))
            model = t.mapping_model or t.model
            replies = self._ask(self._prompted(data, P.mapping_parts(t.mapping), self._client(model)[0].max_tokens), model)
            items = tables.select(F.col("li_identifier").alias("table_id"), F.posexplode("_p").alias("li_idx", "_x")).drop("_x")
            got = R.bucket_choices(replies, [b.id for b in t.mapping.buckets], items).withColumn("schema_id", F.lit(t.mapping.id)).withColumnRenamed("table_id", "li_identifier")
            out = got if out is None else out.unionByName(got)
        return out

    def run(self, docs: DataFrame) -> Results:
        elements = cut(prepared(docs))
        columns = self.columns(docs, elements)
        return Results(self.answers(docs, elements) if self.template.questions else None, columns, self.buckets(columns) if columns is not None else None)


def run_with_single_model(spark: SparkSession, docs: DataFrame, template: Template, spec: Spec, factory: ClientFactory) -> Results:
    return Extraction(spark, template.with_model(spec.model_id), Registry([spec], {spec.kind: factory})).run(docs)


def run_custom_prompt(spark: SparkSession, docs: DataFrame, question: str, spec: Spec, factory: ClientFactory) -> DataFrame:
    """Answers to one free question as the model gives them, where the reply is a JSON object with an answer."""
    template = create_template([Item(question, "text")])
    return run_with_single_model(spark, docs, template, spec, factory).answers


def dataset_rows(extraction: Extraction, docs: DataFrame, truth: DataFrame, most: int = 4000) -> DataFrame:
    """Prompts and true replies of each document and question that has a truth (source_identifier, class_id, class_value, meta, sources)."""
    elements, out = prepared(docs), None
    for item in extraction.template.questions:
        mine = truth.where(F.col("class_id") == item.id).groupBy("source_identifier").agg(F.sort_array(F.collect_list(F.struct("class_value", "meta", "sources"))).alias("_t"))
        rows = extraction.question_prompts(elements, item, most).join(mine, "source_identifier")
        rows = rows.select("source_identifier", F.lit(extraction.template.id).alias("template_id"), F.lit(item.id).alias("element_identifier"), F.col("prompt").alias("FEATURE_full_prompt"), _raw_truth(item).alias("ANSWER_assigned"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _raw_truth(item: Item) -> Column:
    """The truth (array of class_value, meta, sources) as a model's JSON reply."""
    from docloom.functions.answers import to_raw

    def one(t: Column) -> Column:
        meta = [F.coalesce(F.try_element_at(F.transform(F.filter(t["meta"], lambda m: m["class_id"] == m_.id), lambda m: m["class_value"]), F.lit(1)), F.lit("n/a")) for m_ in item.meta]
        keys = [F.lit(P.MAIN), *(F.lit(m.id) for m in item.meta)]
        values = [to_raw(F.lit(item.type), t["class_value"]), *(to_raw(F.lit(m.type), v) for m, v in zip(item.meta, meta))]
        return F.map_from_arrays(F.array(*keys), F.array(*values))

    sources = F.to_json(F.get("_t", F.lit(0))["sources"])
    if item.meta:
        return F.concat(F.lit('{"answers": '), F.to_json(F.transform("_t", one)), F.lit(', "sources": '), sources, F.lit("}"))
    return F.concat(F.regexp_replace(F.to_json(one(F.get("_t", F.lit(0)))), r"\}$", ""), F.lit(', "sources": '), sources, F.lit("}"))


def with_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Dataset rows with ``_images``: of the pages that FEATURE_page_indexes lists ("0|2") those that images (source_identifier, page_idx, data: bytes) has, in the order listed."""
    pages = rows.select("source_identifier", "element_identifier", F.posexplode(F.split("FEATURE_page_indexes", r"\|")).alias("_at", "_page")).withColumn("page_idx", F.col("_page").try_cast("int"))
    shown = pages.join(images, ["source_identifier", "page_idx"]).groupBy("source_identifier", "element_identifier").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "data"))), lambda x: x["data"]).alias("_images"))
    return rows.join(shown, ["source_identifier", "element_identifier"], "left").withColumn("_images", F.coalesce("_images", F.array().cast("array<binary>")))


def evaluate_models(rows: DataFrame, template: Template, registry: Registry, models: list[str], use_saved: bool = False, retry_na: bool = False, compare: Comparators | None = None, exclude_meta_keys: list[str] | None = None, images: DataFrame | None = None, write_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of models on dataset rows, and the rows with the models' replies.

    Saved replies are taken where there are any (and they aren't "n/a", with retry_na). compare: by question, what says whether two values are
    the same; exclude_meta_keys: meta items that don't tell answers apart; images: pages for models that take them; write_to: a folder for the rows with
    replies, as dataset files. A row of a question that the template lacks fails the job.
    """
    if not models:
        raise ValueError("no models to evaluate")
    known = {q.id: q for q in template.questions}
    named = F.col("element_identifier")
    answered = rows.withColumn("element_identifier", F.when(named.isin(list(known)), named).otherwise(F.raise_error(F.concat(F.lit("no such question: "), F.coalesce(named, F.lit("null"))))))
    if images is not None:
        answered = with_images(answered, images)
    for model in models:
        spec, col = registry.spec(model), f"ANSWER_{model}"
        if spec.kind == "custom" and spec.kind not in registry.factories:
            raise ValueError(f"no client for {model}")
        saved = F.col(col) if use_saved and col in rows.columns else F.lit(None).cast("string")
        good = (F.trim(saved) != "") & ~(F.lit(retry_na) & (saved == "n/a"))
        with_saved = answered.withColumn("_saved", F.when(good, saved)).withColumn("_ask", F.when(F.col("_saved").isNull(), F.col("FEATURE_full_prompt")))
        asked = ask(with_saved, spec, registry.factory(spec), "_ask", images_col="_images" if images is not None else None)
        answered = cut(asked.withColumn(col, F.coalesce("_saved", "reply")).drop("_saved", "_ask", "reply", "cost"))
    answered = answered.drop("_images")
    if write_to is not None:
        write_dataset(answered, write_to)
    replies = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"ANSWER_{m}").alias("reply")) for m in [*models, ASSIGNED]))
    long = cut(answered.select("source_identifier", "element_identifier", F.explode(replies).alias("_r")).select("source_identifier", "element_identifier", "_r.*"))
    parts = [R.answers(long.where(F.col("element_identifier") == item.id), item).withColumn("seq", F.lit(k << 32) + F.col("seq")) for k, item in enumerate(known.values())]
    got = _union(parts)
    keys = [meta_key(F.col("meta"), exclude_meta_keys).alias("key"), *([meta_key(F.col("meta")).alias("full_key")] if exclude_meta_keys else [])]
    return evaluate(cut(got.select(F.col("source_identifier").alias("source"), "model", "class_id", *keys, F.col("class_value").alias("value"), "seq", F.size("meta").alias("meta_n"))), compare), answered
