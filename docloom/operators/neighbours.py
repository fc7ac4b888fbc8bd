"""Operators over the order of elements in a document: distances, texts around, neighbours, chunks.

elements: source_identifier, element_index, el_type, text. Everything is one window a document; frames are sums, lags or bounded lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docloom.functions.text import clean_for_vectors, composition, words
from docloom.schemas import CHUNK_CHARS, MAX_ELEMENTS, TABLES_AROUND, WORDS_AROUND

DOC, IDX = "source_identifier", "element_index"


def in_order() -> WindowSpec:
    """A document's elements in their order."""
    return Window.partitionBy(DOC).orderBy(IDX)


def earlier() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def later() -> WindowSpec:
    """What comes after an element, the last of it first: a frame that grows row by row, where one up to the end would be gone through again for each row."""
    return Window.partitionBy(DOC).orderBy(F.desc(IDX)).rowsBetween(Window.unboundedPreceding, -1)


def text_before_length(include_tables: bool = False) -> Column:
    """Characters of text before an element; distances are differences of it."""
    counted = F.length("text") if include_tables else F.when(F.col("el_type") == "text", F.length("text"))
    return F.coalesce(F.sum(F.coalesce(counted, F.lit(0))).over(earlier()), F.lit(0))


def distances(elements: DataFrame, pairs: DataFrame, include_tables: bool = False, exclude_col: str | None = None) -> DataFrame:
    """pairs (source_identifier, a, b) with ``distance``: characters strictly between both, less those of the elements listed in ``exclude_col``."""
    e = elements.withColumn("_before", text_before_length(include_tables)).withColumn("_own", F.coalesce(F.length("text") if include_tables else F.when(F.col("el_type") == "text", F.length("text")), F.lit(0)))
    e = e.select(F.col(DOC).alias("_doc"), F.col(IDX).alias("_i"), "_before", "_own")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    x, y = e.alias("x"), e.alias("y")
    out = pairs.withColumn("_low", low).withColumn("_high", high)
    out = out.join(x, (F.col(DOC) == F.col("x._doc")) & (F.col("_low") == F.col("x._i"))).join(y, (F.col(DOC) == F.col("y._doc")) & (F.col("_high") == F.col("y._i")))
    out = out.withColumn("distance", F.when(F.col("_low") == F.col("_high"), F.lit(0)).otherwise(F.col("y._before") - F.col("x._before") - F.col("x._own")))
    keep = [*pairs.columns, "distance"]
    if exclude_col is None:
        return out.select(*keep)
    out = out.select(*keep, "_low", "_high")
    inner = out.withColumn("_x", F.explode(F.array_distinct(exclude_col))).where("_x > _low and _x < _high").join(e, (F.col(DOC) == F.col("_doc")) & (F.col("_x") == F.col("_i")))
    less = inner.groupBy(DOC, "a", "b").agg(F.sum("_own").alias("_less"))
    return out.join(less, [DOC, "a", "b"], "left").select(*[c for c in pairs.columns], (F.col("distance") - F.coalesce("_less", F.lit(0))).alias("distance"))


def text_before(elements: DataFrame, limit: int | None = None) -> DataFrame:
    """elements with ``text_before``: the texts since the last element that is none, each with a blank behind it.

    Null where the document's start or ``limit`` characters come first: only a stop at another kind of element gives text.
    """
    group = F.sum((F.col("el_type") != "text").cast("int")).over(in_order())
    e = elements.withColumn("_g", group)
    prior = F.lag("_g").over(in_order())
    e = e.withColumn("_run", prior)
    # The elements with one such run before them are its texts and the element that ends it.
    run = Window.partitionBy(DOC, "_run").orderBy(IDX).rowsBetween(Window.unboundedPreceding, -1)
    if limit is not None:
        # Where the limit isn't reached, all texts of the run begin less than so many characters before.
        e = e.withColumn("_pos", F.coalesce(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(run), F.lit(0)))
        run = Window.partitionBy(DOC, "_run").orderBy("_pos").rangeBetween(-limit, -1)
    joined = F.array_join(F.collect_list(F.concat(F.coalesce("text", F.lit("")), F.lit(" "))).over(run), "")
    ok = F.col("_run") >= 1
    if limit is not None:
        ok = ok & (F.col("_pos") < limit)
    return e.withColumn("text_before", F.when(ok, joined)).drop("_g", "_run", "_pos")


def _taken(items: Column, limit: int) -> Column:
    """The first items until the words of those taken reach the limit."""
    zero = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("n"))
    return F.aggregate(items, zero, lambda acc, x: F.when(acc["n"] >= limit, acc).otherwise(F.struct(F.concat(acc["t"], F.array(x["t"])).alias("t"), (acc["n"] + x["n"]).alias("n"))))["t"]


def words_around(elements: DataFrame, limit: int = WORDS_AROUND, number: str = "xnumberx") -> DataFrame:
    """elements with ``text_before`` and ``text_after``: cleaned texts nearest to the element until they have ``limit`` words, the nearest first before it and last behind it.

    Frames reach over as many texts with words as there may be words, and the texts without any between them.
    """
    clean = clean_for_vectors(F.col("text"), drop_special=True, drop_numbers=True, number=number)
    is_text = F.col("el_type") == "text"
    e = elements.withColumn("_item", F.when(is_text, F.struct(F.col(IDX).alias("i"), clean.alias("t"), F.size(words(F.coalesce("text", F.lit("")))).alias("n"))))
    e = e.withColumn("_worded", F.sum(F.coalesce((F.col("_item.n") > 0).cast("int"), F.lit(0))).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(DOC).orderBy("_worded")
    before = F.filter(F.collect_list("_item").over(near.rangeBetween(-limit, 0)), lambda x: x["i"] < F.col(IDX))
    after = F.filter(F.collect_list("_item").over(near.rangeBetween(0, limit)), lambda x: x["i"] > F.col(IDX))
    e = e.withColumn("_before", F.sort_array(before, asc=False)).withColumn("_after", F.sort_array(after))
    e = e.withColumn("text_before", F.trim(F.array_join(_taken(F.col("_before"), limit), " "))).withColumn("text_after", F.trim(F.array_join(F.reverse(_taken(F.col("_after"), limit)), " ")))
    return e.drop("_item", "_worded", "_before", "_after")


def tables_around(elements: DataFrame, limit: int = TABLES_AROUND, number: str = "xnumberx") -> DataFrame:
    """One row an element: distance to, share of digits, words and texts of the next tables on both sides; 0 and "" where there are fewer.

    Tables carry ``text`` (all cells) and ``text_simple``. As in the original, the first table is given even for a limit of 0.
    """
    e = elements.withColumn("_at", text_before_length()).withColumn("_own", F.coalesce(F.when(F.col("el_type") == "text", F.length("text")), F.lit(0)))
    body = F.struct(
        F.col(IDX).alias("i"),
        F.col("_at").alias("at"),
        composition(F.col("text"))["numbers"].alias("percent_numbers"),
        F.size(words(F.col("text"))).alias("num_words"),
        clean_for_vectors(F.col("text"), drop_special=True, drop_numbers=True, number=number).alias("text_clean"),
        F.col("text_simple").alias("text_simple"),
    )
    # Each table knows the next ones of its kind; each element takes over the list of the table next to it.
    n = max(limit, 1)
    among = Window.partitionBy(DOC, "el_type").orderBy(IDX)
    e = e.withColumn("_t", body)
    for side, shift in (("_b", F.lag), ("_a", F.lead)):
        e = e.withColumn(side, F.when(F.col("el_type") == "table", F.array(F.col("_t"), *(shift("_t", k).over(among) for k in range(1, n)))))
    e = e.withColumn("_b", F.last("_b", ignorenulls=True).over(earlier())).withColumn("_a", F.last("_a", ignorenulls=True).over(later()))
    out = []
    for side, col in (("before", "_b"), ("after", "_a")):
        for k in range(max(limit, 1)):
            t = F.get(col, F.lit(k))
            gap = F.col("_at") - t["at"] if side == "before" else t["at"] - F.col("_at") - F.col("_own")
            out += [F.coalesce(gap, F.lit(0)).alias(f"text_distance_{side}_{k + 1}"), F.coalesce(t["percent_numbers"], F.lit(0.0)).alias(f"percent_numbers_{side}_{k + 1}"), F.coalesce(t["num_words"], F.lit(0)).alias(f"num_words_{side}_{k + 1}")]
            out += [F.coalesce(t[f], F.lit("")).alias(f"{f}_{side}_{k + 1}") for f in ("text_clean", "text_simple")]
    return e.select(DOC, IDX, *out)


def base_features(number: str = "xnumberx") -> list[Column]:
    """What an element is by itself."""
    t = F.coalesce("text", F.lit(""))
    return [F.col("el_type").alias("type"), F.coalesce("text_simple", "text").alias("text"), clean_for_vectors(t, drop_special=True, drop_numbers=True, number=number).alias("text_clean"), F.size(words(t)).alias("num_words"), composition(t)["numbers"].alias("percent_numbers")]


def location_features(elements: DataFrame, limit_words: int = WORDS_AROUND, limit_tables: int = TABLES_AROUND, number: str = "xnumberx") -> DataFrame:
    """One row an element: its own features, the texts and the tables around it."""
    own = elements.select(DOC, IDX, *base_features(number))
    texts = words_around(elements, limit_words, number).select(DOC, IDX, "text_before", "text_after")
    return own.join(texts, [DOC, IDX]).join(tables_around(elements, limit_tables, number), [DOC, IDX])


def caption_neighbours(items: DataFrame, *table: str, number: str = "[number]") -> DataFrame:
    """Line items (li_idx, caption) with ``item_before``, ``item_after`` ("" at the ends) and ``all_items``, cleaned."""
    clean = items.withColumn("_c", clean_for_vectors(F.col("caption"), number=number))
    w = Window.partitionBy(*table).orderBy("li_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return clean.withColumn("item_before", F.lag("_c", 1, "").over(w)).withColumn("item_after", F.lead("_c", 1, "").over(w)).withColumn("all_items", F.array_join(F.collect_list("_c").over(whole), ", ")).withColumnRenamed("_c", "caption_cleaned")


def surrounding_text(elements: DataFrame, reach: int = 3) -> DataFrame:
    """elements with ``llm_text``: of a table its text behind that of up to ``reach`` elements before it, back to the last table; of others their own."""
    near = F.collect_list(F.struct(F.coalesce("text", F.lit("")).alias("t"), (F.col("el_type") == "table").alias("k"))).over(in_order().rowsBetween(-reach, -1))
    last = F.array_max(F.filter(F.transform(near, lambda x, i: F.when(x["k"], i + 1)), lambda i: i.isNotNull()))
    kept = F.transform(F.slice(near, F.coalesce(last, F.lit(0)) + 1, reach), lambda x: x["t"])
    full = F.concat(F.lit("Table element - Text before table: "), F.array_join(kept, "\n"), F.lit("; "), F.col("text"))
    return elements.withColumn("_near", full).withColumn("llm_text", F.when(F.col("el_type") == "table", F.col("_near")).otherwise(F.coalesce("text", F.lit("")))).drop("_near")


def to_string(elements: DataFrame, show_index: bool = False) -> DataFrame:
    """One row a document: ``content``, its elements' texts by lines, with their numbers if wanted."""
    line = F.coalesce("text", F.lit(""))
    line = F.concat(F.lit("[chunk "), F.col(IDX).cast("string"), F.lit("] "), line) if show_index else line
    return elements.groupBy(DOC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(IDX, line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))


def chunks(elements: DataFrame, limit: int = CHUNK_CHARS, tables_only: bool = False) -> DataFrame:
    """One row a chunk: chunk_id, elements, text. Texts are packed in order until they have more than ``limit`` characters; a table is a chunk of its own and doesn't end one; figures are left out."""
    keep = elements.where(F.col("el_type") == "table") if tables_only else elements.where(F.col("el_type").isin("text", "table"))
    doc = keep.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct(F.col(IDX).alias("i"), (F.col("el_type") == "table").alias("k"), F.coalesce("text", F.lit("")).alias("t")))).alias("_e"))
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("next"), F.lit(-1).alias("open"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["k"] | (acc["open"] < 0)
        mine = F.when(fresh, acc["next"]).otherwise(acc["open"])
        size = F.when(x["k"], acc["size"]).otherwise(F.when(acc["open"] < 0, F.lit(0)).otherwise(acc["size"]) + F.length(x["t"]))
        full = ~x["k"] & (size > limit)
        return F.struct(
            F.when(full, F.lit(0)).otherwise(size).alias("size"),
            (acc["next"] + fresh.cast("int")).alias("next"),
            F.when(x["k"], acc["open"]).when(full, F.lit(-1)).otherwise(mine).alias("open"),
            F.concat(acc["ids"], F.array(mine)).alias("ids"),
        )

    out = doc.withColumn("_c", F.aggregate("_e", zero, step)["ids"]).select(DOC, F.explode(F.arrays_zip("_e", "_c")).alias("_z"))
    out = out.groupBy(DOC, F.col("_z._c").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("_z._e.i").alias("i"), F.col("_z._e.t").alias("t")))).alias("_l"))
    return out.select(DOC, "chunk_id", F.transform("_l", lambda x: x["i"]).alias("elements"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n ").alias("text"))


def nearest_table(elements: DataFrame) -> DataFrame:
    """elements with ``nearest_table``: the index of the closest other table, the earlier of two; an as-of join by windows alone."""
    at = F.when(F.col("el_type") == "table", F.col(IDX))
    back = F.last(at, ignorenulls=True).over(earlier())
    forth = F.last(at, ignorenulls=True).over(later())
    e = elements.withColumn("_b", back).withColumn("_f", forth)
    return e.withColumn("nearest_table", F.when(F.col("_f").isNull() | (F.col(IDX) - F.col("_b") <= F.col("_f") - F.col(IDX)), F.col("_b")).otherwise(F.col("_f"))).drop("_b", "_f")


def allowed(elements: DataFrame, references: DataFrame) -> DataFrame:
    """The elements that references (source_identifier, element_index) name; all of a document of which one names the whole (null index)."""
    r = references.select(F.col(DOC).alias("_doc"), F.col(IDX).alias("_i")).distinct()
    named = elements.join(r, (F.col(DOC) == F.col("_doc")) & (F.col(IDX) == F.col("_i")), "left_semi")
    whole = r.where("_i is null")
    rest = named.join(whole, F.col(DOC) == F.col("_doc"), "left_anti")
    return rest.unionByName(elements.join(whole, F.col(DOC) == F.col("_doc"), "left_semi"))


def capped(elements: DataFrame, most: int = MAX_ELEMENTS) -> DataFrame:
    """The first ``most`` elements of each document, a limit of what is loaded for a chat."""
    return elements.withColumn("_n", F.row_number().over(in_order())).where(F.col("_n") <= most).drop("_n")
