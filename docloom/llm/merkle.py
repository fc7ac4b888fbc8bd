"""Merkle trees as columns, and document fingerprints made of them.

A document's sections are what empty lines separate, a section's paragraphs are its lines; nothing is dropped, so two
documents have one root exactly if they have one text. Leaves, inner nodes, sections and documents are hashed with
different first letters. An odd node of a level moves up as it is.

Defined cases: a null text has a null root and no parts; the empty text is one section of one empty paragraph; rows
with one id are fingerprinted each; for edits, of several rows with one id (or without one) those with equal roots are
settled first and the others paired in the order of their texts, and a row that only one side has is reported as added or removed as a whole, with or without an id; a
text that became null has all its paragraphs removed; an empty table's rows are all added or removed; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, join_checked, size_of


def _up(level: Column) -> Column:
    """The next level of a tree."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.coalesce(F.sha2(F.concat(F.lit("n"), F.get(level, 2 * i), F.get(level, 2 * i + 1)), 256), F.get(level, 2 * i)))


def _steps(n: Column) -> Column:
    """One entry for each level above n leaves."""
    return F.when(n > 1, F.sequence(F.lit(1), F.length(F.bin((n - 1).cast("bigint"))))).otherwise(F.array().cast("array<int>"))


def root(leaves: Column) -> Column:
    """The root over an array of hashes, null for an empty one."""
    return F.get(F.aggregate(_steps(F.size(leaves)), leaves, lambda level, _: _up(level)), 0)


def levels(leaves: Column) -> Column:
    """All levels of the tree, the leaves first."""
    return F.aggregate(_steps(F.size(leaves)), F.array(leaves), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))


def descend(a: Column, b: Column) -> Column:
    """Numbers of the leaves in which two trees, given as levels, differ. Only below differing nodes anything is compared.

    A leaf that only one tree has differs.
    """
    top = F.greatest(F.size(a), F.size(b)) - 1

    def differ(k: Column, j: Column) -> Column:
        return ~F.get(F.get(a, k), j).eqNullSafe(F.get(F.get(b, k), j))

    down = F.when(top > 0, F.sequence(top - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.filter(F.array(F.lit(0)), lambda j: differ(top, j))
    return F.aggregate(down, start, lambda acc, k: F.filter(F.flatten(F.transform(acc, lambda i: F.array(2 * i, 2 * i + 1))), lambda j: differ(k, j)))


def _paragraphs(section: Column) -> Column:
    return F.transform(F.split(section, "\n"), lambda p: F.sha2(F.concat(F.lit("p"), p), 256))


def _section(leaves: Column) -> Column:
    return F.sha2(F.concat(F.lit("s"), root(leaves)), 256)


def _sections(text: Column) -> Column:
    return F.transform(F.split(text, "\n\n"), _paragraphs)


def _document(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("d"), root(sections)), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, root, n_sections, n_paragraphs."""
    rows = docs.select(F.col(id_col).alias("_id"), _sections(F.col(text_col)).alias("_leaves"))
    rows = rows.select("_id", F.transform("_leaves", _section).alias("_s"), F.aggregate("_leaves", F.lit(0), lambda n, x: n + F.size(x)).alias("_n"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        _document(F.col("_s")).alias("root"),
        F.when(F.col("_s").isNull(), 0).otherwise(F.size("_s")).alias("n_sections"),
        F.coalesce("_n", F.lit(0)).alias("n_paragraphs"),
    )


def _root_of(text: Column) -> Column:
    return _document(F.transform(_sections(text), _section))


def versions(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where two versions differ: doc_id, old_root, new_root, section, paragraph (numbers from 0; null for a whole document), change.

    Roots are compared first, then the trees over sections, then those over the paragraphs of differing sections; a section or
    paragraph that was put in or taken out is one edit, and what follows it is none. Only texts whose roots differ are moved.
    """
    roots = [df.select(F.col(id_col).alias("_id"), _root_of(F.col(text_col)).alias("_root"), F.lit(n).alias("_n")) for df, n in ((old, 1), (new, -1))]
    rest = cut(roots[0].unionByName(roots[1]).groupBy("_id", "_root").agg(F.sum("_n").alias("_n")).where("_n <> 0"))
    n = size_of(rest)

    def side(df: DataFrame, sign: int) -> DataFrame:
        need = rest.where(F.col("_n") * sign > 0).select(F.col("_id").alias("_i"), "_root", F.abs("_n").cast("int").alias("_copies"))
        texts = join_checked(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), need, F.col("_id").eqNullSafe(F.col("_i")), "inner", n)
        texts = texts.where(_root_of(F.col("_t")).eqNullSafe(F.col("_root"))).dropDuplicates(["_id", "_root"])
        return texts.select("_id", F.lit(sign).alias("_side"), F.struct("_t", "_root").alias("_r"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))

    rows = side(old, 1).unionByName(side(new, -1))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_side").orderBy("_r", "_copy")))
    one = lambda sign: F.first(F.when(F.col("_side") == sign, F.col("_r")), ignorenulls=True)
    pairs = rows.groupBy("_id", "_n").agg(one(1).alias("_a"), one(-1).alias("_b")).select("_id", "_a", "_b", F.col("_a._root").alias("old_root"), F.col("_b._root").alias("new_root"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    number = F.lit(None).cast("int")
    whole = pairs.where(~both).select("_id", "old_root", "new_root", number.alias("_si"), number.alias("_pi"), F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))
    parts = lambda c: F.coalesce(_sections(F.col(c)), F.array().cast("array<array<string>>"))
    inner = pairs.where(both).select("_id", "old_root", "new_root", parts("_a._t").alias("_pa"), parts("_b._t").alias("_pb"))
    inner = inner.withColumn("_sa", F.transform("_pa", _section)).withColumn("_sb", F.transform("_pb", _section))
    inner = _differences(inner, "_sa", "_sb").select("_id", "old_root", "new_root", F.col("_at").alias("_si"), "_change", "_pa", "_pb")
    none = F.array().cast("array<string>")
    old_part = F.when(F.col("_change") != "added", F.get("_pa", F.col("_si")))
    new_part = F.when(F.col("_change") != "removed", F.get("_pb", F.col("_si")))
    inner = inner.select("_id", "old_root", "new_root", "_si", F.coalesce(old_part, none).alias("_x"), F.coalesce(new_part, none).alias("_y"))
    inner = _differences(inner, "_x", "_y")
    found = whole.unionByName(inner.select("_id", "old_root", "new_root", "_si", F.col("_at").alias("_pi"), F.col("_change").alias("change")))
    return found.select(F.col("_id").alias("doc_id"), "old_root", "new_root", F.col("_si").alias("section"), F.col("_pi").alias("paragraph"), "change")


def _differences(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rows for each place in which two lists of hashes differ: _at and _change, by descent into the trees over them.

    Lists of one length are compared place by place. Else something was put in or taken out: what they have in common at the
    beginning and at the end, as far as the leftmost branches that differ in the trees from either side, is set aside, and the rest is compared place by
    place; what is left over in one of them was added (its place in the new list) or removed (its place in the old one).
    """
    n, m = F.size(x), F.size(y)
    first = lambda a, b: F.array_min(descend(levels(a), levels(b)))
    out = rows.withColumn("_pre", F.when(n == m, 0).otherwise(first(F.col(x), F.col(y))))
    back = F.when(n == m, 0).otherwise(F.least(first(F.reverse(x), F.reverse(y)), F.least(n, m) - F.col("_pre")))
    out = out.withColumn("_suf", back)
    for c, k in ((x, n), (y, m)):
        out = out.withColumn(f"{c}m", F.slice(c, F.col("_pre") + 1, k - F.col("_pre") - F.col("_suf")))
    out = out.withColumn("_k", F.explode(descend(levels(F.col(f"{x}m")), levels(F.col(f"{y}m")))))
    change = F.when(F.col("_k") >= F.size(f"{x}m"), "added").when(F.col("_k") >= F.size(f"{y}m"), "removed").otherwise("changed")
    return out.withColumn("_at", F.col("_pre") + F.col("_k")).withColumn("_change", change)


def edits(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edits of versions() without the roots: doc_id, section, paragraph, change."""
    return versions(old, new, id_col, text_col).select("doc_id", "section", "paragraph", "change")
