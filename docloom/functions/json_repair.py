"""JSON in free-text replies: found, repaired and merged, as columns.

Objects and arrays stay JSON text; from_json or a variant makes values of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.checkpoints import let

MAP = "map<string,string>"


def valid(s: Column) -> Column:
    """The text if all of it is one JSON value, else null. The parser itself would let anything follow a value, so the text is put in a list before its own hash, which nothing in it can stand for."""
    mark = F.sha2(s, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), s, F.lit(',"'), mark, F.lit('"]')))
    return F.when((F.try_variant_get(pair, "$[1]", "string") == mark) & F.try_variant_get(pair, "$[2]", "string").isNull(), s)


def unescape(s: Column) -> Column:
    """Underscores that a model escaped."""
    return F.replace(s, F.lit("\\_"), F.lit("_"))


def find_dict(s: Column) -> Column:
    """From the first brace to the last one, as JSON text of an object; null if that is no JSON."""
    found = valid(F.nullif(F.regexp_extract(unescape(s), r"(?s)(\{.+\})", 1), F.lit("")))
    return F.when(found.rlike(r"^\s*\{"), found)


def find_array(s: Column) -> Column:
    """From the first bracket to the first closing one, as JSON text of an array; null if that is no JSON."""
    return valid(F.nullif(F.regexp_extract(unescape(s), r"(\[[^\]]*\])", 1), F.lit("")))


def strip_fences(s: Column) -> Column:
    """Without Markdown's code fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"```json\s*", ""), r"\n?```", ""), r"^\s+|\s+$", "")


def repair_objects(s: Column) -> Column:
    """Array of the objects' JSON texts in a list whose brackets or last commas may be missing; what can't be read is left out."""
    body = F.regexp_replace(F.regexp_replace(s, r"^\s*\[?", ""), r"\]\s*,?\s*$", "")

    def one(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s+|\s+$", "")
        x = F.when(x.startswith("{"), x).otherwise(F.concat(F.lit("{"), x))
        x = F.when(x.endswith("}"), x).otherwise(F.concat(x, F.lit("}")))
        return F.regexp_replace(x, r",\s*\}$", "}")

    return F.filter(F.transform(F.split(body, r"\}\s*,\s*(?=\{)"), one), lambda x: valid(x).isNotNull())


def items(array: Column) -> Column:
    """The entries of a JSON array as JSON texts."""
    return F.transform(F.from_json(array, F.lit("array<variant>")), lambda v: F.to_json(v))


def objects(reply: Column) -> Column:
    """The objects of a reply as JSON texts: read strictly if that works, else repaired."""
    body = strip_fences(reply)
    good = valid(body)
    return F.when(good.rlike(r"^\s*\["), F.coalesce(items(good), F.array().cast("array<string>"))).when(good.rlike(r"^\s*\{"), F.array(good)).otherwise(repair_objects(body))


def merge_objects(replies: Column) -> Column:
    """All objects of an array of replies, in order, duplicates kept, as one JSON array."""
    return F.concat(F.lit("["), F.array_join(F.flatten(F.transform(replies, objects)), ", "), F.lit("]"))


def _latest(pairs: Column) -> Column:
    """A JSON object of pairs (k, v: JSON text), each key where it came up first and with its last value. Keys are sorted, so none is searched for."""

    def chosen(p: Column) -> Column:
        other = lambda x, i: (i < 0) | (i >= F.size(p)) | ~F.get(p, i)["k"].eqNullSafe(x["k"])
        firsts, lasts = F.filter(p, lambda x, i: other(x, i - 1)), F.filter(p, lambda x, i: other(x, i + 1))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["at"].alias("at"), a["k"].alias("k"), b["v"].alias("v")))

    sorted_ = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("at"), x["v"].alias("v"))))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    parts = F.transform(F.array_sort(let(sorted_, chosen)), lambda x: F.concat(name(x["k"]), F.lit(": "), x["v"]))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def merge_pieces(replies: Column) -> Column:
    """One answer of several: arrays concatenated, objects with later keys winning, else the texts joined; the first reply decides."""
    first = F.try_element_at(replies, F.lit(1))
    arrays = F.flatten(F.filter(F.transform(replies, lambda r: items(find_array(r))), lambda x: x.isNotNull()))
    pairs = F.flatten(F.filter(F.transform(replies, lambda r: F.transform(F.map_entries(F.from_json(find_dict(r), F.lit("map<string,variant>"))), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))), lambda x: x.isNotNull()))
    return (
        F.when(F.size(replies) == 0, F.lit(""))
        .when(find_array(first).isNotNull(), F.concat(F.lit("["), F.array_join(arrays, ", "), F.lit("]")))
        .when(find_dict(first).isNotNull(), _latest(pairs))
        .otherwise(F.array_join(replies, ""))
    )
