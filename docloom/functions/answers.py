"""Typed answers: what a free-text value means for an item of a given type.

Each parser gives a struct of ``value`` (a string, "n/a" or the default where nothing was found) and ``ok``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.checkpoints import let
from docloom.functions.numeric import last_number
from docloom.functions.text import entity, iso_date

NOT_AVAILABLE = "n/a"


def _result(value: Column, default: Column) -> Column:
    return F.struct(F.coalesce(value, default).alias("value"), value.isNotNull().alias("ok"))


def default_value(default: Column | str | None) -> Column:
    """A default that isn't blank, or "n/a"."""
    d = default if isinstance(default, Column) else F.lit(default).cast("string")
    return F.coalesce(F.when(F.trim(d) != "", d), F.lit(NOT_AVAILABLE))


def python_float(x: Column) -> Column:
    """A double as Python writes it below 1e16: with digits, a dot and at least one digit more."""
    d = x.cast("double")
    short = d.cast("string")
    plain = F.regexp_replace(d.cast("decimal(38,10)").cast("string"), r"(\.\d)0*$|(\.\d+?)0*$", "$1$2")
    return F.when(short.contains("E") & (F.abs(d) >= 1), plain).otherwise(short)


def parse_list(raw: Column, values: Column, default: Column) -> Column:
    """One of the listed values: equal to the text (or to what $ signs enclose), or else the first that is a word of it."""

    def text(low: Column) -> Column:
        inner = F.regexp_extract(low, r"\$ ?(.+) ?\$", 1)
        return F.when(inner != "", F.trim(inner)).otherwise(low)

    def found(t: Column) -> Column:
        same = F.filter(values, lambda v: F.lower(v) == t)
        inside = F.filter(values, lambda v: F.rlike(t, F.concat(F.lit(r"\b\Q"), F.lower(v), F.lit(r"\E\b"))))
        return F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(inside, F.lit(1)))

    return let(let(let(F.lower(raw), text), found), lambda v: _result(v, default))


def parse_multi(raw: Column, values: Column, default: Column) -> Column:
    """The listed values among those that bars separate, in lower case; never a failure."""
    low = F.lower(raw)
    inner = F.regexp_extract(low, r"\[(.+)\]", 1)
    text = F.when(inner != "", inner).otherwise(low)
    known = F.transform(values, lambda v: F.lower(v))
    kept = F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: F.array_contains(known, x))
    return F.struct(F.array_join(kept, " | ").alias("value"), F.lit(True).alias("ok"))


def parse_int(raw: Column, values: Column, default: Column) -> Column:
    return let(last_number(raw), lambda x: _result(F.floor(F.abs(x)).cast("string"), default))


def parse_text(raw: Column, values: Column, default: Column) -> Column:
    return F.struct(raw.alias("value"), F.lit(True).alias("ok"))


def parse_numeric(raw: Column, values: Column, default: Column) -> Column:
    return let(last_number(raw), lambda x: _result(python_float(x), default))


def parse_percentage(raw: Column, values: Column, default: Column) -> Column:
    """Shares of up to 1 without a per cent sign are taken times 100."""

    def shown(x: Column) -> Column:
        whole = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(python_float(x))
        return _result(F.concat(whole, F.lit("%")), default)

    return let(let(last_number(raw).cast("double"), lambda x: F.when(raw.contains("%") | (x > 1), x).otherwise(x * 100)), shown)


def parse_entity(raw: Column, values: Column, default: Column) -> Column:
    """What is named, without dots at the end; never a failure."""
    found = F.coalesce(entity(raw), raw)
    return F.struct(F.trim(F.rtrim(F.trim(found), F.lit("."))).alias("value"), F.lit(True).alias("ok"))


def parse_date(raw: Column, values: Column, default: Column) -> Column:
    return _result(iso_date(raw), default)


PARSERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "list": parse_list,
    "multi": parse_multi,
    "int": parse_int,
    "text": parse_text,
    "numeric": parse_numeric,
    "percentage": parse_percentage,
    "entity": parse_entity,
    "date": parse_date,
}


def parse_typed(kind: Column | str, raw: Column, values: Column | None = None, default: Column | str | None = None) -> Column:
    """The parser that an item type, or each row's, names; an unknown type gives null."""
    values = F.array().cast("array<string>") if values is None else values
    default = default_value(default)
    if isinstance(kind, str):
        return PARSERS[kind](raw, values, default)
    out = F.when(F.lit(False), parse_text(raw, values, default))
    for name, parser in PARSERS.items():
        out = out.when(kind == name, parser(raw, values, default))
    return out


def possible_values(kind: str, values: list[str] | None = None) -> str:
    """What a prompt says about the values that an item of this type can have."""
    listed = values or []
    return {
        "list": "allowed values (choose one entry of this JSON array): [" + ", ".join(f"'{v}'" for v in listed) + "]",
        "multi": f"allowed values (choose any of these, separated by '|'): [{' | '.join(listed)}]",
        "int": "allowed values: a whole number without sign",
        "text": "allowed values: free text",
        "numeric": "allowed values: a number, with sign and decimals where needed",
        "percentage": "allowed values: a percentage",
        "entity": "allowed values: the name of the thing, company or person alone",
        "date": "allowed values: a date written YYYY-MM-DD",
    }[kind]


def example(kind: str, values: list[str] | None = None, given: str | None = None) -> str:
    """A sample value of this type for a prompt."""
    listed = values or ["value"]
    if kind == "list":
        return listed[0]
    if kind == "multi":
        return f"[{' | '.join(listed[:2])}]"
    if kind == "percentage":
        try:
            x = float(given) if given and given.strip() else 0.15
        except ValueError:
            x = 0.15
        return f"{round(x * 100 if x < 1 else x)}%"
    if given and given.strip():
        return given
    return {"int": "123", "numeric": "123", "date": "2023-11-24"}.get(kind, "answer to question")


def to_raw(kind: Column, value: Column) -> Column:
    """A parsed value as a reply would give it."""
    return F.when(kind == "multi", F.concat(F.lit("["), value, F.lit("]"))).otherwise(value)
