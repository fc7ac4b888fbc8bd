"""Text cleaning, shares of character classes, entities, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.checkpoints import let

#: What ends a line: besides \n and \r also vertical tabs, form feeds, separators and their Unicode kin.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def entity(s: Column) -> Column:
    """What stands behind the last "is", "are" or colon of the first line that has one; null if none has."""
    return F.nullif(F.regexp_extract(s, r"(?:.+)(?: is:? | are:? |: )(.+)", 1), F.lit(""))


def iso_date(s: Column) -> Column:
    """The first dddd-dd-dd, valid or not."""
    return F.nullif(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def words(s: Column, lower: bool = False) -> Column:
    """Runs of letters, digits, per cent and currency signs."""
    s = F.lower(s) if lower else s
    return F.filter(F.split(F.regexp_replace(s, "[^%$£€¥0-9a-zA-Z]+", " "), " "), lambda w: w != "")


def clean_spaces(s: Column) -> Column:
    """Blanks, and only they, collapsed and trimmed."""
    return F.trim(F.regexp_replace(s, " +", " "))


def clean_for_vectors(s: Column, base_year: int | None = None, drop_special: bool = False, drop_numbers: bool = False, number: str = " xnumberx ") -> Column:
    """Lower case on one line, numbers with separators as a token, signs set apart; years near ``base_year`` as offsets; null is empty."""
    x = F.lower(F.coalesce(s, F.lit("")))
    x = F.regexp_replace(F.regexp_replace(x, f"(?:{LINE_ENDS})$", ""), LINE_ENDS, " ")
    x = F.regexp_replace(x, r"\b(?:(?:\d{1,3}[.,])+\d+|\d+[.,]\d+)\b", number)
    if drop_special:
        # Kept: letters, white space, the ASCII range from "!" to "_", and a few signs.
        x = F.regexp_replace(x, r"(?U)[^\w\s!-_`§´€]", " ")
    x = F.regexp_replace(x, "([^a-zA-Z0-9 ])", " $1 ")
    if base_year is not None:
        for k in range(-3, 4):
            x = F.replace(x, F.lit(str(int(base_year) + k)), F.lit(f" xbaseyear{'p' if k > 0 else 'm'}{abs(k)}x "))
    if drop_numbers:
        x = F.regexp_replace(x, r"\b\d+\b", number)
    # A text's ends lose all white space, but within it only blanks are collapsed.
    return F.regexp_replace(F.regexp_replace(x, " +", " "), r"(?U)^\s+|\s+$", "")


def composition(s: Column) -> Column:
    """Shares of digits and letters among both, and of signs among all characters; all 0 without digits or letters."""
    # Runs go as wholes, and digits are looked for only among what is left; lengths are taken once for all shares.
    kept = let(F.regexp_replace(s, "[^0-9a-zA-Z]+", ""), lambda x: F.struct(F.length(x).alias("alnum"), F.length(F.regexp_replace(x, "[^0-9]+", "")).alias("digits")))
    signs = F.length(F.regexp_replace(s, "[ 0-9a-zA-Z]+", ""))

    def shares(n: Column) -> Column:
        share = lambda a, b: F.when(n["alnum"] > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(share(n["digits"], n["alnum"]).alias("numbers"), share(n["alnum"] - n["digits"], n["alnum"]).alias("text"), share(signs, F.length(s)).alias("special"))

    return let(kept, shares)


def identifier(s: Column) -> Column:
    """SHA-256 of bytes or text, in hexadecimal digits."""
    return F.sha2(s, 256)


def reference_id(source: Column, index: Column) -> Column:
    """Of a document or, with an index, of one of its elements."""
    return F.concat(source, F.lit("|"), F.coalesce(index.cast("string"), F.lit("")))


def meta_key(meta: Column, exclude: list[str] | None = None) -> Column:
    """ "id:value" of all entries (struct of class_id and class_value), in the order of ids, joined by underscores."""
    kept = F.filter(meta, lambda m: ~m["class_id"].isin(*exclude)) if exclude else meta
    ordered = F.array_sort(F.transform(kept, lambda m: F.struct(m["class_id"].alias("i"), m["class_value"].alias("v"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat(m["i"], F.lit(":"), F.coalesce(m["v"], F.lit("")))), "_")


def location_id(coordinates: Column, xpath: Column) -> Column:
    """Of an element's place: its coordinates, or else its path."""
    return F.sha2(F.coalesce(F.to_json(coordinates), xpath, F.lit("")), 256)
