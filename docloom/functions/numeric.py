"""Numbers in text: what a cell or a reply says, with its separators and signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.checkpoints import let

DECIMAL = "decimal(38,10)"
#: Hyphen-minus, em, en, figure, bar and minus signs.
DASHES = "[\\-‒-―−]"


def _null_blank(s: Column) -> Column:
    return F.when(s.rlike(r"\S"), s)


def is_negative(s: Column) -> Column:
    """Whether there is a dash anywhere or a bracket before nothing but digits, blanks and separators."""
    return s.rlike(DASHES) | (s.contains("(") & s.rlike(r"\([0-9 %.,]+(?:\b|\))"))


def comma_thousands(s: Column) -> Column:
    """Whether a comma stands before exactly three digits."""
    return s.contains(",") & s.rlike(r"\b\d{1,3},\d{3}\b")


def dot_thousands(s: Column) -> Column:
    """Whether a dot stands before three digits that another separator and digit follow."""
    return s.contains(".") & s.rlike(r"\b\d{1,3}\.\d{3}[.,]\d")


def clean_number(s: Column) -> Column:
    """The signed decimal of a cell: 1,234.50 and 1.234,5 are read as meant; 12,5 is 12.5; (5) is -5. Null if it is none."""

    def plain(bare: Column) -> Column:
        whole = F.when(comma_thousands(bare), F.replace(bare, F.lit(","), F.lit(""))).when(dot_thousands(bare), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
        return F.replace(whole, F.lit(","), F.lit("."))

    def value(text: Column) -> Column:
        return F.when(text.rlike(r"^(?=.*\d)\d*\.?\d*$"), text).try_cast(DECIMAL)

    number = let(let(F.regexp_replace(s, r"[^\d.,]", ""), plain), value)
    signed = let(number, lambda x: F.when(is_negative(s), -x).otherwise(x))
    return F.when(_null_blank(s).isNotNull(), signed)


def last_number(s: Column) -> Column:
    """The last number in a text, without its sign."""
    runs = F.regexp_extract_all(s, F.lit(r"(\d(?:[.,\d]*\d)?)"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(runs, clean_number), lambda x: x.isNotNull()), F.lit(-1))


def is_number_cell(s: Column) -> Column:
    """Whether only digits are left after bracketed signs and all but letters, digits and slashes are gone."""
    return F.regexp_replace(s, r"\([^\d ]*\)|[^/a-zA-Z0-9]", "").rlike(r"^\d+$")


def is_year_cell(s: Column) -> Column:
    """Whether a number from 1000 to 1999 or 2000 to 2029 stands alone somewhere."""
    return s.rlike(r"\b(?:20[012]\d|1\d{3})\b")


def mean_abs(value: Column) -> Column:
    """Aggregate: the mean of absolute values, 0 without any."""
    return F.coalesce(F.avg(F.abs(value)), F.lit(0))


def strip_zeros(n: Column) -> Column:
    """A whole number without the zeros at its end."""
    return F.coalesce(F.rtrim(n.cast("string"), F.lit("0")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def match_key(s: Column) -> Column:
    """What numbers of different scale share: 12.50, 1250 and 125 are one. 0 for null, null without digits."""
    digits = F.regexp_replace(s.cast("string"), r"\D", "").try_cast("decimal(38,0)")
    return F.when(s.isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(F.when(digits.isNotNull(), strip_zeros(digits)))


def digits_int(s: Column) -> Column:
    """All digits of a text as one number: LI12 is 12."""
    return F.regexp_replace(s, r"\D", "").try_cast("int")
