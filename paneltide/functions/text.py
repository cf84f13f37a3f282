"""Text: locale folding, pattern building, parsing of loosely formatted fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Capital letters whose lower case depends on the locale.
FOLD_FROM, FOLD_TO = "İIŞĞÜÖÇ", "iışğüöç"


def fold(c: Column) -> Column:
    """Lower case by Turkish rules; null stays null."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def fold_literal(s: str) -> str:
    return s.translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()


def collapse(c: Column) -> Column:
    """White space runs become one space, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def any_of(literals: list[str]) -> str:
    """A Java pattern that finds any of the literals in folded text; one that finds nothing for none."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", fold_literal(x)) for x in literals) or r"(?!)"


def mentions(c: Column, literals: list[str]) -> Column:
    """Whether folded, collapsed text holds one of the literals; null counts as empty."""
    return fold(collapse(c)).rlike(any_of(literals))


def founder_of(name: Column) -> Column:
    """Text up to the first "portföy", else the first two words; null for blank."""
    text = collapse(name)
    upto = F.regexp_extract(text, r"(?iu)^(.*?portföy)", 1)
    two = F.array_join(F.slice(F.split(text, " "), 1, 2), " ")
    return F.when(text == "", F.lit(None)).when(upto != "", upto).otherwise(two)


def first_number(c: Column) -> Column:
    """First number in text, decimal comma or point; null if none."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", "."), r"-?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found.cast("double"))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_day(c: Column, *formats: str) -> Column:
    """First format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def join_flags(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold, joined by +, in the order given; ``ok`` if none does."""
    text = F.concat_ws("+", *[F.when(cond, F.lit(name)) for cond, name in flags])
    return F.when(text == "", F.lit("ok")).otherwise(text)


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, ``ok`` if none: the order is the meaning."""
    out = None
    for cond, name in reasons:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("ok"))


def dated_id(day: Column, number: Column, width: int = 2) -> Column:
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(number.cast("string"), width, "0"))
