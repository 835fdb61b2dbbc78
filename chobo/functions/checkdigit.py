"""Registration numbers (T and 13 digits) and the check digit that leads a corporate number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chobo.functions.text import let, nfkc

NUMBER = r"^T[0-9]{13}\z"
SEPARATORS = r"(?U)[\s\x{1c}-\x{1f}\-‐‑–—ー－・.,]"


def shown_number(s: Column) -> Column:
    """registration_number() of a text column: what is one already is taken in generated code."""
    whole = lambda x: F.when(x.rlike(NUMBER), x)
    return F.when(s.rlike(NUMBER), s).otherwise(let(F.regexp_replace(F.upper(nfkc(s)), SEPARATORS, ""), whole))


def registration_number(c: Column) -> Column:
    """T and 13 digits from a printed number; null if it is none."""
    return let(c.cast("string"), shown_number)


def check_digit(twelve: Column) -> Column:
    """9 less the weighted sum of 12 digits modulo 9, as a number; null for other text.

    The weights from the right are 1, 2, 1, 2, ...; twelve plain terms stay within generated code.
    """
    terms = [F.substr(twelve, F.lit(12 - i), F.lit(1)).try_cast("int") * (1 + i % 2) for i in range(12)]
    return F.when(twelve.rlike(r"^[0-9]{12}\z"), 9 - reduce(lambda a, b: a + b, terms) % 9)


def is_corporate_number(thirteen: Column) -> Column:
    own = F.substr(thirteen, F.lit(1), F.lit(1)).try_cast("int")
    return F.coalesce(thirteen.rlike(r"^[0-9]{13}\z") & (own == check_digit(F.substr(thirteen, F.lit(2), F.lit(12)))), F.lit(False))


def is_valid_parsed(number: Column) -> Column:
    """Of a registration_number() column. False proves nothing against a sole proprietor's number."""
    return is_corporate_number(F.substr(number, F.lit(2), F.lit(13)))


def is_registration_number(c: Column) -> Column:
    return let(registration_number(c), is_valid_parsed)


def corporate_number(twelve: Column) -> Column:
    """The 13 digits that begin with the check digit of these twelve."""
    return F.concat(check_digit(twelve).cast("string"), twelve)
