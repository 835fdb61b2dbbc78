"""Dates in Western and era notation, as Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chobo.functions.text import full_width, let, nfkc, strip

# Era, its letter, first and last day, and what is added to its years.
ERAS = [("令和", "R", "2019-05-01", "9999-12-31", 2018), ("平成", "H", "1989-01-08", "2019-04-30", 1988), ("昭和", "S", "1926-12-25", "1989-01-07", 1925)]
# The printed forms of dates, and the days of qualified invoices.
ERA_LONG = r"(?U)^(令和|平成|昭和)\s*([0-9]{1,2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?$"
ERA_SHORT = r"(?iU)^([RHS])\s*\.?\s*([0-9]{1,2})\s*[./年-]\s*([0-9]{1,2})\s*[./月-]\s*([0-9]{1,2})\s*日?$"
WESTERN = r"(?U)^([0-9]{4})\s*[./年-]\s*([0-9]{1,2})\s*[./月-]\s*([0-9]{1,2})\s*日?$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
FIRST_DAY, LAST_DAY = "2023-10-01", "2026-12-31"
"""Qualified invoices exist from the first; dates after the last are not believed."""


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none; year 0 is none either."""
    d = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day), "yyyy-M-d")
    return F.when(year >= 1, d)


def parse_printed(s: Column) -> Column:
    """ISO text of a date in a text that strip(nfkc()) has been through; null for what is none, or not in its era.

    Within lambdas nothing is shared, so each pattern is asked once and its parts are taken from one text.
    """
    western = F.when(s.rlike(WESTERN), F.split(F.regexp_replace(s, WESTERN, "$1-$2-$3"), "-"))
    year_one = F.replace(s, F.lit("元年"), F.lit("1年"))
    parts = lambda t, pattern: F.split(F.regexp_replace(t, pattern, "$1-$2-$3-$4"), "-")
    era = let(year_one, lambda t: F.when(t.rlike(ERA_LONG), parts(t, ERA_LONG)).when(t.rlike(ERA_SHORT), parts(t, ERA_SHORT)))

    def by_era(p: Column) -> Column:
        name, year = F.upper(p[0]), p[1].cast("int")
        of = lambda e: let(_day(year + e[4], p[2], p[3]), lambda d: F.when(d.between(F.lit(e[2]).cast("date"), F.lit(e[3]).cast("date")), d))
        first, *rest = [(name.isin(e[0], e[1]), of(e)) for e in ERAS]
        found = F.when(*first)
        for test, day in rest:
            found = found.when(test, day)
        return found

    # only Western dates begin with a digit
    day = F.when(s.rlike("^[0-9]"), let(western, lambda p: _day(p[0].cast("int"), p[1], p[2]))).otherwise(let(era, by_era))
    return F.date_format(day, "yyyy-MM-dd")


def shown_date(s: Column) -> Column:
    """parse_date() of a text column: ISO texts are only looked up in the calendar, in generated code."""
    iso = F.when(s.try_cast("date").isNotNull() & (s >= "0001"), s)
    return F.when(s.rlike(ISO), iso).otherwise(let(strip(nfkc(s)), parse_printed))


def parse_date(c: Column) -> Column:
    return let(c.cast("string"), shown_date)


def in_range(iso: Column) -> Column:
    """ISO text within the days of qualified invoices."""
    return iso.between(FIRST_DAY, LAST_DAY)


def format_date(iso: Column, style: Column) -> Column:
    """A date of ISO text as printed: 0 2025年3月14日, 1 2025/03/14, 2 2025.3.14, 3 令和7年3月14日, 4 full-width 0, 5 R7.3.14."""
    d = iso.cast("date")
    y, m, n = F.year(d), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    long = F.concat(y.cast("string"), F.lit("年"), m, F.lit("月"), n, F.lit("日"))
    reiwa = (y - 2018).cast("string")
    return (
        F.when(style == 0, long)
        .when(style == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(style == 2, F.concat_ws(".", y.cast("string"), m, n))
        .when(style == 3, F.concat(F.lit("令和"), F.when(y == 2019, "元").otherwise(reiwa), F.lit("年"), m, F.lit("月"), n, F.lit("日")))
        .when(style == 4, full_width(long))
        .otherwise(F.concat(F.lit("R"), F.concat_ws(".", reiwa, m, n)))
    )
