"""Consumption tax of an invoice, recomputed in whole numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chobo.functions.text import let

RATES = (10, 8)
ROUNDINGS = ("floor", "half_up", "ceil")
TAX_CODES = ("line_amount_mismatch", "out_of_range", "rate_missing", "subtotal_mismatch", "tax_mismatch", "total_mismatch", "unknown_rate")


def floor_div(a: Column, b: Column) -> Column:
    """Rounded towards minus infinity; SQL's own division of whole numbers rounds towards zero."""
    return F.call_function("div", a - F.pmod(a, b), b)


def expected_tax(subtotal: Column, rate: Column, included: Column, rounding: str) -> Column:
    """Tax on a subtotal at a rate per cent, rounded; half_up rounds ties upwards, for negative amounts too."""
    n = subtotal.cast("long") * rate
    d = F.when(included, rate + 100).otherwise(F.lit(100)).cast("long")
    if rounding == "floor":
        return floor_div(n, d)
    return floor_div(n * 2 + d, d * 2) if rounding == "half_up" else -floor_div(-n, d)


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _sum(items: Column, value) -> Column:
    """Null if it has more than 38 digits."""
    return F.aggregate(items, _exact(F.lit(0)), lambda a, x: F.try_add(a, _exact(value(x))))


def _judged(total: Column, included: Column) -> Column:
    """struct of a boolean for each rounding (does it explain the printed tax of this stated rate?) and fits (could it be
    worked out?). Nothing is divided: with tax t of n / d, a rounding explains t if n - d * t is within its bounds. A rate
    of -100 with tax included leaves nothing to divide by, and nothing explains it.
    """
    rate, hundred = _exact(total.rate), _exact(F.lit(100))
    d = F.when(included, F.try_add(rate, hundred)).otherwise(hundred)
    off = F.try_subtract(F.try_multiply(_exact(total.subtotal), rate), F.try_multiply(d, _exact(total.tax)))

    def judge(x: Column) -> Column:
        d, off = F.abs(x.d), F.when(x.d < 0, -x.off).otherwise(x.off)
        tests = {"floor": (off >= 0) & (off < d), "half_up": (F.try_add(off, off) >= -d) & (F.try_add(off, off) < d), "ceil": (off <= 0) & (-off < d)}
        return F.struct(*[F.coalesce(tests[r], F.lit(False)).alias(r) for r in ROUNDINGS], x.off.isNotNull().alias("fits"))

    return let(F.struct(d.alias("d"), off.alias("off")), judge)


def conventions(total: Column, included: Column) -> Column:
    """Array of the roundings that explain the printed tax of a stated rate."""
    return let(_judged(total, included), lambda j: F.array_compact(F.array(*[F.when(j.getField(r), r) for r in ROUNDINGS])))


def _last_stated(totals: Column) -> Column:
    """Of totals that state a rate twice, the last."""
    return F.filter(totals, lambda t, k: k == F.array_max(F.transform(totals, lambda u, j: F.when(u.rate == t.rate, j))))


def matched(totals: Column, included: Column) -> Column:
    """map of each stated rate to the roundings that explain its tax."""
    return F.map_from_entries(F.transform(_last_stated(totals), lambda t: F.struct(t.rate, conventions(t, included))))


def check_tax(items: Column, totals: Column, grand_total: Column, included: Column) -> Column:
    """struct ok, errors (sorted codes), convention (roundings that explain every stated rate; may be empty).

    items: array of quantity, unit_price, amount, rate; totals: array of rate, subtotal, tax; all of them whole numbers of
    any type. Items at other rates than 10 and 8 are unknown_rate and in no sum. Of totals that state a rate twice the
    last one counts, but all are in the grand total. Everything is worked out in up to 38 digits; where a product or sum
    has more, its comparison is left out and the code out_of_range says so. No row ends a job.
    """
    last = F.transform(_last_stated(totals), lambda t: F.struct(_judged(t, included).alias("by"), (t.rate.isNotNull() & t.subtotal.isNotNull() & t.tax.isNotNull()).alias("whole")))
    product = lambda i: F.try_multiply(_exact(i.quantity), _exact(i.unit_price))
    known = F.transform(F.filter(items, lambda i: i.rate.isin(*RATES)), lambda i: F.struct(i.rate.alias("rate"), _exact(i.amount).alias("amount"), product(i).alias("product"), (i.quantity.isNotNull() & i.unit_price.isNotNull()).alias("whole")))
    return let(F.struct(known.alias("known"), last.alias("last")), lambda x: _checked(items, totals, grand_total, included, x.known, x.last))


def _checked(items, totals, grand_total, included, known, last) -> Column:
    any_of = lambda test: F.coalesce(test, F.lit(False))
    stated = lambda r: F.element_at(F.filter(totals, lambda t: t.rate == r), -1)
    at_rate = lambda rate: lambda x: x.rate == rate
    errors = [F.when(any_of(F.exists(known, lambda i: i.product != i.amount)), "line_amount_mismatch"), F.when(any_of(F.exists(items, lambda i: ~i.rate.isin(*RATES))), "unknown_rate")]
    far = [F.exists(known, lambda i: i.whole & i.product.isNull())]
    for r in RATES:
        own = F.filter(known, at_rate(r))
        has = F.size(own) > 0
        there = F.exists(totals, at_rate(r))
        amount = _sum(own, lambda i: i.amount)
        errors.append(F.when(has & ~there, "rate_missing"))
        errors.append(F.when(has & there & (_exact(stated(r).getField("subtotal")) != amount), "subtotal_mismatch"))
        far.append(has & there & amount.isNull() & F.forall(own, lambda i: i.amount.isNotNull()))
    explained = lambda j: reduce(lambda a, b: a | b, [j.by.getField(r) for r in ROUNDINGS])
    errors.append(F.when(F.exists(last, lambda j: ~explained(j) & (j.by.fits | ~j.whole)), "tax_mismatch"))
    far.append(F.exists(last, lambda j: j.whole & ~j.by.fits))
    expected = F.try_add(_sum(totals, lambda t: t.subtotal), F.when(included, _exact(F.lit(0))).otherwise(_sum(totals, lambda t: t.tax)))
    errors.append(F.when(_exact(grand_total) != expected, "total_mismatch"))
    far.append(expected.isNull() & F.forall(totals, lambda t: t.subtotal.isNotNull() & t.tax.isNotNull()))
    errors.append(F.when(reduce(lambda a, b: a | b, [any_of(x) for x in far]), "out_of_range"))
    codes = F.array_sort(F.array_distinct(F.array_compact(F.array(*errors))))
    every = F.array_compact(F.array(*[F.when((F.size(totals) > 0) & F.forall(last, lambda j: j.by.getField(r)), r) for r in ROUNDINGS]))
    return let(F.struct(codes.alias("errors"), every.alias("convention")), lambda x: F.struct((F.size(x.errors) == 0).alias("ok"), x.errors.alias("errors"), x.convention.alias("convention")))


def check_plain(items: Column, totals: Column, grand_total: Column, included: Column) -> Column:
    """check_tax() of longs whose products and sums have 64 bits at most, none of them null, with totals that state each
    rate once and none below 0: the same struct, from plain arithmetic and few folds."""
    zero = F.lit(0).cast("long")
    has = lambda rows, r: F.array_contains(rows.getField("rate"), F.lit(r).cast("long"))
    add = lambda a: F.aggregate(a, zero, lambda n, x: n + x)
    at = lambda rows, r, name: F.aggregate(rows, zero, lambda n, x: n + F.when(x.rate == r, x.getField(name)).otherwise(zero))
    known = F.array(*[F.lit(r).cast("long") for r in RATES])
    # n - d * t of every total, which tells what rounding explains its tax
    d = lambda t: F.when(included, t.rate + 100).otherwise(F.lit(100).cast("long"))
    off = F.transform(totals, lambda t: let(F.struct(d(t).alias("d"), (t.subtotal * t.rate).alias("n"), t.tax.alias("t")), lambda x: F.struct(x.d.alias("d"), (x.n - x.d * x.t).alias("off"))))
    by = {"floor": lambda j: (j.off >= 0) & (j.off < j.d), "half_up": lambda j: (j.off * 2 >= -j.d) & (j.off * 2 < j.d), "ceil": lambda j: (j.off <= 0) & (-j.off < j.d)}

    def found(x: Column) -> Column:
        wrong = lambda r: F.when(has(items, r) & has(totals, r), at(totals, r, "subtotal") != at(items, r, "amount")).otherwise(False)
        stated = add(totals.getField("subtotal")) + F.when(included, zero).otherwise(add(totals.getField("tax")))
        # a rounding that explains every tax leaves none to be asked for one by one
        unexplained = ~(x.floor | x.half_up | x.ceil) & F.exists(x.off, lambda j: ~reduce(lambda a, b: a | b, [test(j) for test in by.values()]))
        return F.struct(
            F.exists(items, lambda i: (i.quantity * i.unit_price != i.amount) & i.rate.isin(*RATES)).alias("line_amount_mismatch"),
            reduce(lambda a, b: a | b, [has(items, r) & ~has(totals, r) for r in RATES]).alias("rate_missing"),
            reduce(lambda a, b: a | b, [wrong(r) for r in RATES]).alias("subtotal_mismatch"),
            unexplained.alias("tax_mismatch"), (grand_total != stated).alias("total_mismatch"), (F.size(F.array_except(items.getField("rate"), known)) > 0).alias("unknown_rate"),
            *[x.getField(r) for r in ROUNDINGS],
        )

    def named(x: Column) -> Column:
        codes = [c for c in TAX_CODES if c != "out_of_range"]
        some = reduce(lambda a, b: a | b, [x.getField(c) for c in codes])
        errors = F.when(some, F.array_compact(F.array(*[F.when(x.getField(c), c) for c in codes]))).otherwise(F.array().cast("array<string>"))
        return F.struct((~some).alias("ok"), errors.alias("errors"), F.array_compact(F.array(*[F.when(x.getField(r), r) for r in ROUNDINGS])).alias("convention"))

    judged = let(off, lambda o: F.struct(o.alias("off"), *[F.forall(o, by[r]).alias(r) for r in ROUNDINGS]))
    return let(let(judged, found), named)
