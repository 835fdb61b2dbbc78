"""Scores of extractions against labels, field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chobo.functions import untyped as U
from chobo.functions.checkdigit import registration_number
from chobo.functions.dates import parse_date
from chobo.functions.text import company_name, let, nfkc, squeeze

# The fields of an extraction, and which of them checks can see.
FIELDS = ("issuer_name", "registration_number", "issue_date", "recipient_name", "invoice_number", "tax_included", "grand_total", "items", "totals")
COVERED = ("issuer_name", "registration_number", "tax_included", "grand_total", "totals")
"""Fields in which some check can see an error; of items, the numbers."""
UNCOVERED = ("recipient_name", "invoice_number", "issue_date")
ITEM_KEYS, TOTAL_KEYS = ("description", "quantity", "unit_price", "amount", "rate"), ("rate", "subtotal", "tax")


def target() -> Column:
    """The label's fields as the extraction schema names them, as VARIANT."""
    pick = lambda keys: lambda x: F.struct(*[x.getField(k).alias(k) for k in keys])
    return F.to_variant_object(F.struct(
        F.col("issuer.name").alias("issuer_name"), F.col("issuer.registration_number").alias("registration_number"), "issue_date", F.col("recipient.name").alias("recipient_name"), "invoice_number", "tax_included",
        F.transform("items", pick(ITEM_KEYS)).alias("items"), F.transform("totals", pick(TOTAL_KEYS)).alias("totals"), "grand_total",
    ))


def same_as_label(p: Column) -> Column:
    """struct of a boolean for each field: does the extraction p hold it just as the label (the row's own columns) does?

    Equal texts have equal comparable forms, so such fields need no comparison. A text that another kind of value shares
    (true, 0) is left to it, and so is everything that is null. Lists are compared as JSON texts, with their nulls.
    """
    raw = lambda k: F.try_variant_get(p, f"$.{k}", "string")
    alike = lambda k, c: (raw(k) == c) & ~c.isin("true", "false")
    json = lambda k: F.to_json(F.try_variant_get(p, f"$.{k}", "variant"))
    # objects name their keys in order; zipped columns stay within generated code, which a lambda would leave
    listed = lambda k, keys: F.to_json(F.arrays_zip(*[F.col(f"{k}.{c}").alias(c) for c in sorted(keys)]), {"ignoreNullFields": "false"})
    tests = {
        "issuer_name": alike("issuer_name", F.col("issuer.name")),
        "registration_number": alike("registration_number", F.col("issuer.registration_number")),
        "issue_date": alike("issue_date", F.col("issue_date")) & (F.col("issue_date") > "1"),
        "recipient_name": alike("recipient_name", F.col("recipient.name")),
        "invoice_number": alike("invoice_number", F.col("invoice_number")),
        "tax_included": raw("tax_included") == F.col("tax_included").cast("string"),
        "grand_total": raw("grand_total") == F.col("grand_total").cast("string"),
        "items": json("items") == listed("items", ITEM_KEYS),
        "totals": json("totals") == listed("totals", TOTAL_KEYS),
    }
    return F.struct(*[F.coalesce(tests[k], F.lit(False)).alias(k) for k in FIELDS])


def canonical(p: Column, same: str | None = None) -> Column:
    """Comparable form of an extraction or a target: struct of all fields. Anything but an object counts as empty.

    same: a column of same_as_label(); fields for which it is true are null and are not worked out.
    """
    f = lambda k: U.field(p, k)
    shown = lambda k: U.text(f(k))
    date, number = shown("issue_date"), f("registration_number")
    items = F.coalesce(U.elements(p, "items"), F.expr("cast(array() as array<variant>)"))
    totals = F.coalesce(U.elements(p, "totals"), F.expr("cast(array() as array<variant>)"))
    forms = (
        company_name(shown("issuer_name")).alias("issuer_name"),
        let(U.text(number), lambda s: F.coalesce(registration_number(s), nfkc(s))).alias("registration_number"),
        F.when(U.truthy(f("issue_date")), let(date, lambda s: F.coalesce(parse_date(s), nfkc(s)))).otherwise("").alias("issue_date"),
        company_name(shown("recipient_name")).alias("recipient_name"),
        squeeze(nfkc(shown("invoice_number"))).alias("invoice_number"),
        U.flag(f("tax_included")).alias("tax_included"),
        U.whole(f("grand_total")).alias("grand_total"),
        F.transform(items, lambda i: F.struct(company_name(U.text(U.field(i, "description"))).alias("description"), *[U.whole(U.field(i, k)).alias(k) for k in ITEM_KEYS[1:]])).alias("items"),
        F.transform(totals, lambda t: F.struct(*[U.whole(U.field(t, k)).alias(k) for k in TOTAL_KEYS])).alias("totals"),
    )
    return F.struct(*[(F.when(~F.col(f"{same}.{k}"), c) if same else c).alias(k) for k, c in zip(FIELDS, forms, strict=True)])


def canonical_label(same: str) -> Column:
    """canonical() of the label, from the row's own typed columns: what target() holds need not be read back from it."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    exact = lambda x, keys: [x.getField(k).cast(U.EXACT).alias(k) for k in keys]
    date = F.col("issue_date")
    forms = (
        company_name(shown(F.col("issuer.name"))),
        let(shown(F.col("issuer.registration_number")), lambda s: F.coalesce(registration_number(s), nfkc(s))),
        F.when(date != "", let(date, lambda s: F.coalesce(parse_date(s), nfkc(s)))).otherwise(""),
        company_name(shown(F.col("recipient.name"))),
        squeeze(nfkc(shown(F.col("invoice_number")))),
        F.col("tax_included"),
        F.col("grand_total").cast(U.EXACT),
        F.coalesce(F.transform("items", lambda i: F.struct(company_name(shown(i.description)).alias("description"), *exact(i, ITEM_KEYS[1:]))), F.array().cast(f"array<struct<description string, {', '.join(f'{k} {U.EXACT}' for k in ITEM_KEYS[1:])}>>")),
        F.coalesce(F.transform("totals", lambda t: F.struct(*exact(t, TOTAL_KEYS))), F.array().cast(f"array<struct<{', '.join(f'{k} {U.EXACT}' for k in TOTAL_KEYS)}>>")),
    )
    return F.struct(*[F.when(~F.col(f"{same}.{k}"), c).alias(k) for k, c in zip(FIELDS, forms, strict=True)])


def score(rows: DataFrame, predicted: str, wanted: str, n_items: Column | None = None) -> DataFrame:
    """rows with ok (struct of a boolean for each field), exact, items_correct, items_total, item_numbers_ok, item_text_ok,
    covered_exact, uncovered_exact, parsed. predicted, wanted: canonical() columns. Nothing is shuffled.

    A field that is null in both is right; items that are, because they are the same, are ``n_items``."""
    a, b = lambda k: F.col(f"{predicted}.{k}"), lambda k: F.col(f"{wanted}.{k}")
    ok = {k: a(k).eqNullSafe(b(k)) for k in FIELDS}
    every = lambda conditions: reduce(lambda x, y: x & y, conditions)
    both = F.arrays_zip(a("items").alias("p"), b("items").alias("g"))
    same_length = F.size(a("items")) == F.size(b("items"))
    numbers = same_length & F.forall(both, lambda z: every([z.p.getField(k).eqNullSafe(z.g.getField(k)) for k in ("quantity", "unit_price", "amount", "rate")]))
    words = same_length & F.forall(both, lambda z: z.p.description.eqNullSafe(z.g.description))
    # items that are null in both were found the same
    of_items = lambda c, if_same: c if n_items is None else F.when(b("items").isNull(), if_same).otherwise(c)
    s = rows.withColumns({
        "ok": F.struct(*[c.alias(k) for k, c in ok.items()]),
        "items_correct": of_items(F.size(F.filter(both, lambda z: z.g.isNotNull() & z.p.eqNullSafe(z.g))), n_items).cast("long"),
        "items_total": of_items(F.size(b("items")), n_items).cast("long"),
        "item_numbers_ok": of_items(numbers, F.lit(True)),
        "item_text_ok": of_items(words, F.lit(True)),
    })
    return s.withColumns({
        "exact": every([F.col(f"ok.{k}") for k in FIELDS]),
        "covered_exact": every([F.col(f"ok.{k}") for k in COVERED]) & F.col("item_numbers_ok"),
        "uncovered_exact": every([F.col(f"ok.{k}") for k in UNCOVERED]) & F.col("item_text_ok"),
    })
