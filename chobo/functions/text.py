"""Normalisation of Japanese text, amounts and company names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms of companies, in the order in which they are removed.
COMPANY_FORMS = ["株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "医療法人", "社会福祉法人", "学校法人"]
# Short forms, as they are after NFKC, and what they stand for.
SHORT_FORMS = {"(株)": "株式会社", "(有)": "有限会社", "(合)": "合同会社"}
WHITE = r"[\s\x{1c}-\x{1f}]"
"""White space as the records' producers count it; used with (?U)."""
PLAIN = "0-9A-Za-zぁ-ゖァ-ヺー一-鿿"
"""Characters, for a pattern's brackets, that are their own NFKC form whatever stands beside them, and no white space."""


def let(c: Column, use) -> Column:
    """use(c) for a costly c that it refers to more than once: c is computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def nfkc(c: Column) -> Column:
    """Unicode NFKC, by the ICU library that Spark ships; null stays null.

    Catalyst takes the call for non-deterministic, so it may not stand in a join condition: project it first.
    """
    compose = lambda s: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), s, F.lit(True))
    # plain ASCII, as many bytes as characters, is its own form
    return let(c.cast("string"), lambda s: F.when((F.octet_length(s) == F.length(s)) | s.rlike(rf"^[{PLAIN}]*\z"), s).when(s.isNotNull(), compose(s)))


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() would take the blank alone."""
    return F.regexp_replace(c, rf"(?U)^{WHITE}+|{WHITE}+$", "")


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, rf"(?U){WHITE}+", "")


def _amount(c: Column, kind: str) -> Column:
    def read(s: Column) -> Column:
        n = F.regexp_replace(s, "[^0-9]", "").try_cast(kind)
        return F.when(s.rlike("^[△▲−-]|[△▲]"), -n).otherwise(n)

    # digits with commas need neither
    return let(c.cast("string"), lambda s: F.when(s.rlike(r"^¥?[0-9,]+\z"), F.translate(s, "¥,", "").try_cast(kind)).otherwise(let(strip(nfkc(s)), read)))


def yen(c: Column) -> Column:
    """Amount as a long: all digits of the text joined; negative after a leading minus or with △ or ▲; null without digits
    and for more than 64 bits."""
    return _amount(c, "long")


def yen_exact(c: Column) -> Column:
    """The same as a decimal of up to 38 digits."""
    return _amount(c, "decimal(38,0)")


def shown_name(s: Column) -> Column:
    """company_name() of a text column: a name of plain characters is its own form, in generated code."""
    long = nfkc(s)
    for short, full in SHORT_FORMS.items():
        long = F.replace(long, F.lit(short), F.lit(full))
    return F.when(s.rlike(rf"^[{PLAIN}]*\z"), s).otherwise(squeeze(long))


def company_name(c: Column) -> Column:
    """Comparable form: NFKC, short legal forms spelled out, no white space."""
    return let(c.cast("string"), shown_name)


def without_form(name: Column) -> Column:
    """A company_name() without its legal forms."""
    for form in COMPANY_FORMS:
        name = F.replace(name, F.lit(form), F.lit(""))
    return name


def company_core(c: Column) -> Column:
    return without_form(company_name(c))


def match_names(printed: Column, registered: Column) -> Column:
    """exact, same_core (equal without legal forms, and not empty) or different, of two company_name() columns."""
    core = without_form(printed)
    return F.when(printed == registered, "exact").when((core == without_form(registered)) & (core != ""), "same_core").otherwise("different")


def name_match(printed: Column, registered: Column) -> Column:
    return match_names(company_name(printed), company_name(registered))


def full_width(c: Column) -> Column:
    return F.translate(c, "0123456789", "０１２３４５６７８９")


def format_yen(n: Column, style: Column) -> Column:
    """¥1,234 (0), ￥１，２３４ (1), 1,234円 (2) or 1,234 (3)."""
    plain = F.format_number(n, 0)
    return F.when(style == 0, F.concat(F.lit("¥"), plain)).when(style == 1, F.concat(F.lit("￥"), F.replace(full_width(plain), F.lit(","), F.lit("，")))).when(style == 2, F.concat(plain, F.lit("円"))).otherwise(plain)


def matches_at(c: Column, pattern: str) -> Column:
    """All matches of a Java pattern, from left to right: array of at (characters before it), text.

    Each match is put between two marks first, so that splitting tells where it stood; marks that a text itself holds
    count as the replacement character. Null has no matches; empty matches have empty texts.
    """
    opening, closing = "\ufdd0", "\ufdd1"
    marked = F.regexp_replace(F.translate(c, opening + closing, "\ufffd\ufffd"), f"({pattern})", f"{opening}$1{closing}")

    def places(pieces: Column) -> Column:
        # a piece is a match, the closing mark and what follows; the first one is what precedes all matches
        start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.expr("cast(array() as array<struct<at int, text string>>)").alias("found"))

        def add(a: Column, piece: Column) -> Column:
            size = F.locate(closing, piece) - 1
            one = F.struct(a.at.alias("at"), F.substring(piece, F.lit(1), size).alias("text"))
            return F.struct((a.at + F.length(piece) - 1).alias("at"), F.concat(a.found, F.array(one)).alias("found"))

        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, add, lambda a: a.found)

    found = let(F.split(marked, opening, -1), places)
    return F.coalesce(found, F.expr("cast(array() as array<struct<at int, text string>>)"))


def amounts_in(c: Column) -> Column:
    """All amounts printed in a text, in order."""
    found = F.regexp_extract_all(nfkc(c), F.lit(r"([¥￥]?\s*[0-9][0-9,，]*\s*円?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "").try_cast("long"))


def printed_values(g: dict[str, Column], style: Column) -> Column:
    """Array of all texts that an invoice's page must show, in their order.

    g: issuer_name, registration_number, address, recipient_name, invoice_number, printed_date, grand_total, items
    (description, quantity, unit_price, amount), totals (rate, subtotal, tax). style: of format_yen.
    """
    amount = lambda n: format_yen(n, style)
    head = [*(g[k] for k in ("issuer_name", "registration_number", "address", "recipient_name", "invoice_number", "printed_date")), amount(g["grand_total"])]
    items = F.transform(g["items"], lambda i: F.array(i.description, i.quantity.cast("string"), amount(i.unit_price), amount(i.amount)))
    totals = F.transform(g["totals"], lambda t: F.array(F.concat(t.rate.cast("string"), F.lit("%")), amount(t.subtotal), amount(t.tax)))
    return F.concat(F.array(*head), F.flatten(items), F.flatten(totals))


def printed_missing(values: Column, page: Column) -> Column:
    """Those of an array of printed values that the page's text does not hold, both compared as NFKC without white space."""
    return let(squeeze(nfkc(page)), lambda text: F.filter(values, lambda v: ~F.contains(text, squeeze(nfkc(v)))))
