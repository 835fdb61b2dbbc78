"""Fictitious issuers, their registry, and invoices with known faults, drawn by hash from the keys of given rows.

Draws are md5 of salt and key, so a row's values depend on its key alone, in any order and on any number of machines.
Where a draw may be unusable (a number that exists, a total that some rounding explains) it is made among the usable
values, or the first usable one of a few proposals is taken; nothing is drawn again and again on one machine. What a
round has given is written to the shared folder, since the next round and the result both read it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chobo.functions.checkdigit import corporate_number
from chobo.functions.tax import ROUNDINGS, check_tax, expected_tax
from chobo.functions.text import company_name
from chobo.sources.folders import written

FORMS = ("株式会社", "有限会社", "合同会社")
PLACES = ("東京都千代田区", "大阪府北区", "愛知県中区", "福岡県博多区", "北海道中央区")
TRADES = ("商店", "工務店", "製作所", "運輸", "食品")
#: Of a hundred issuers these many round down, half up, up; have a seal; of decoys these many are active, expired, revoked.
ROUNDING_SHARES, SEAL_SHARE, PROCESS_SHARES = (50, 35, 15), 70, (85, 9, 6)
#: Structures and skins of pages; those of the hold-out are in no other split.
STRUCTURES, SKINS = ("h_classic", "h_banded", "h_compact", "v_header"), ("k0", "k1", "k2", "k3", "k4")
HOLDOUT_STRUCTURES, HOLDOUT_SKINS = ("h_twocol", "v_columns"), ("k5", "k6")
#: Kinds of document issues, quantities, how often in a hundred a seal covers text, kinds of printed numbers.
ISSUES = ("reg_no_check_digit", "reg_no_unregistered", "reg_no_other_company", "reg_no_revoked", "tax_total_wrong")
QUANTITIES, OVERLAP_SHARE, NUMBER_HEADS = (1, 1, 2, 3, 5, 10, 12), 25, ("INV", "No.", "R")
LAST_ISSUE_DAY = "2026-09-30"
SURNAMES = ("青木", "井上", "上田", "遠藤", "岡本", "加藤", "木村", "久保")
#: What fictitious companies sell: description, least and largest price, rate. Food at the lower rate is marked.
PRODUCTS = (("文具一式", 300, 900, 10), ("トナー", 4000, 16000, 10), ("清掃", 9000, 45000, 10), ("保守", 15000, 80000, 10), ("印刷", 1200, 30000, 10), ("配送", 700, 5000, 10), ("会場費", 5000, 20000, 10), ("延長コード", 600, 1500, 10), ("※飲料水", 90, 1000, 8), ("※弁当", 500, 1100, 8), ("※茶葉", 700, 2000, 8), ("※焼き菓子", 1000, 3300, 8))
FIRST_DAYS = ("2023-10-01", "2023-10-01", "2024-04-01", "2025-01-15")
OFFSETS = (-100, -10, -3, -2, -1, 1, 2, 3, 10, 100)
BUCKET = 16


def draw(key: Column, salt: str, n) -> Column:
    """A number from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 12), 16, 10).cast("long") % n


def pick(key: Column, salt: str, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(key, salt, len(values)) + 1).cast("int"))


def by_share(key: Column, salt: str, values, shares) -> Column:
    """One of the values, as often in a hundred as its share says."""
    d, upto, out = draw(key, salt, 100), 0, None
    for value, share in zip(values[:-1], shares[:-1], strict=True):
        upto += share
        out = (F if out is None else out).when(d < upto, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def first_free(keys: DataFrame, propose: Callable[[Column], Column], taken: DataFrame, tries: int = 4, same: Callable[[Column], Column] = lambda c: c, unique: bool = True) -> DataFrame:
    """key, value: for each of ``keys`` (key, text) its first proposal that is not in ``taken`` (value) and no other key's.

    propose: a value from the text of a key and an attempt. Of keys that propose the same, the least gets it. Each round
    makes ``tries`` proposals a key; keys left without one go on to the next. Not ``unique``: each key gets its own first
    proposal that is not taken, whatever the other keys get.
    """
    left, used, done, at = keys.select("key").distinct(), taken.select(same(F.col("value")).alias("k")), None, 0
    while True:
        tried = left.select("key", F.explode(F.sequence(F.lit(at), F.lit(at + tries - 1))).alias("attempt"))
        tried = tried.withColumn("value", propose(F.concat("key", F.lit("/"), F.col("attempt").cast("string")))).withColumn("k", same(F.col("value")))
        free = tried.join(used, "k", "left_anti")
        first = free.groupBy("key").agg(F.min(F.struct("attempt", "value", "k")).alias("f")).select("key", "f.value", "f.k")
        given = written(first.groupBy("k").agg(F.min(F.struct("key", "value")).alias("g")).select("g.key", "g.value", "k") if unique else first)
        done = given if done is None else done.unionByName(given)
        used, at = used.union(given.select("k")) if unique else used, at + tries
        left = left.join(given, "key", "left_anti")
        if left.isEmpty():
            return done.select("key", "value")


def mint_numbers(keys: DataFrame, taken: DataFrame, salt: str = "number", unique: bool = True) -> DataFrame:
    """key, reg_no: a valid number for each key (text) that ``taken`` (reg_no) does not hold, nor another key if ``unique``."""
    number = lambda k: F.concat(F.lit("T"), corporate_number(F.concat((draw(k, f"{salt}-a", 9) + 1).cast("string"), F.lpad(draw(k, f"{salt}-b", 10**11).cast("string"), 11, "0"))))
    return first_free(keys, number, taken.select(F.col("reg_no").alias("value")), unique=unique).withColumnRenamed("value", "reg_no")


def unique_names(keys: DataFrame, taken: DataFrame, salt: str = "name", unique: bool = True) -> DataFrame:
    """key, name: a company's name for each key that, in comparable form, neither ``taken`` (name) holds nor another key (the
    latter if ``unique``)."""
    name = lambda k: F.concat(pick(k, f"{salt}-f", FORMS), F.lit("架空"), draw(k, f"{salt}-n", 10**9).cast("string"), pick(k, f"{salt}-t", TRADES))
    return first_free(keys, name, taken.select(F.col("name").alias("value")), same=company_name, unique=unique).withColumnRenamed("value", "name")


def address(key: Column) -> Column:
    part = lambda salt, n: (draw(key, salt, n) + 1).cast("string")
    return F.concat(pick(key, "place", PLACES), part("chome", 9), F.lit("丁目"), part("ban", 30), F.lit("番"), part("go", 20), F.lit("号"))


def phone(key: Column) -> Column:
    return F.concat(F.lit("0"), pick(key, "area", ("3", "6", "52", "92", "11", "22")), F.lit("-"), (draw(key, "exchange", 9000) + 1000).cast("string"), F.lit("-"), (draw(key, "line", 9000) + 1000).cast("string"))


def person_name(key: Column) -> Column:
    """A sole proprietor's trade name."""
    return F.concat(pick(key, "surname", SURNAMES), pick(key, "trade", TRADES))


def layout_of(template: Column) -> Column:
    return F.when(F.startswith(template, F.lit("v_")), "vertical").otherwise("horizontal")


def template_of(split: Column, ordinal: Column) -> Column:
    """The page of the n-th invoice of a split: structure__skin, every one in turn; the hold-out has pages of its own."""

    def turn(structures, skins):
        names = [f"{a}__{b}" for a in structures for b in skins]
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(ordinal, F.lit(len(names))) + 1).cast("int"))

    return F.when(split == "holdout", turn(HOLDOUT_STRUCTURES, HOLDOUT_SKINS)).otherwise(turn(STRUCTURES, SKINS))


def drawn_items(key: Column) -> Column:
    """array of description, quantity, unit_price, amount, rate: two to seven different products, each at a price in its
    range, in whole tens where prices exceed a thousand."""
    number = lambda n: F.lit(n).cast("long")
    shelf = [F.struct(F.md5(F.concat(F.lit("item:"), key, F.lit(f"/{j}"))).alias("h"), F.concat(key, F.lit(f"/{j}")).alias("k"), F.lit(d).alias("d"), number(lo).alias("lo"), number(10 if hi > 1000 else 1).alias("step"), number((hi - lo) // (10 if hi > 1000 else 1) + 1).alias("n"), F.lit(rate).alias("rate")) for j, (d, lo, hi, rate) in enumerate(PRODUCTS)]
    chosen = F.slice(F.array_sort(F.array(*shelf)), F.lit(1), (draw(key, "items", 6) + 2).cast("int"))
    priced = F.transform(chosen, lambda p: F.struct(p.d.alias("d"), pick(p.k, "quantity", QUANTITIES).cast("long").alias("q"), (p.lo + p.step * draw(p.k, "price", p.n)).alias("u"), p.rate.alias("rate")))
    return F.transform(priced, lambda p: F.struct(p.d.alias("description"), p.q.alias("quantity"), p.u.alias("unit_price"), (p.q * p.u).alias("amount"), p.rate.alias("rate")))


def draw_invoices(orders: DataFrame, issuers: DataFrame, recipients: DataFrame, n_recipients: int, issue_share: int = 12) -> DataFrame:
    """Everything about invoices that is drawn, for make_invoices(): id, issuer, split, template, layout, recipient_name,
    items, issue_date, date_style, yen_style, invoice_number, seal, seal_overlap, issue.

    orders: id (long), issuer (a key of ``issuers``), split, ordinal; recipients: number (0 to n_recipients - 1), name;
    issue_share: how many in a hundred have a document issue. A day is not before the issuer's first one.
    """
    k = F.col("id").cast("string")
    s = orders.join(issuers.select(F.col("key").alias("issuer"), "seal", "registered"), "issuer").withColumn("number", draw(k, "recipient", n_recipients))
    s = s.join(recipients.select("number", F.col("name").alias("recipient_name")), "number")
    first = F.greatest(F.lit("2023-10-01"), "registered").cast("date")
    day = F.date_add(first, draw(k, "day", (F.datediff(F.lit(LAST_ISSUE_DAY).cast("date"), first) + 1).cast("long")).cast("int"))
    template = template_of(F.col("split"), F.col("ordinal"))
    return s.select(
        "id", "issuer", "split", template.alias("template"), layout_of(template).alias("layout"), "recipient_name", drawn_items(k).alias("items"), day.cast("string").alias("issue_date"),
        draw(k, "date-style", 6).cast("int").alias("date_style"), draw(k, "yen-style", 4).cast("int").alias("yen_style"), F.concat(pick(k, "number-head", NUMBER_HEADS), F.lit("-"), (draw(k, "number", 99_000) + 1000).cast("string")).alias("invoice_number"),
        "seal", (F.col("seal") & (draw(k, "overlap", 100) < OVERLAP_SHARE)).alias("seal_overlap"), F.when(draw(k, "has-issue", 100) < issue_share, pick(k, "issue", ISSUES)).alias("issue"),
    )


def generation_summary(drawn: DataFrame, made: DataFrame) -> DataFrame:
    """counter, value, n: invoices by template, issue (none if there is none) and layout, those whose seal covers text, and
    of those without issue how many there are and pass the tax check. One aggregation by grouping sets."""
    errors = check_tax(F.col("items"), F.col("totals"), F.col("grand_total"), F.col("tax_included")).getField("ok")
    s = made.select("id", errors.alias("ok")).join(drawn.select("id", "template", "layout", "seal_overlap", F.coalesce("issue", F.lit("none")).alias("issue")), "id")
    sets = [[], ["template"], ["issue"], ["layout"]]
    clean = F.col("issue") == "none"
    s = s.withColumns({"__clean": clean.cast("long"), "__pass": (clean & F.col("ok")).cast("long")})
    g = s.groupingSets([[F.col(c) for c in x] for x in sets], F.col("template"), F.col("issue"), F.col("layout")).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("seal_overlap").alias("seal"), F.coalesce(F.sum("__clean"), F.lit(0)).alias("clean"), F.coalesce(F.sum("__pass"), F.lit(0)).alias("passed"))
    one = lambda counter, value, n: F.struct(F.lit(counter).alias("counter"), value.alias("value"), n.cast("long").alias("n"))
    whole = F.array(*[one(c, F.lit(""), F.col(n)) for c, n in (("total", "n"), ("seal_overlap", "seal"), ("tax_checker_clean_total", "clean"), ("tax_checker_clean_pass", "passed"))])
    rows = F.when(F.col("g") == 7, whole)
    for g_id, c in ((3, "template"), (5, "issue"), (6, "layout")):
        rows = rows.when(F.col("g") == g_id, F.array(one(f"by_{c}", F.col(c), F.col("n"))))
    return g.select(F.explode(rows).alias("r")).select("r.*")


def build_issuers(keys: DataFrame, real: DataFrame, unique: bool = True) -> DataFrame:
    """key, reg_no, name, address, phone, rounding, seal, registered of each key; numbers and names are not in ``real``, and
    no two keys' are the same if ``unique``."""
    k = F.col("key")
    both = mint_numbers(keys, real, unique=unique).join(unique_names(keys, real, unique=unique), "key")
    return both.withColumns({"address": address(k), "phone": phone(k), "rounding": by_share(k, "rounding", ROUNDINGS, ROUNDING_SHARES), "seal": draw(k, "seal", 100) < SEAL_SHARE, "registered": pick(k, "registered", FIRST_DAYS)})


def build_registry(issuers: DataFrame, decoys: DataFrame, real: DataFrame, unique: bool = True) -> DataFrame:
    """The issuers, all active, and a fictitious company for each key of ``decoys``, some expired or revoked."""
    k = F.col("key")
    taken = real.select("reg_no", "name").union(issuers.select("reg_no", "name"))
    others = mint_numbers(decoys, taken, "decoy", unique).join(unique_names(decoys, taken, "decoy-name", unique), "key").withColumn("process", by_share(k, "process", ("01", "03", "04"), PROCESS_SHARES))
    when = lambda process, salt, days: F.when(F.col("process") == process, pick(k, salt, days)).otherwise("")
    others = others.select("reg_no", "name", address(k).alias("address"), "process", pick(k, "decoy-day", ("2023-10-01", "2024-04-01")).alias("registered"), when("04", "revoked", ("2025-06-30", "2026-01-31")).alias("revoked"), when("03", "expired", ("2025-03-31", "2026-03-31")).alias("expired"))
    return issuers.select("reg_no", "name", "address", F.lit("01").alias("process"), "registered", F.lit("").alias("revoked"), F.lit("").alias("expired")).unionByName(others)


def overlap(generated: DataFrame, real: DataFrame) -> DataFrame:
    """One row: numbers in either table, and in both."""
    a, b = generated.select("reg_no"), real.select("reg_no")
    both = a.intersect(b).agg(F.count("*").alias("in_both"))
    return a.union(b).distinct().agg(F.count("*").alias("in_either")).crossJoin(both)


def other_company(invoices: DataFrame, registry: DataFrame, process: str = "01", by_day: bool = True, probes: int = 3) -> DataFrame:
    """id, decoy, revoked: for each of ``invoices`` (id, reg_no, issue_date) another company of that process, and when it was revoked.

    by_day: only companies registered by the invoice's day. Companies lie in buckets of about BUCKET by hash; an invoice
    looks into ``probes`` of them at once and takes the first that serves, so no company and no day is a hot key.
    Invoices that found none look further; null only where the registry has no such company.
    """
    active = registry.filter(F.col("process") == process).select(F.col("reg_no").alias("decoy"), "registered", "revoked")
    buckets = max(1, active.count() // BUCKET)
    active = active.withColumn("bucket", draw(F.col("decoy"), "bucket", buckets))
    key = F.col("id").cast("string")
    left, done, at = invoices.select("id", "reg_no", "issue_date"), None, 0
    while True:
        probe = F.explode(F.sequence(F.lit(at), F.lit(min(at + probes, buckets) - 1))).alias("probe")
        asked = left.select("id", "reg_no", "issue_date", probe).withColumn("bucket", (draw(key, "decoy", buckets) + F.col("probe")) % buckets)
        fits = asked.join(active, "bucket").filter(F.col("decoy") != F.col("reg_no"))
        fits = fits.filter(F.col("registered") <= F.col("issue_date")) if by_day else fits
        found = written(fits.groupBy("id").agg(F.min(F.struct("probe", F.md5(F.concat(key, "decoy")).alias("h"), "decoy", "revoked")).alias("f")).select("id", "f.decoy", "f.revoked"))
        done = found if done is None else done.unionByName(found)
        left, at = left.join(found, "id", "left_anti"), at + probes
        if at >= buckets or left.isEmpty():
            none = F.lit(None).cast("string")
            return done.unionByName(left.select("id", none.alias("decoy"), none.alias("revoked")))


def broken_number(key: Column, reg_no: Column) -> Column:
    """The number with one digit changed so that its check digit fails: by any change but that of 0 to 9 or of 9 to 0."""
    at = (draw(key, "place-of-fault", 13) + 2).cast("int")
    old = F.substr(reg_no, at, F.lit(1)).cast("int")
    usable = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: ~F.abs(d - old).isin(0, 9))
    new = F.get(usable, draw(key, "fault", F.size(usable)).cast("int")).cast("string")
    return F.concat(F.substr(reg_no, F.lit(1), at - 1), new, F.substr(reg_no, at + 1, F.lit(14)))


def wrong_tax(key: Column, subtotal: Column, rate: Column, included: Column, tax: Column) -> Column:
    """A tax near the true one, not negative, that no rounding explains."""
    right = F.array(*[expected_tax(subtotal, rate, included, r) for r in ROUNDINGS])
    usable = F.filter(F.array(*[tax + o for o in OFFSETS]), lambda x: (x >= 0) & ~F.array_contains(right, x))
    return F.get(usable, draw(key, "wrong-tax", F.size(usable)).cast("int"))


def exact_sample(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """Exactly n rows (all, if there are fewer) without replacement: those with the least hashes."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string"))), key).limit(n)


def totals_of(items: Column, included: Column, rounding: Column) -> Column:
    """array of rate, subtotal, tax, the higher rate first, of items (rate, amount), by the issuer's rounding."""

    def one(rate: int) -> Column:
        own = F.filter(items, lambda i: i.rate == rate)
        subtotal = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x.amount)
        tax = reduce(lambda out, r: out.when(rounding == r, expected_tax(subtotal, F.lit(rate), included, r)), ROUNDINGS[1:], F.when(rounding == ROUNDINGS[0], expected_tax(subtotal, F.lit(rate), included, ROUNDINGS[0])))
        return F.when(F.size(own) > 0, F.struct(F.lit(rate).alias("rate"), subtotal.alias("subtotal"), tax.alias("tax")))

    return F.array_compact(F.array(one(10), one(8)))


def make_invoices(orders: DataFrame, issuers: DataFrame, registry: DataFrame) -> DataFrame:
    """invoice_id, reg_no, true_number, issue_date, tax_included, rounding, items, totals, grand_total, issue of each order.

    orders: id, issuer (a key of ``issuers``), issue_date, issue (null, reg_no_check_digit, reg_no_unregistered,
    reg_no_other_company, reg_no_revoked or tax_total_wrong), items (description, quantity, unit_price, amount, rate).
    Three in ten include the tax. A revoked number is one of ``registry``, and the day follows its revocation.
    """
    k = F.col("id").cast("string")
    s = orders.join(issuers.select(F.col("key").alias("issuer"), F.col("reg_no").alias("true_number"), "rounding"), "issuer")
    s = s.withColumn("tax_included", draw(k, "included", 10) < 3).withColumn("totals", totals_of(F.col("items"), F.col("tax_included"), F.col("rounding")))
    hit = draw(k, "which-total", F.greatest(F.size("totals"), F.lit(1)))
    wrong = F.transform("totals", lambda t, i: F.when(i == hit, t.withField("tax", wrong_tax(k, t.subtotal, t.rate, F.col("tax_included"), t.tax))).otherwise(t))
    s = s.withColumn("totals", F.when(F.col("issue") == "tax_total_wrong", wrong).otherwise(F.col("totals")))
    s = written(s)  # read by each kind of issue
    asking = lambda issue: s.filter(F.col("issue") == issue).select("id", F.col("true_number").alias("reg_no"), "issue_date")
    others = other_company(asking("reg_no_other_company"), registry).select("id", F.col("decoy").alias("other_no"))
    gone = other_company(asking("reg_no_revoked"), registry, "04", False).select("id", F.col("decoy").alias("gone_no"), F.col("revoked").alias("gone_day"))
    unknown = mint_numbers(s.filter("issue = 'reg_no_unregistered'").select(k.alias("key")), registry, "unregistered")
    unknown = unknown.select(F.col("key").cast("long").alias("id"), F.col("reg_no").alias("minted"))
    # only invoices that ask for another number are joined; all others stay where they are
    asks = F.coalesce(F.col("issue").isin("reg_no_other_company", "reg_no_unregistered", "reg_no_revoked"), F.lit(False))
    none = F.lit(None).cast("string")
    told = s.filter(asks).join(others, "id", "left").join(unknown, "id", "left").join(gone, "id", "left")
    s = told.unionByName(s.filter(~asks).withColumns({c: none for c in ("other_no", "minted", "gone_no", "gone_day")}))
    number = F.when(F.col("issue") == "reg_no_check_digit", broken_number(k, F.col("true_number"))).otherwise(F.coalesce("other_no", "minted", "gone_no", "true_number"))
    day = F.coalesce(F.date_add(F.col("gone_day").cast("date"), (draw(k, "after", 196) + 5).cast("int")).cast("string"), F.col("issue_date"))
    add = lambda c: F.aggregate("totals", F.lit(0).cast("long"), lambda a, t: a + t[c])
    grand = add("subtotal") + F.when(F.col("tax_included"), F.lit(0)).otherwise(add("tax"))
    return s.select("id", F.concat(F.lit("inv_"), F.lpad(k, 6, "0")).alias("invoice_id"), number.alias("reg_no"), "true_number", day.alias("issue_date"), "tax_included", "rounding", "items", "totals", grand.alias("grand_total"), "issue")
