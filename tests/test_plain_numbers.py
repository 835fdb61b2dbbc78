"""Verification of plain whole numbers, names, dates and numbers by generated code says what the exact one says."""

import json

import pytest
from pyspark.sql import functions as F

from chobo.functions import text
from chobo.functions.checkdigit import registration_number
from chobo.functions.dates import parse_date
from chobo.operators import evaluation, verification_eval, verify

ITEM, TOTAL = {"description": "品", "quantity": 2, "unit_price": 50, "amount": 100, "rate": 10}, {"rate": 10, "subtotal": 100, "tax": 10}
HEAD = {"issuer_name": "甲商店", "registration_number": "T1010001002431", "issue_date": "2024-01-02", "recipient_name": "乙", "invoice_number": "1", "tax_included": False, "grand_total": 110}


def extraction(items=(ITEM,), totals=(TOTAL,), **more) -> str:
    return json.dumps({**HEAD, "items": [*items], "totals": [*totals], **more})


TEXTS = {
    "good": extraction(),
    "line": extraction([{**ITEM, "amount": 101}]),
    "line at another rate": extraction([ITEM, {**ITEM, "rate": 5, "amount": 1}]),
    "rate missing": extraction([ITEM, {**ITEM, "rate": 8}]),
    "subtotal": extraction(totals=[{**TOTAL, "subtotal": 101}]),
    "tax": extraction(totals=[{**TOTAL, "tax": 30}], grand_total=130),
    "total": extraction(grand_total=111),
    "included": extraction(tax_included=True, totals=[{**TOTAL, "tax": 9}], grand_total=100),
    "roundings": extraction(items=[{**ITEM, "unit_price": 7, "amount": 14}], totals=[{"rate": 10, "subtotal": 14, "tax": 2}], grand_total=16),
    "each by another": extraction([{**ITEM, "amount": 15, "quantity": 1, "unit_price": 15}, {**ITEM, "rate": 8, "quantity": 1, "unit_price": 16, "amount": 16}], [{"rate": 10, "subtotal": 15, "tax": 1}, {"rate": 8, "subtotal": 16, "tax": 2}], grand_total=34),
    "negative": extraction([{**ITEM, "quantity": -2, "amount": -100}], [{"rate": 10, "subtotal": -100, "tax": -10}], grand_total=-110),
    "zero rate": extraction([{**ITEM, "rate": 0}], [{"rate": 0, "subtotal": 100, "tax": 0}], grand_total=100),
    "stated twice": extraction(totals=[TOTAL, {**TOTAL, "subtotal": 5}], grand_total=115),
    "below zero": extraction(totals=[{**TOTAL, "rate": -100}]),
    "large": extraction([{**ITEM, "quantity": 10**12, "unit_price": 10**12, "amount": 10**24}]),
    "far": extraction([{**ITEM, "amount": 10**40}]),
    "fraction": extraction([{**ITEM, "quantity": 2.0}]),
    "text": extraction([{**ITEM, "quantity": "2"}]),
    "flag": extraction([{**ITEM, "rate": True}]),
    "null": extraction([{**ITEM, "amount": None}]),
    "lacks": extraction([ITEM, {k: v for k, v in ITEM.items() if k != "rate"}]),
    "no description": extraction([ITEM, {**ITEM, "description": None}]),
    "null item": extraction([ITEM, None]),
    "null total": extraction(totals=[TOTAL, None]),
    "more keys": extraction([{**ITEM, "z": 1}]),
    "no items": extraction([]),
    "no totals": extraction(totals=[]),
    "object": extraction(items={}),
    "grand text": extraction(grand_total="110"),
    "grand fraction": extraction(grand_total=110.0),
    "large grand": extraction(grand_total=10**18),
    "blank name": extraction(issuer_name="　 "),
    "no date": extraction(issue_date=""),
    "no day": extraction(issue_date="2024-02-30"),
    "era": extraction(issue_date="令和6年1月2日"),
    "no object": "[1]",
    "nothing": None,
}
WANT = {  # of the exact checks alone, before plain numbers had their own
    "good": [], "line": ["tax:line_amount_mismatch", "tax:subtotal_mismatch"], "line at another rate": ["tax:unknown_rate"], "rate missing": ["tax:rate_missing"], "subtotal": ["tax:subtotal_mismatch", "tax:total_mismatch"],
    "tax": ["tax:tax_mismatch"], "total": ["tax:total_mismatch"], "zero rate": ["tax:unknown_rate"], "large": ["tax:subtotal_mismatch"], "far": ["schema:number_out_of_range"], "fraction": ["schema:item_malformed"], "text": ["schema:item_malformed"],
    "flag": ["schema:item_malformed"], "null": ["schema:item_malformed"], "lacks": ["schema:item_malformed"], "no description": ["schema:item_malformed"], "null item": ["schema:item_malformed"], "null total": ["schema:total_malformed"], "more keys": [],
    "no items": ["schema:items_missing"], "no totals": ["schema:totals_missing"], "object": ["schema:items_missing"], "grand text": ["schema:grand_total_missing"], "grand fraction": ["schema:grand_total_missing"], "blank name": ["schema:issuer_name_missing"],
    "no date": ["schema:issue_date_missing"], "no day": ["schema:date_invalid"], "era": [], "no object": ["schema:not_an_object"], "nothing": ["schema:not_an_object"], "included": [], "roundings": [], "each by another": [], "negative": [],
}


def judged(spark):
    df = spark.createDataFrame([*TEXTS.items()], "id string, j string").select("id", F.try_parse_json("j").alias("parsed"))
    return {r.id: r for r in verify.verify(df, None, ("schema", "tax")).drop("parsed").collect()}


def test_plain_numbers_are_judged_as_exact_ones(spark, monkeypatch):
    got = judged(spark)
    assert {k: v.reasons for k, v in got.items() if k in WANT} == WANT
    assert got["roundings"].tax_convention == ["ceil"] and got["each by another"].tax_convention == [] and got["included"].tax_convention == ["floor", "half_up"]
    monkeypatch.setattr(verify, "MOST_ROWS", 0)  # no list is plain
    monkeypatch.setattr(verify, "WHOLE_KIND", "none")
    assert judged(spark) == got


def test_plain_check_is_used_where_it_may(spark):
    rows = spark.createDataFrame([*TEXTS.items()], "id string, j string").select("id", F.try_parse_json("j").alias("parsed"))
    plain = {r.id for r in verify.with_plain(rows, F.col("parsed")).filter("__i is not null and __t is not null").select("id").collect()}
    assert {"good", "line", "tax", "negative", "grand text", "era"} <= plain
    assert not plain & {"stated twice", "below zero", "large", "far", "fraction", "text", "flag", "null", "lacks", "no description", "null item", "null total", "no items", "no totals", "object", "no object", "nothing"}


@pytest.mark.parametrize(("given", "name", "day", "number"), [
    ("甲商店", "甲商店", None, None), ("(株)ア", "株式会社ア", None, None), ("ｱ", "ア", None, None), ("が", "が", None, None), ("a b", "ab", None, None), ("", "", None, None), (None, None, None, None), ("2024-02-29", "2024-02-29", "2024-02-29", None),
    ("0000-01-01", "0000-01-01", None, None), ("2023-02-29", "2023-02-29", None, None), ("2024-02-29\n", "2024-02-29", "2024-02-29", None), ("T1010001002431", "T1010001002431", None, "T1010001002431"), ("Ｔ－１０１０００１００２４３１", "T-1010001002431", None, "T1010001002431"),
])
def test_short_cuts_of_texts(spark, given, name, day, number):
    c = F.col("t")
    r = spark.createDataFrame([(given,)], "t string").select(text.company_name(c).alias("name"), parse_date(c).alias("day"), registration_number(c).alias("number")).first()
    assert (r.name, r.day, r.number) == (name, day, number)


def test_levels_of_counted_kinds(spark):
    flag = lambda n: (F.col("id") % n == 0)
    rows = spark.range(500).select(flag(2).alias("exact"), flag(3).alias("covered_exact"), flag(5).alias("uncovered_exact"), flag(7).alias("has_issue"), (F.col("id") % 6 + 1).cast("int").alias("first_level"))
    want = verification_eval.levels(rows).groupBy("level", "metric").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("k")).collect()
    got = verification_eval.level_counts(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 42
    plain = evaluation.intervals(verification_eval.levels(rows), ["level", "metric"]).collect()
    assert sorted(map(tuple, verification_eval.level_intervals(rows).collect())) == sorted(map(tuple, plain))
