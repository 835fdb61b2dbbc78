"""Rows that nobody vouches for: numbers of any size, repeated keys, values of wrong kinds, names that occur twice."""

import json
import re

from pyspark.sql import functions as F

from chobo.functions import tax, text, untyped
from chobo.operators import boxes, verify
from chobo.sources import readers

GOOD = {"issuer_name": "(株)甲", "registration_number": "T7000012050002", "issue_date": "2024-04-01", "recipient_name": "丁", "tax_included": False, "items": [{"description": "a", "quantity": 1, "unit_price": 1005, "amount": 1005, "rate": 10}], "totals": [{"rate": 10, "subtotal": 1005, "tax": 100}], "grand_total": 1105}
BIG = 10**30


def of(**more):
    return {**GOOD, **more}


def line(q, u, a, rate=10):
    return [{"description": "a", "quantity": q, "unit_price": u, "amount": a, "rate": rate}]


CASES = {
    "beyond 64 bits": (of(items=line(9 * 10**18, 10, 9 * 10**19), totals=[{"rate": 10, "subtotal": 9 * 10**19, "tax": 9 * 10**18}], grand_total=99 * 10**18), []),
    "large and wrong": (of(items=line(9 * 10**18, 10, 5), grand_total=BIG), ["tax:line_amount_mismatch", "tax:subtotal_mismatch", "tax:total_mismatch"]),
    "product": (of(items=line(BIG, BIG, 1005)), ["tax:out_of_range"]),
    "sum": (of(items=line(1, 9 * 10**37, 9 * 10**37) * 2), ["tax:out_of_range"]),
    "tax product": (of(totals=[{"rate": 10, "subtotal": 1005, "tax": 100}, {"rate": 8, "subtotal": 99 * 10**36, "tax": 1}]), ["tax:out_of_range", "tax:total_mismatch"]),
    "digits": (of(grand_total=10**40), ["schema:number_out_of_range"]),
    "digits of an item": (of(items=line(1, -(10**45), 1)), ["schema:number_out_of_range"]),
    "nothing to divide by": (of(tax_included=True, totals=[{"rate": 10, "subtotal": 1005, "tax": 91}, {"rate": -100, "subtotal": 0, "tax": 0}], grand_total=1005), ["tax:tax_mismatch"]),
    "rate": (of(totals=[{"rate": 10, "subtotal": 1005, "tax": 100}, {"rate": 10**37, "subtotal": 0, "tax": 0}]), []),
    "negative rate": (of(tax_included=True, totals=[{"rate": 10, "subtotal": 1005, "tax": 91}, {"rate": -150, "subtotal": 100, "tax": 300}], grand_total=1105), []),
    "fraction": (of(grand_total=1105.0), ["schema:grand_total_missing"]),
    "exponent": (of(items=line(1, 1005, 1e3)), ["schema:item_malformed"]),
}


def reasons(spark, texts, layers=("schema", "tax")):
    df = spark.createDataFrame(list(texts.items()), "k string, j string").repartition(2)
    rows = untyped.parsed(df, untyped.first_object(F.col("j")))
    return {r.k: r.reasons for r in verify.verify(rows, None, layers).collect()}


def test_numbers_of_any_size(spark):
    got = reasons(spark, {k: json.dumps(v[0]) for k, v in CASES.items()})
    assert got == {k: v[1] for k, v in CASES.items()}


GARBAGE = [None, True, False, 0, -1, 5.5, 10**18, 10**19, -(10**25), 10**60, 1e308, "", "x", "5", [], [None], [[]], ["a"], [5], {}, {"a": 1}, [{}], [{"rate": "10"}], [{"rate": 10, "subtotal": None, "tax": []}], float("nan")]


def test_garbage_ends_no_job(spark):
    """Any value in any place gives reasons, whatever the layers."""
    texts = {}
    for key in GOOD:
        for n, value in enumerate(GARBAGE):
            texts[f"{key}/{n}"] = json.dumps(of(**{key: value}))
    for inner in ("quantity", "unit_price", "amount", "rate", "description"):
        for n, value in enumerate(GARBAGE):
            texts[f"items.{inner}/{n}"] = json.dumps(of(items=[{**GOOD["items"][0], inner: value}]))
    for inner in ("rate", "subtotal", "tax"):
        for n, value in enumerate(GARBAGE):
            texts[f"totals.{inner}/{n}"] = json.dumps(of(totals=[{**GOOD["totals"][0], inner: value}]))
    texts |= {f"text/{n}": t for n, t in enumerate(["", "{", "}", "[]", "nul", "{}", '{"a"', "{\x00}", '{"items":' + "[" * 3000 + "]" * 3000 + "}"])}
    full = reasons(spark, texts, verify.LAYERS)
    assert set(full) == set(texts)
    for k, r in full.items():
        if k.startswith(("text/", "grand_total/")):
            assert any(x.startswith("schema:") or x == "tax:total_mismatch" for x in r), k
    assert full["totals.tax/7"] == ["tax:tax_mismatch", "tax:total_mismatch"]
    reasons(spark, texts, ("tax",))


def test_typed_columns(spark):
    """The check of labels, whose columns are longs, does not overflow either."""
    kind = "items array<struct<quantity bigint, unit_price bigint, amount bigint, rate int>>, totals array<struct<rate int, subtotal bigint, tax bigint>>, g bigint, i boolean"
    m = (1 << 63) - 1
    df = spark.createDataFrame([([(m, m, 1, 10), (1, 1, m, 8), (1, 1, m, 8)], [(10, m, m), (8, 1, 0)], m, False), ([], [], 0, False), ([(None, 1, 1, 10)], [(10, None, 1)], None, True)], kind)
    got = [r.t.errors for r in df.select(tax.check_tax(F.col("items"), F.col("totals"), F.col("g"), F.col("i")).alias("t")).collect()]
    assert got[0] == ["line_amount_mismatch", "subtotal_mismatch", "tax_mismatch", "total_mismatch"] and got[1] == []


def test_whole_numbers_for_scores(spark):
    given = ["12345678901234567890", "9007199254740993", "-5.9", "5.9", "1e20", '"△12345678901234567890123"', "1e60", "true", '"' + "9" * 50 + '"']
    s = spark.createDataFrame([(x,) for x in given], "j string").repartition(1).select(untyped.whole(F.parse_json("j")).cast("string").alias("n"))
    assert [r.n for r in s.collect()] == ["12345678901234567890", "9007199254740993", "-5", "5", "100000000000000000000", "-12345678901234567890123", None, None, None]


def test_predictions_keep_their_id(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "parsed": {"x": 1, "x": 2}}\n\n{"id": "z", "parsed": 1, "id": "b"}\nno json\n')
    got = [(r.id, r.p) for r in readers.predictions_json(spark, str(tmp_path)).select("id", F.to_json("parsed").alias("p"), "ordinal").orderBy("ordinal").collect()]
    assert got == [("a", '{"x":2}'), ("b", "1"), (None, None)]


def test_matches_with_places(spark):
    given = ["a1b22", "22", "", None, "x", "1 1 1", "é9﷐" + "7﷑", "いろ12は\n34"]
    df = spark.createDataFrame([(x,) for x in given], "t string").repartition(1)
    got = [[(m.at, m.text) for m in r.m] for r in df.select(text.matches_at(F.col("t"), "[0-9]+").alias("m")).collect()]
    assert got == [[(m.start(), m[0]) for m in re.finditer("[0-9]+", x or "")] for x in given]


def test_amounts(spark):
    df = spark.createDataFrame([("計 ￥1,200 と ３００円、" + "9" * 30,), ("なし",), (None,)], "t string")
    assert [r[0] for r in df.select(text.amounts_in(F.col("t"))).collect()] == [[1200, 300, None], [], None]


def test_recipient_is_the_match_before_the_cue(spark):
    box = lambda t, y: (t, [40.0, y, 400.0, y + 14.0], False)
    docs = [("a", [box("株式会社ああ 株式会社ああ 御中", 40.0)]), ("b", [box("株式会社ああ御中", 40.0), box("株式会社いい", 90.0), box("口座名義 株式会社うう", 140.0)])]
    df = spark.createDataFrame(docs, f"invoice_id string, lines array<{readers.BOX}>")
    got = {r.invoice_id: (r.issuer_name, r.recipient_name) for r in boxes.with_lines(df).select("invoice_id", boxes.names(boxes.name_votes(F.col("L"))).alias("n")).select("invoice_id", "n.*").collect()}
    assert got == {"a": ("株式会社ああ", "株式会社ああ"), "b": ("株式会社いい", "株式会社ああ")}


def test_runs_of_characters(spark):
    """A change of line begins a run, also back to an earlier line; blank runs, characters without extent or place are none."""
    def put(node, text, tops, vertical=False, left=None):
        return [("d", node, i, c, float(10 * i) if left is None else left[i], t, (float(10 * i) if left is None else left[i]) + 8.0, None if t is None else t + 8.0, vertical) for i, (c, t) in enumerate(zip(text, tops, strict=True))]

    rows = put(0, "ab cd", [40.0, 41.0, 41.0, 64.0, 64.0]) + put(1, "xyx", [10.0, 30.0, 10.0]) + put(2, "  ", [0.0, 0.0]) + put(3, "縦書", [5.0, 15.0], True, [30.0, 30.4]) + put(4, "n", [None]) + [("d", 5, 0, "z", 1.0, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "invoice_id string, node int, i int, character string, left double, top double, right double, bottom double, vertical boolean").repartition(3)
    got = boxes.runs_of_characters(df).first()
    assert [(x.text, x.box, x.vertical) for x in got.lines] == [("ab", [0.0, 40.0, 28.0, 49.0], False), ("cd", [30.0, 64.0, 48.0, 72.0], False), ("x", [0.0, 10.0, 8.0, 18.0], False), ("y", [10.0, 30.0, 18.0, 38.0], False), ("x", [20.0, 10.0, 28.0, 18.0], False), ("縦書", [30.0, 5.0, 38.4, 23.0], True)]
    assert "".join(x.text for x in boxes.extract(boxes.runs_of_characters(df)).select("invoice_id").withColumnRenamed("invoice_id", "text").collect()) == "d"
