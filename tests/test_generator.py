from pyspark.sql import functions as F

from chobo.functions import tax, text, untyped
from chobo.functions.checkdigit import is_registration_number
from chobo.operators import generator, registry, verify
from chobo.sources import readers, writers


def test_first_free_moves_on(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    taken = spark.createDataFrame([("0",), ("1",)], "value string")
    # all keys propose the same values, so each round serves one of them
    got = generator.first_free(keys, lambda k: F.substring_index(k, "/", -1), taken, tries=2).collect()
    assert sorted(r.key for r in got) == ["a", "b", "c"] and len({r.value for r in got} - {"0", "1"}) == 3


def test_minted_numbers_are_valid_and_new(spark):
    keys = spark.range(300).select(F.col("id").cast("string").alias("key"))
    none = spark.createDataFrame([], "reg_no string")
    first = generator.mint_numbers(keys, none)
    again = generator.mint_numbers(keys, first)
    assert first.filter(is_registration_number(F.col("reg_no"))).count() == 300
    assert generator.overlap(first, again).first().asDict() == {"in_either": 600, "in_both": 0}
    assert generator.mint_numbers(keys.limit(0), none).count() == 0


def test_other_company_serves_all_or_null(spark):
    reg = spark.createDataFrame([(f"T{i}", "01" if i % 2 else "04", f"2024-{1 + i % 12:02d}-01", "2025-01-01") for i in range(200)], "reg_no string, process string, registered string, revoked string")
    asked = spark.createDataFrame([(i, f"T{i}", "2024-02-15") for i in range(100)] + [(500, "T1", "2020-01-01")], "id long, reg_no string, issue_date string")
    got = {r.id: r.decoy for r in generator.other_company(asked, reg).collect()}
    fits = {f"T{i}" for i in range(200) if i % 2 and f"2024-{1 + i % 12:02d}-01" <= "2024-02-15"}
    assert len(got) == 101 and got[500] is None and all(got[i] in fits - {f"T{i}"} for i in range(100))


def test_broken_number_fails_and_wrong_tax_is_unexplained(spark):
    s = spark.range(200).select(F.col("id").cast("string").alias("k"), generator.corporate_number(F.lpad(F.col("id").cast("string"), 12, "1")).alias("n"))
    s = s.select("n", generator.broken_number(F.col("k"), F.concat(F.lit("T"), "n")).alias("bad"))
    assert s.filter(is_registration_number(F.col("bad"))).count() == 0 and s.filter(F.levenshtein(F.concat(F.lit("T"), "n"), "bad") == 1).count() == 200
    t = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7).alias("s"), F.lit(10).alias("r"))
    t = t.withColumn("tax", tax.expected_tax(F.col("s"), F.col("r"), F.lit(False), "floor"))
    t = t.withColumn("wrong", generator.wrong_tax(F.col("k"), F.col("s"), F.col("r"), F.lit(False), F.col("tax")))
    right = [tax.expected_tax(F.col("s"), F.col("r"), F.lit(False), x) for x in tax.ROUNDINGS]
    assert t.filter(F.col("wrong").isin(*right) | (F.col("wrong") < 0) | F.col("wrong").isNull()).count() == 0


def test_sample_is_exact(spark):
    rows = spark.range(50).select(F.col("id").alias("k"))
    got = [sorted(r.k for r in generator.exact_sample(rows.repartition(n), "k", 20).collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(set(got[0])) == 20 and generator.exact_sample(rows, "k", 80).count() == 50


def test_whole_numbers_and_long_answers(spark):
    s = spark.createDataFrame([("9007199254740993",), ("5.9",), ("true",), ('"1,200円"',), ("null",)], "j string")
    assert [r[0] for r in s.select(untyped.whole(F.parse_json("j"))).collect()] == [9007199254740993, 5, None, 1200, None]
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    s = spark.createDataFrame([("x " + deep + " } tail",), ("{" * 10000,), ("}" * 10000,), ('```json\n{"b": {"c": 2}}``` }',), ("",), (None,)], "t string")
    cut = s.select(untyped._balanced(F.split(F.col("t"), r"\}")).alias("c")).collect()
    assert cut[0].c == "x " + deep and cut[1].c is None
    got = [r[0] for r in untyped.parsed(s, untyped.first_object(F.col("t")), "v").select(F.to_json("v")).collect()]
    assert got[3] == '{"b":{"c":2}}' and got[1:3] == [None, None] and got[4:] == [None, None]


def test_verification_by_asked_layers(spark):
    reg = spark.createDataFrame([("T1", "n", "a", "01", "2023-10-01", "", "")], readers.REGISTRY)
    rows = spark.createDataFrame([(1, "{}", ["schema"]), (2, "{}", ["tax"]), (3, "{}", None), (4, "{}", ["other"])], "id int, j string, layers array<string>").withColumn("parsed", F.parse_json("j"))
    got = {r.id: (r.approved, r.reasons) for r in verify.verify_asked(rows, reg).collect()}
    bad = (False, ["schema:not_an_object"])
    assert got == {1: bad, 2: (True, []), 3: bad, 4: bad}


def test_readers_and_writers(spark, tmp_path):
    lines = ["1,T1,01,a,2,b,1,2023-10-01,c,,,addr,d,e,f,g,h,i,社,j,k,l,m,n", '2,T1,01,a,2,b,1,2023-10-01,c,,,"a,ddr",d,e,f,g,h,i,"社 ""新"""', "3,short", "4,T2,01,a,1,b,1,x,c,,,addr,d,e,f,g,h,i,人"]
    (tmp_path / "h_1.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = readers.registry_csv(spark, f"{tmp_path}/h_*.csv")
    built = registry.build(raw).collect()
    assert [(r.reg_no, r.name, r.address) for r in built] == [("T1", '社 "新"', "a,ddr")]
    assert registry.provenance(raw, "now").first().rows_read == 2
    writers.write_jsonl(registry.build(raw), f"{tmp_path}/reg")
    assert readers.registry_json(spark, f"{tmp_path}/reg").select("reg_no", "expired").collect() == [("T1", "")]
    (tmp_path / "p.jsonl").write_text('{"id": "a", "parsed": {"x": 1}}\n\n{"id": "b", "parsed": null}\n', encoding="utf-8")
    assert [r.id for r in readers.predictions_json(spark, f"{tmp_path}/p.jsonl").collect()] == ["a", "b"]
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes" / "inv_1.json").write_text('{"lines": [{"text": "t", "box": [1, 2, 3, 4], "vertical": false}]}', encoding="utf-8")
    assert readers.boxes_json(spark, f"{tmp_path}/boxes").select("invoice_id", F.size("lines")).collect() == [("inv_1", 1)]
    records = [{"reg_no": "T1", "name": "old"}, {"reg_no": "T1", "name": "new"}, {"reg_no": "T2"}]
    assert sorted((r.reg_no, r.name) for r in readers.from_records(spark, records).collect()) == [("T1", "new"), ("T2", "")]
    writers.summary_json({"n": 1}, f"{tmp_path}/s.json")
    writers.report_markdown("Title", ["part"], f"{tmp_path}/r.md")
    assert (tmp_path / "s.json").read_text() == '{\n  "n": 1\n}\n' and (tmp_path / "r.md").read_text() == "# Title\n\npart\n"


def test_printed_values_and_matched(spark):
    s = spark.sql("select 'A' a, array(named_struct('description','d','quantity',2L,'unit_price',1500L,'amount',3000L)) items, array(named_struct('rate',10,'subtotal',3000L,'tax',300L), named_struct('rate',10,'subtotal',15L,'tax',1L)) totals")
    g = {**{k: F.col("a") for k in ("issuer_name", "registration_number", "address", "recipient_name", "invoice_number", "printed_date")}, "grand_total": F.lit(3300), "items": F.col("items"), "totals": F.col("totals")}
    want = ["A"] * 6 + ["3,300円", "d", "2", "1,500円", "3,000円", "10%", "3,000円", "300円", "10%", "15円", "1円"]
    assert s.select(text.printed_values(g, F.lit(2))).first()[0] == want
    assert s.select(tax.matched(F.col("totals"), F.lit(False))).first()[0] == {10: ["floor"]}


def test_drawn_invoices(spark):
    """What is drawn is within its bounds, the same for a key in any order, and goes on to whole invoices."""
    issuers = spark.createDataFrame([("a", "T7000012050002", "株式会社甲", "floor", True, "2023-10-01"), ("b", "T1000020012131", "乙", "ceil", False, "2025-01-15")], "key string, reg_no string, name string, rounding string, seal boolean, registered string")
    recipients = spark.range(9).select(F.col("id").alias("number"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))
    orders = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("issuer"), F.when(F.col("id") % 4 == 0, "holdout").otherwise("train").alias("split"), F.floor(F.col("id") / 4).alias("ordinal"))
    draw = lambda o: generator.draw_invoices(o, issuers, recipients, 9)
    rows = {r.id: r for r in draw(orders).collect()}
    assert rows == {r.id: r for r in draw(orders.repartition(7)).collect()} and len(rows) == 400
    allowed = {d: (lo, hi, rate) for d, lo, hi, rate in generator.PRODUCTS}
    for r in rows.values():
        assert 2 <= len(r["items"]) <= 7 and len({i.description for i in r["items"]}) == len(r["items"])
        for i in r["items"]:
            lo, hi, rate = allowed[i.description]
            assert lo <= i.unit_price <= hi and i.amount == i.quantity * i.unit_price and i.rate == rate and i.quantity in generator.QUANTITIES
        assert ("2023-10-01" if r.issuer == "a" else "2025-01-15") <= r.issue_date <= generator.LAST_ISSUE_DAY
        assert r.layout == ("vertical" if r.template.startswith("v_") else "horizontal") and not (r.seal_overlap and r.issuer == "b")
        assert (r.template.split("__")[0] in generator.HOLDOUT_STRUCTURES) == (r.split == "holdout")
    assert len({r.template for r in rows.values()}) == 2 * 2 + 4 * 5 and {r.issue for r in rows.values()} == {None, *generator.ISSUES}
    assert spark.range(1).select(generator.person_name(F.lit("k"))).first()[0].startswith(generator.SURNAMES)
