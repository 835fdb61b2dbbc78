from fractions import Fraction
from math import ceil, floor

from pyspark.sql import functions as F

from chobo.functions import checkdigit, dates, tax, text, untyped


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(1)
    return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]


def test_dates(spark):
    given = ["令和5年10月1日", "R5.10.1", "２０２３年１０月１日", "2023/10/1", "令和元年5月1日", "平成31年4月30日", "昭和64年1月7日"]
    assert apply(spark, dates.parse_date, given) == ["2023-10-01"] * 4 + ["2019-05-01", "2019-04-30", "1989-01-07"]
    assert apply(spark, dates.parse_date, ["令和1年4月30日", "平成31年5月1日", "令和5年2月30日", "来月", "0000/1/1", "", None]) == [None] * 7


def test_amounts(spark):
    assert apply(spark, text.yen, ["￥１，２３４", "¥1,234", "1,234円", "△500", "▲ 7", "-3", "¥-500", "1,234.56", "無料", "", None]) == [1234, 1234, 1234, -500, -7, -3, 500, 123456, None, None, None]


def test_names(spark):
    assert apply(spark, text.company_name, ["(株)サンプル　商事", "㈱サンプル商事", "（有）甲", None]) == ["株式会社サンプル商事", "株式会社サンプル商事", "有限会社甲", None]
    assert apply(spark, text.company_core, ["株式会社サンプル商事", "サンプル商事(株)"]) == ["サンプル商事"] * 2


def test_numbers(spark):
    assert apply(spark, checkdigit.registration_number, ["Ｔ－１０１０００１００２４３１", "t 1010001 002431", "T101000100243", "1010001002431", None]) == ["T1010001002431"] * 2 + [None] * 3
    assert apply(spark, checkdigit.is_registration_number, ["T7000012050002", "T1000020012131", "T1010001002431", "T1010001002432", "T2010001002431", "x", None]) == [True] * 3 + [False] * 4


def test_every_wrong_digit_is_found_but_nine_for_zero(spark):
    good = "7000012050002"
    bad = [(i, d, good[:i] + d + good[i + 1 :]) for i in range(13) for d in "0123456789" if d != good[i]]
    found = apply(spark, checkdigit.is_corporate_number, [x for _, _, x in bad])
    for (i, d, _), ok in zip(bad, found):
        assert ok == (i > 0 and {d, good[i]} == {"0", "9"})


def test_tax_against_fractions(spark):
    cases = [(n, r, inc) for n in [*range(-60, 60), 1005, 1234, 1100, 1105, 99999] for r in (8, 10) for inc in (True, False)]
    df = spark.createDataFrame(cases, "n long, r int, inc boolean")
    for row in df.select("n", "r", "inc", *[tax.expected_tax(F.col("n"), F.col("r"), F.col("inc"), k).alias(k) for k in tax.ROUNDINGS]).collect():
        x = Fraction(row.n * row.r, 100 + row.r if row.inc else 100)
        assert (row["floor"], row.half_up, row["ceil"]) == (floor(x), floor(x + Fraction(1, 2)), ceil(x))


ITEM, TOTAL = "array<struct<quantity bigint,unit_price bigint,amount bigint,rate int>>", "array<struct<rate int,subtotal bigint,tax bigint>>"


def test_tax_checker(spark):
    good = ([(1, 1005, 1005, 10)], [(10, 1005, 100)], 1105, False)
    cases = {
        "good": (good, [], ["floor"]),
        "mixed": (([(1, 1005, 1005, 10), (1, 1234, 1234, 8)], [(10, 1005, 101), (8, 1234, 98)], 2438, False), [], []),
        "line": (([(2, 1005, 1005, 10)], *good[1:]), ["line_amount_mismatch"], ["floor"]),
        "rate": (([(1, 1005, 1005, 10), (1, 5, 5, 3)], *good[1:]), ["unknown_rate"], ["floor"]),
        "missing": (([(1, 1005, 1005, 10), (1, 5, 5, 8)], *good[1:]), ["rate_missing"], ["floor"]),
        "twice": ((good[0], [(10, 1, 0), (10, 1005, 100)], 1106, False), [], ["floor"]),
        "tax": ((good[0], [(10, 1005, 99)], 1104, False), ["tax_mismatch"], []),
        "total": ((*good[:2], 1106, False), ["total_mismatch"], ["floor"]),
        "nothing": (([], [], 0, True), [], []),
    }
    df = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], f"k string, items {ITEM}, totals {TOTAL}, grand bigint, inc boolean")
    for r in df.select("k", tax.check_tax(F.col("items"), F.col("totals"), F.col("grand"), F.col("inc")).alias("t")).collect():
        assert (r.k, r.t.errors, r.t.convention, r.t.ok) == (r.k, cases[r.k][1], cases[r.k][2], not cases[r.k][1])


def salvage(spark, given):
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").repartition(1)
    return [r.j for r in untyped.parsed(df, untyped.first_object(F.col("t")), "v").select("i", F.to_json("v").alias("j")).orderBy("i").collect()]


def test_json_salvage(spark):
    given = ['```json\n{"a": 1}\n```', 'so {"a": 1} it is}', '{"a": {"b": 2}} {', "none", '{"a": 1', None]
    assert salvage(spark, given) == ['{"a":1}', '{"a":1}', '{"a":{"b":2}}', None, None, None]


def test_repeated_keys(spark):
    """The last value of a key counts, at every depth; what is no JSON stays none."""
    given = ['{"a":1,"a":2}', 'x {"a":1,"a":{"b":[{"c":1,"c":"z"}],"b":[]}} y', '{"a":1,"a":12345678901234567890}', '{"a":1,"a":' + "9" * 60 + "}", '{"a":1,"a":NaN}', '{"a":1,"a":2,}', '{"é":"\\u3042","é":"い"}', '{"a":"}","a":1}']
    assert salvage(spark, given) == ['{"a":2}', '{"a":{"b":[]}}', '{"a":12345678901234567890}', '{"a":1.0E39}', '{"a":null}', None, '{"é":"い"}', None]
