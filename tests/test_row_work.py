"""What the audit queries share is worked out once: lines are read once, answers come from one pass, patterns go before folds."""

import os

import numpy as np
from pyspark.sql import functions as F

from chobo.functions.dates import parse_date
from chobo.functions.text import yen
from chobo.functions.untyped import first_object
from chobo.operators import bootstrap, boxes, evaluation
from chobo.plans import adapter as A

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gold_reads_and_shuffles_its_lines_once(spark):
    plan = _plan(A.gold(spark, SF))
    assert plan.count("l_linenumber") > 0 and "Window" not in plan
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert "Union" not in _plan(A.predictions(A.gold(spark, SF)))


def test_same_fields_are_compared_once_for_a_row(spark):
    g = A.gold(spark, SF)
    plan = _plan(evaluation.evaluate(g, A.predictions(g)).select("exact", "items_correct"))
    assert plan.count("to_variant_object") == 0 and "$.issuer_name" in plan
    # read for the comparison and for the comparable form, and not once for each figure
    assert plan.count("$.issuer_name") <= 3


def test_first_object_of_any_depth(spark):
    texts = [(0, 'x {"a":{"b":1},"c":[{"d":2}]} y}'), (1, '```json\n{"a":{"b":{"c":{}}}}\n``` {'), (2, "{ {"), (3, "no"), (4, None), (5, "{}"), (6, "} {a} }"), (7, "{" + "{}" * 20000 + "} z"), (8, "`{``json```}")]
    got = {r.i: r.o for r in spark.createDataFrame(texts, "i int, c string").select("i", first_object(F.col("c")).alias("o")).collect()}
    assert got == {0: '{"a":{"b":1},"c":[{"d":2}]}', 1: '{"a":{"b":{"c":{}}}}', 2: None, 3: None, 4: None, 5: "{}", 6: "{a}", 7: "{" + "{}" * 20000 + "}", 8: "{``json}"}


def test_short_cuts_of_dates_and_amounts(spark):
    dates = ["2025-3-4", "0000-01-01", "2025-02-30", "令和元年5月1日", "R7.3.14", "r7-3-14", "平成31年5月1日", "昭和64年1月7日", "H31.4.30", "２０２５／１／２", "2025年1月2日", "12", "", None]
    got = [r.d for r in spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, c string").select("i", parse_date(F.col("c")).alias("d")).orderBy("i").collect()]
    assert got == ["2025-03-04", None, None, "2019-05-01", "2025-03-14", "2025-03-14", None, "1989-01-07", "2019-04-30", "2025-01-02", "2025-01-02", None, None, None]
    amounts = ["1,234", "¥5", ",", "", "-7", "△1", "１２", "1\n", "99999999999999999999", None]
    got = [r.d for r in spark.createDataFrame([(i, d) for i, d in enumerate(amounts)], "i int, c string").select("i", yen(F.col("c")).alias("d")).orderBy("i").collect()]
    assert got == [1234, 5, None, None, -7, -1, 12, 1, None, None]


def test_neighbours_are_sought_for_lines_with_a_name_only(spark):
    plan = _plan(boxes.with_lines(spark.createDataFrame([], "lines array<struct<text string, box array<double>, vertical boolean>>")).select(boxes.name_votes(F.col("L"))))
    assert plan.lower().count("contains(") > 4


def test_seeded_intervals_take_any_number_of_values(spark):
    n = (1 << 22) + 3
    got = {r.g: r for r in bootstrap.seeded_intervals(spark.range(n).selectExpr("id % 2 AS g", "id AS i", "CAST(id % 3 = 0 AS DOUBLE) AS value"), ["g"], "i", n_boot=3).collect()}
    for g, r in got.items():
        v = (np.arange(g, n, 2) % 3 == 0).astype(float)
        means = v[np.random.default_rng(0).integers(0, len(v), size=(3, len(v)))].mean(axis=1)
        assert (r.n, r.mean, r.lo, r.hi) == (len(v), v.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975))


def test_neighbour_counts_equal_the_neighbours(spark):
    line = lambda x, y, down=False: ("甲", [float(x), float(y), x + 40.0, y + 14.0], down)
    docs = spark.createDataFrame([(1, [line(0, 0), line(50, 3), line(80, 40), line(0, 90, True), line(2, 110, True)]), (2, [line(0, 0)]), (3, [])], "id int, lines array<struct<text string, box array<double>, vertical boolean>>")
    s = boxes.with_lines(docs)
    plain = s.select("id", F.transform("L", lambda a: F.size(boxes.neighbours(F.col("L"), a))).alias("n")).collect()
    want = {r.id: (sum(n > 0 for n in r.n), sum(r.n)) for r in plain if any(r.n)}
    assert {r.id: (r.lines, r.pairs) for r in boxes.neighbour_counts(s, "id").collect()} == want == {1: (2, 2)}
