"""Scores: labels and answers come from one shuffle of the lines, and labels parted by their key are not moved again."""

import os

from pyspark.sql import functions as F

from chobo.functions.untyped import is_filled_object
from chobo.plans import adapter as A
from chobo.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_labels_stay_where_their_lines_are(spark):
    df = Q.q_score_fields(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("invoice_id" in line for line in shuffles)
    # a filter on one of the two uses of the lines would make it another shuffle
    assert not any("17" in line for line in plan.splitlines() if "FileScan" in line or "Filter" in line and "orderkey" in line)


def test_answers_by_either_key_score_alike(spark):
    g = A.gold(spark, SF)
    score = lambda key: Q.evaluation.evaluate(g, A.predictions(g, key), key=key).select("id", "ok", "exact", "have_pred", "parsed_json", "items_correct").orderBy("id").collect()
    assert score("id") == score("invoice_id")


def test_filled_objects(spark):
    rows = [(0, '{"a":null}', True), (1, '{"b":1}', True), (2, "{}", False), (3, "[1]", False), (4, None, False), (5, "null", False), (6, '"a"', False)]
    s = spark.createDataFrame(rows, "i int, j string, want boolean").withColumn("v", F.try_parse_json("j"))
    assert all(r.got is r.want for r in s.select("want", is_filled_object(F.col("v"), "a").alias("got")).collect())


def test_digits_of_numbers_of_twelve_and_thirteen_places(spark):
    numbers = [100000000000, 100000007919, 990000000001, 999999999999, 1000000000007, 1234567890123]
    s = spark.createDataFrame([(n,) for n in numbers], "n long").selectExpr("n", f"{A._digits('n')} AS got", f"'T' || CAST(9 - (({A._weighted('CAST(n AS STRING)')}) % 9) AS STRING) || CAST(n AS STRING) AS want")
    assert all(r.got == r.want for r in s.collect())
