"""What the generated invoices are made of is worked out once, and only invoices that ask for another number are joined."""

import os

from pyspark.sql import functions as F

from chobo.operators import generator
from chobo.plans import adapter as A

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_ordered_is_what_gold_holds(spark):
    got = A.ordered(spark, SF).orderBy("id").collect()
    issue = F.get("document_issues", F.lit(0)).alias("issue")
    head = A.flat(spark, SF, A.HEAD).select("id", F.col("k").cast("string").alias("issuer"))
    want = A.gold(spark, SF).select("id", "issue_date", issue, "items").join(head, "id").select("id", "issuer", "issue_date", "issue", "items").orderBy("id").collect()
    assert got == want and len(got) > 100


def test_invoices_without_another_number_are_not_joined(spark):
    kinds = [None, *generator.ISSUES]
    item = [("品", 1, 1000, 1000, 10)]
    orders = spark.createDataFrame([(i, "1", "2024-05-05", kinds[i % 6], item) for i in range(60)], "id long, issuer string, issue_date string, issue string, items array<struct<description string, quantity bigint, unit_price bigint, amount bigint, rate int>>")
    issuers = spark.createDataFrame([("1", "T1000000000001", "floor")], "key string, reg_no string, rounding string")
    registry = spark.createDataFrame([("T1000000000001", "01", "2023-10-01", ""), ("T2000000000002", "01", "2023-10-01", ""), ("T3000000000003", "04", "2023-10-01", "2025-06-30")], "reg_no string, process string, registered string, revoked string")
    made = generator.make_invoices(orders, issuers, registry)
    rows = made.collect()
    assert sorted(r.id for r in rows) == list(range(60))
    own = {r.issue for r in rows if r.reg_no == "T1000000000001"}
    assert own == {None, "tax_total_wrong"}
    assert {r.reg_no for r in rows if r.issue == "reg_no_revoked"} == {"T3000000000003"} and {r.reg_no for r in rows if r.issue == "reg_no_other_company"} == {"T2000000000002"}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith(("Union", "Project")) and "Union" in plan.split("Join")[0]
