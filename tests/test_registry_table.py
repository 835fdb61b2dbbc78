"""The stored registry and the membership index."""

import glob

from pyspark.sql import functions as F

from chobo.operators import corruption, membership, registry
from chobo.sources import readers
from chobo.sources.registry_table import RegistryTable


def numbers(spark, n, name="n", extra=""):
    return spark.range(n).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 13, "0")).alias("reg_no"), F.concat(F.lit(name), F.col("id").cast("string")).alias("name"), *[F.lit(x).alias(c) for c, x in (("address", ""), ("process", "01"), ("registered", "2023-10-01"), ("revoked", ""), ("expired", extra))], F.col("id").alias("o"))


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    t = RegistryTable(spark, f"file://{tmp_path}/r", buckets=8)
    assert t.upsert(numbers(spark, 500), ["o"]) == 8
    files = lambda: {f.split("bucket=")[1].split("/")[0]: f for f in glob.glob(f"{tmp_path}/r/bucket=*/*.parquet")}
    before = files()
    assert len(before) == 8
    few = numbers(spark, 3, "new").unionByName(numbers(spark, 3, "newest").withColumn("o", F.lit(9).cast("long"))).filter("reg_no like '%1'")
    assert t.upsert(few, ["o"]) == 1
    after = files()
    assert sum(before[k] != after[k] for k in before) == 1 and len(after) == 8
    want = {r.reg_no: r.name for r in numbers(spark, 500).collect()} | {"T0000000000001": "newest1"}
    assert {r.reg_no: r.name for r in t.read().collect()} == want
    assert t.upsert(numbers(spark, 0), ["o"]) == 0
    again = RegistryTable(spark, f"file://{tmp_path}/r", buckets=8)
    assert again.read().count() == 500
    again.close()
    t.close()


def test_joins_move_the_rows_alone(spark, tmp_path):
    t = RegistryTable(spark, f"file://{tmp_path}/r", buckets=8)
    t.upsert(numbers(spark, 100), ["o"])
    rows = numbers(spark, 300).select(F.col("reg_no").alias("number"), F.lit("2024-01-01").alias("day"))
    joined = registry.look_up(rows, t.read().hint("merge"), "number", "day")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(number" in plan.replace("#", " ")
    assert {r.registry_status: r["count"] for r in joined.groupBy("registry_status").count().collect()} == {"valid": 100, "not_found": 200}


def test_membership(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)] + [(None,), ("k1",)], "key string")
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(4000, 40000)] + [(-1, None)], "i int, x string")
    for largest in (membership.LARGEST, 0):
        index = membership.build(keys, "key", largest=largest)
        assert index.send == (largest > 0)
        through = {r.i for r in membership.maybe(rows, "x", index).collect()}
        assert through >= set(range(4000, 5000)) and len(through) < 1000 + 0.09 * 35000
        assert {r.i for r in membership.present(rows, "x", keys, "key", largest=largest).collect()} == set(range(4000, 5000))
    assert membership.present(rows, "x", keys.filter("false"), "key").count() == 0


def test_counts_of_wrong_digits_equal_the_numbers_themselves(spark):
    given = ["T7000012050002", "T1000020012131", "T1010001002431", "T9000000000000", "T0999999999999", "T5050005005211", "T7000012050003", "short", "T70000120500x2"]
    reg = spark.createDataFrame([(n, "", "", "01", "", "", "") for n in given], readers.REGISTRY)
    # every number that one of these could be taken for, besides
    near = corruption.wrong_digits(reg.filter("reg_no rlike '^T[0-9]{13}$'")).filter("corrupted like '%00%'").select(F.col("corrupted").alias("reg_no")).distinct()
    both = reg.unionByName(near, allowMissingColumns=True).filter("reg_no rlike '^T[0-9]{13}$'").select("reg_no").distinct()
    want = corruption.anatomy(corruption.classify(corruption.wrong_digits(both), both)).first().asDict()
    assert corruption.shares(corruption.wrong_digit_counts(both)).first().asDict() == want and want["other_company"] > 5
    odd = corruption.wrong_digit_counts(reg.filter("reg_no in ('short', 'T70000120500x2')")).first()
    assert (odd.check_digit, odd.lookup, odd.other_company) == (9 * 12, 0, 0)
