"""What a wrong digit in a registration number leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.functions.checkdigit import check_digit, is_valid_parsed
from chobo.operators.membership import present


def wrong_digits(registry: DataFrame) -> DataFrame:
    """reg_no, kind digit, corrupted: every other digit at every place of every number."""
    at = registry.select("reg_no", F.explode(F.sequence(F.lit(2), F.lit(14))).alias("i")).select("reg_no", "i", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    own = F.substr("reg_no", "i", F.lit(1)).cast("int")
    return at.filter(own != F.col("d")).select("reg_no", F.lit("digit").alias("kind"), F.concat(F.substr("reg_no", F.lit(1), F.col("i") - 1), F.col("d").cast("string"), F.substr("reg_no", F.col("i") + 1, F.lit(14))).alias("corrupted"))


def swapped_digits(registry: DataFrame) -> DataFrame:
    """reg_no, kind swap, corrupted: every pair of neighbouring digits exchanged; equal ones leave the number as it is."""
    i = F.col("i")
    at = registry.select("reg_no", F.explode(F.sequence(F.lit(2), F.lit(13))).alias("i"))
    return at.select("reg_no", F.lit("swap").alias("kind"), F.concat(F.substr("reg_no", F.lit(1), i - 1), F.substr("reg_no", i + 1, F.lit(1)), F.substr("reg_no", i, F.lit(1)), F.substr("reg_no", i + 2, F.lit(14))).alias("corrupted"))


def classify(corrupted: DataFrame, registry: DataFrame) -> DataFrame:
    """corrupted rows with outcome: unchanged, check_digit (fails it), other_company (exists) or lookup (does not)."""
    # few pass the check digit, and only these are looked up
    first = F.when(F.col("corrupted") == F.col("reg_no"), "unchanged").when(~is_valid_parsed(F.col("corrupted")), "check_digit")
    # made a column of its own by explode: a filter would else work it out anew for each digit that it reads
    tested = corrupted.withColumn("corrupted", F.explode(F.array("corrupted"))).withColumn("outcome", first)
    real = registry.select(F.col("reg_no").alias("__real")).distinct()
    passed = tested.filter("outcome is null").join(real, F.col("corrupted") == F.col("__real"), "left")
    passed = passed.withColumn("outcome", F.when(F.col("__real").isNotNull(), "other_company").otherwise("lookup")).drop("__real")
    return tested.filter("outcome is not null").unionByName(passed)


def wrong_digit_counts(registry: DataFrame) -> DataFrame:
    """One row: kind digit and the counts of anatomy() of all wrong digits of all numbers, without making them all.

    Whether a digit e for d at a place of weight w passes the check digit is a matter of whole numbers: the sum of the
    twelve grows by w * (e - d). Only what passes becomes a number, only what the membership index lets through is looked
    up, and the rest is counted by subtraction.
    """
    digits = F.regexp_replace(F.substr("reg_no", F.lit(2), F.lit(13)), "[^0-9]", "")
    s = registry.select("reg_no", F.length(digits).alias("places"), (9 - check_digit(F.substr("reg_no", F.lit(3), F.lit(12)))).alias("rest"), F.when(F.col("reg_no").rlike(r"^T[0-9]{13}\z"), F.substr("reg_no", F.lit(2), F.lit(1)).try_cast("int")).alias("own"))
    # the row of a number whose shape is wrong has places, but nothing that could pass
    at = s.filter("own is not null").select("reg_no", "rest", "own", F.explode(F.sequence(F.lit(2), F.lit(14))).alias("i")).withColumn("d", F.substr("reg_no", "i", F.lit(1)).cast("int"))
    grown = F.pmod(F.col("rest") + (1 + F.col("i") % 2) * (F.col("e") - F.col("d")), F.lit(9))
    passes = F.when(F.col("i") == 2, F.col("e") == 9 - F.col("rest")).otherwise(9 - grown == F.col("own"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("e")).filter((F.col("e") != F.col("d")) & passes)
    passed = at.select(F.concat(F.substr("reg_no", F.lit(1), F.col("i") - 1), F.col("e").cast("string"), F.substr("reg_no", F.col("i") + 1, F.lit(14))).alias("corrupted"))
    others = present(passed, "corrupted", registry, "reg_no").agg(F.count("*").alias("other_company"))
    counts = s.agg(F.coalesce(F.sum(9 * F.col("places")), F.lit(0)).cast("long").alias("all")).crossJoin(passed.agg(F.count("*").alias("passed"))).crossJoin(others)
    return counts.select(F.lit("digit").alias("kind"), F.lit(0).cast("long").alias("unchanged"), (F.col("all") - F.col("passed")).alias("check_digit"), (F.col("passed") - F.col("other_company")).alias("lookup"), "other_company")


def anatomy(classified: DataFrame) -> DataFrame:
    """kind and counts of each outcome, shares of changed numbers (5 places), and of those that pass the check digit the
    share that is another company's (4 places)."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return shares(classified.groupBy("kind").agg(*[n(x).alias(x) for x in ("unchanged", "check_digit", "lookup", "other_company")]))


def shares(out: DataFrame) -> DataFrame:
    """Counts by kind, with the shares of anatomy()."""
    changed = F.col("check_digit") + F.col("lookup") + F.col("other_company")
    share = lambda x: F.round(F.col(x) / F.nullif(changed, F.lit(0)), 5)
    return out.withColumns({f"{x}_share": share(x) for x in ("check_digit", "lookup", "other_company")}).withColumn("survivors_other_share", F.round(F.col("other_company") / F.nullif(F.col("lookup") + F.col("other_company"), F.lit(0)), 4))
