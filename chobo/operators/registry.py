"""The registry of invoice issuers: building it, looking numbers up on a day, and auditing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chobo.functions.checkdigit import is_valid_parsed
from chobo.functions.text import match_names, shown_name

FIELDS = ["reg_no", "name", "address", "process", "registered", "revoked", "expired"]


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in the given order. A hash aggregation, partial before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(key, "r.*")


def current_corporations(raw: DataFrame) -> DataFrame:
    """Of the registry's positional rows (c0 ..), those that are current and of corporations, with names."""
    kept = raw.filter((F.col("c6") == "1") & (F.col("c4") == "2"))
    cols = dict(zip(FIELDS, ["c1", "c18", "c11", "c2", "c7", "c9", "c10"], strict=True))
    return kept.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in cols.items()], *[c for c in ("file", "line") if c in raw.columns])


def build(raw: DataFrame) -> DataFrame:
    """The registry: one row a number, the last of the files in their order."""
    return last_wins(current_corporations(raw), "reg_no", ["file", "line"])


def provenance(raw: DataFrame, snapshot: str) -> DataFrame:
    """One row: files, rows_read (before the last of each number is taken), registrants, by_process, snapshot."""
    rows = current_corporations(raw)
    counts = build(raw).groupBy("process").count().agg(F.sum("count").alias("registrants"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("process", "count")))).alias("by_process"))
    read = rows.agg(F.count("*").alias("rows_read"), F.array_sort(F.collect_set("file")).alias("files"))
    return read.crossJoin(counts).withColumn("snapshot", F.lit(snapshot))


def status(day: Column) -> Column:
    """not_found, not_yet_registered, revoked, expired or valid, on an ISO day, of a registry row joined from the left.

    The first day of registration is valid; the days of revocation and expiry no longer are. Empty dates are none.
    """
    return (
        F.when(F.col("registered").isNull() | day.isNull(), "not_found")
        .when((F.col("registered") != "") & (day < F.col("registered")), "not_yet_registered")
        .when((F.col("revoked") != "") & (day >= F.col("revoked")), "revoked")
        .when((F.col("expired") != "") & (day >= F.col("expired")), "expired")
        .otherwise("valid")
    )


def with_keys(registry: DataFrame) -> DataFrame:
    """The columns that a lookup needs, with the name in comparable form."""
    return registry.select("reg_no", shown_name(F.col("name")).alias("name_key"), "registered", "revoked", "expired")


def look_up(rows: DataFrame, registry: DataFrame, number: str, day: str, name: str | None = None) -> DataFrame:
    """rows with registry_status and, for a column of company_name() text, name_match (no_record without a row).

    One equi-join on the number; whether the registry is broadcast is left to its measured size.
    """
    keyed = with_keys(registry)
    joined = rows.join(keyed, F.col(number) == F.col("reg_no"), "left")
    out = joined.withColumn("registry_status", status(F.col(day)))
    if name:
        out = out.withColumn("name_match", F.when(F.col("reg_no").isNull(), "no_record").otherwise(match_names(F.col(name), F.col("name_key"))))
    return out.drop(*keyed.columns)


def audit(registry: DataFrame) -> DataFrame:
    """One row: registrants, valid (numbers whose check digit holds), and the first five numbers that fail."""
    bad = F.when(~is_valid_parsed(F.col("reg_no")), F.col("reg_no"))
    firsts = registry.select(bad.alias("reg_no")).filter("reg_no is not null").orderBy("reg_no").limit(5).agg(F.array_sort(F.collect_list("reg_no")).alias("invalid"))
    return registry.agg(F.count("*").alias("registrants"), F.count_if(is_valid_parsed(F.col("reg_no"))).alias("valid")).crossJoin(firsts)
