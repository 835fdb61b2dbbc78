"""Tables of a report: several systems side by side, as pivots of long tables of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.operators.scoring import FIELDS
from chobo.operators.verification_eval import LEVEL_METRICS

LAYOUTS = ("horizontal", "vertical")


def extraction_table(summary: DataFrame) -> DataFrame:
    """system, n, and the shares exact, each field, exact_horizontal, exact_vertical of evaluation.summary_counts().

    Shares that a system has no documents for are null.
    """
    column = F.when(F.col("metric") == "exact_by_layout", F.concat(F.lit("exact_"), F.col("slice"))).otherwise(F.regexp_replace("metric", "^field:", ""))
    s = summary.filter("metric in ('exact', 'exact_by_layout') or metric like 'field:%'").withColumn("column", column)
    n = s.filter("metric = 'exact'").select("system", "n")
    wide = s.groupBy("system").pivot("column", ["exact", *FIELDS, *(f"exact_{x}" for x in LAYOUTS)]).agg(F.first("mean"))
    return n.join(wide, "system")


def levels_table(levels: DataFrame) -> DataFrame:
    """system, level and the share of each metric, of rows (system, level, metric, value)."""
    return levels.groupBy("system", "level").pivot("metric", list(LEVEL_METRICS)).agg(F.avg("value"))


def card(exact: DataFrame, levels: DataFrame, level: str = "tax") -> DataFrame:
    """A row for each system: exact, automation_rate of a level, and k of n covered errors among what it approves.

    exact: system, exact (a boolean for each document); levels: system, level, metric, value.
    """
    at = lambda m: F.when(F.col("metric") == m, F.col("value"))
    covered = at("residual_covered_among_approved")
    own = levels.filter(F.col("level") == level).groupBy("system").agg(F.avg(at("automation_rate")).alias("automation_rate"), F.sum(covered).cast("long").alias("k"), F.count(covered).alias("n"))
    return exact.groupBy("system").agg(F.avg(F.col("exact").cast("double")).alias("exact")).join(own, "system", "left")


def markdown(table: DataFrame, order: list[str]) -> str:
    """A Markdown table of a few collected rows; shares as per cent, null as a dash."""

    def cell(x) -> str:
        return "-" if x is None else f"{100 * x:.1f}" if isinstance(x, float) else str(x)

    rows = [table.columns, ["---"] * len(table.columns), *([cell(x) for x in r] for r in table.orderBy(*order).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
