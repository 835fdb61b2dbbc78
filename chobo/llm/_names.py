"""Columns of any name: kept together in one struct while an operator works, so that none can clash with its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, new: list[str], **own) -> tuple[DataFrame, list[str]]:
    """(row, own columns), names: ``row`` holds the columns of ``docs`` but those that results replace."""
    names = [c for c in docs.columns if c not in new]
    return docs.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"), *[c.alias(k) for k, c in own.items()]), names


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(rows: DataFrame, names: list[str], *new) -> DataFrame:
    return rows.select(*[field(c).alias(c) for c in names], *new)


def with_fields(rows: DataFrame, only: list[str], ddl: str) -> T.StructType:
    """The schema of ``only`` of these columns, with those of ``ddl``."""
    return T.StructType([*(rows.schema[c] for c in only), *T.StructType.fromDDL(ddl).fields])
