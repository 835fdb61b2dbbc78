"""Values of untyped JSON (VARIANT): their kinds, and readings of them that never fail."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chobo.functions.text import let, strip, yen_exact

EXACT = "decimal(38,0)"
"""Whole numbers of any sign and up to 38 digits; what has more is far."""


def field(v: Column, name: str) -> Column:
    """A field as VARIANT: null if it is missing, or v no object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def is_filled_object(v: Column, likely: str) -> Column:
    """Is it an object with some key? likely: a key that most have; the kinds of all values are worked out without it only."""
    found = field(v, likely).isNotNull()
    return F.when(v.isNull(), False).when(found, True).otherwise(is_object(v) & (kind(v) != "OBJECT<>"))


def number(v: Column) -> Column:
    """struct value (decimal(38,0), null if v is no whole number of at most 38 digits) and far (has it more digits?).

    Booleans and 5.0 are no whole numbers. VARIANT keeps whole numbers of 64 bits as BIGINT and larger ones as decimals
    without scale, as it does 5.0; so a decimal counts where it is too large for BIGINT. (A fraction of zeros behind such
    a large number goes unnoticed.) A number of more than 38 digits is kept only as a rounded one.
    """

    def read(x: Column) -> Column:
        whole = F.startswith(x.k, F.lit("DECIMAL(")) & F.endswith(x.k, F.lit(",0)"))
        large = let(F.try_variant_get(x.v, "$", EXACT), lambda y: F.when(~y.between(-(1 << 63), (1 << 63) - 1), y))
        value = F.when(x.k == "BIGINT", F.try_variant_get(x.v, "$", "bigint").cast(EXACT)).when(whole, large)
        far = (x.k == "DOUBLE") & (F.abs(F.try_variant_get(x.v, "$", "double")) >= 1e38)
        return F.struct(value.alias("value"), F.coalesce(far, F.lit(False)).alias("far"))

    return let(F.struct(v.alias("v"), kind(v).alias("k")), read)


def is_flag(v: Column) -> Column:
    return F.coalesce(kind(v) == "BOOLEAN", F.lit(False))


def elements(v: Column, name: str) -> Column:
    """An array field as array of VARIANT; null if it is something else."""
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def text(v: Column) -> Column:
    """As text: missing is empty, null is None, booleans are True or False."""
    raw = lambda x: F.try_variant_get(x, "$", "string")
    # only a text of these two words can be a boolean's
    flag = lambda x: raw(x).isin("true", "false") & is_flag(x)
    return let(v, lambda x: F.when(x.isNull(), "").when(F.is_variant_null(x), "None").when(flag(x), F.initcap(raw(x))).otherwise(F.coalesce(raw(x), F.to_json(x))))


def truthy(v: Column) -> Column:
    """Neither missing, null, false, zero nor empty."""
    return let(v, _truthy)


def _truthy(v: Column) -> Column:
    k = kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(k == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(F.startswith(k, F.lit("ARRAY")), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(F.startswith(k, F.lit("OBJECT")), k != "OBJECT<>")
        .otherwise(number != 0),
        F.lit(False),
    )


def whole(v: Column) -> Column:
    """As a decimal(38,0) for scoring: fractions are cut off, text is read as an amount; booleans, null, what has more
    than 38 digits and the rest are null."""
    return let(v, _whole)


def _whole(v: Column) -> Column:
    k = kind(v)
    nested = F.startswith(k, F.lit("ARRAY")) | F.startswith(k, F.lit("OBJECT"))
    fraction = F.try_variant_get(v, "$", "double")
    cut = F.when(fraction < 0, -F.floor(-fraction)).otherwise(F.floor(fraction))
    large = let(fraction, lambda x: F.when(x < 0, F.ceil(x.try_cast("decimal(38,1)"))).otherwise(F.floor(x.try_cast("decimal(38,1)"))).try_cast(EXACT))
    other = F.when(F.abs(fraction) < 9e15, cut.try_cast(EXACT)).otherwise(large)
    return (
        F.when(v.isNull() | F.is_variant_null(v) | (k == "BOOLEAN"), F.lit(None).cast(EXACT))
        .when(k == "STRING", yen_exact(F.try_variant_get(v, "$", "string")))
        .when(nested, yen_exact(F.to_json(v)))
        .when(k.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$"), F.try_variant_get(v, "$", EXACT))
        .otherwise(other)
    )


def flag(v: Column) -> Column:
    """A boolean, or the word true or false in any case; else null."""
    return let(F.lower(strip(F.try_variant_get(v, "$", "string"))), lambda s: F.when(s == "true", True).when(s == "false", False))


@F.pandas_udf(StringType())
def _repeated_keys(texts: pd.Series) -> pd.Series:
    """JSON with the last value of each repeated key; null for null and for what is no JSON."""

    def one(text):
        if text is None:
            return None
        try:
            # a number of very many digits stays one that is out of range; NaN and infinities are no JSON numbers
            return json.dumps(json.loads(text, parse_int=lambda d: int(d) if len(d) <= 40 else float(f"{d[:1] if d[0] == '-' else ''}1e39"), parse_constant=lambda _: None))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def parsed(rows: DataFrame, text: Column, into: str = "parsed") -> DataFrame:
    """rows with a JSON text as VARIANT, null if it is none; of a key that an object repeats the last value counts.

    Spark's own parser takes every text that repeats no key. What it refuses, a few rows as a rule, is read once more by
    a vectorised function, to which all other rows are null.
    """
    s = rows.withColumn("__json", text)
    s = s.withColumn("__first", F.try_parse_json("__json"))
    again = F.try_parse_json(_repeated_keys(F.when(F.col("__first").isNull(), F.col("__json"))))
    return s.withColumn(into, F.coalesce("__first", again)).drop("__json", "__first")


# An object within which braces are two deep at most, as answers have them. Nothing is tried twice, so its length costs no stack.
FLAT = r"^[^{]*+(\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"


def first_object(c: Column) -> Column:
    """The text of the first JSON object in a model's answer, without code fences or prose; null if there is none.

    The object ends where its braces balance; braces within quotes count too, as in the data's own definition. One pattern
    finds that place unless braces are deeper; only then they are counted.
    """
    s = F.when(F.contains(c, F.lit("```")), F.regexp_replace(c, "```(?:json)?", "")).otherwise(c)
    counted = let(s, lambda t: let(F.split(F.substring(t, F.nullif(F.locate("{", t), F.lit(0)), F.length(t)), r"\}"), _balanced))
    return F.coalesce(F.nullif(F.regexp_extract(s, FLAT, 1), F.lit("")), counted)


def _balanced(pieces: Column) -> Column:
    """The text up to the brace that closes the first one, from its pieces between closing braces: one running sum."""
    # open braces less closed ones, pieces seen, and after how many pieces the two were first as many
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def add(a: Column, piece: Column) -> Column:
        open_now = a.open + F.length(piece) - F.length(F.translate(piece, "{", "")) - 1
        closed = (a.end == 0) & (open_now == 0) & (a.seen + 1 < F.size(pieces))
        return F.struct(open_now.alias("open"), (a.seen + 1).alias("seen"), F.when(closed, a.seen + 1).otherwise(a.end).alias("end"))

    body = lambda a: F.when(a.end > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), a.end), "}"), F.lit("}")))
    return F.aggregate(pieces, start, add, body)


__all__ = ["EXACT", "elements", "field", "first_object", "flag", "is_flag", "is_object", "kind", "number", "parsed", "text", "truthy", "whole"]
