"""A membership index of keys: a bitmap that says of most absent keys that they are absent, before anything is joined.

Keys are hashed to the bits of one bitmap whose size follows their count, so about one absent key in ``bits`` is let
through. The bitmap is built by aggregation, in pieces of 32,768 bits, and kept as a table of these pieces: 2 bytes a key
at 16 bits. Up to LARGEST bytes it is sent to all tasks; a larger one is joined by piece.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 32_768
LARGEST = 64 << 20


class Index(NamedTuple):
    pieces: DataFrame
    """piece, bitmap: pieces with a bit set."""
    size: int
    """Bits of the whole bitmap."""
    send: bool


def _place(key: Column, size: int) -> Column:
    # counted from 1, as the bitmap functions count
    return F.pmod(F.xxhash64(key), F.lit(size)) + 1


def build(keys: DataFrame, key: str, bits: int = 16, largest: int = LARGEST) -> Index:
    """The index of a column. Null is no key; repeated keys do no harm."""
    some = keys.select(F.col(key).alias("k")).filter("k is not null")
    size = -(-max(1, some.count()) * bits // PIECE) * PIECE
    p = _place(F.col("k"), size)
    pieces = some.groupBy(F.bitmap_bucket_number(p).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap"))
    return Index(pieces, size, size // 8 <= largest)


def maybe(rows: DataFrame, key: str, index: Index) -> DataFrame:
    """The rows whose key may be in the index: all that are, and about one in ``bits`` of the others."""
    p = _place(F.col(key), index.size)
    s = rows.withColumns({"__piece": F.bitmap_bucket_number(p), "__bit": F.bitmap_bit_position(p)})
    pieces = index.pieces.withColumnsRenamed({"piece": "__piece", "bitmap": "__bitmap"})
    s = s.join(F.broadcast(pieces) if index.send else pieces, "__piece")
    byte = F.conv(F.hex(F.substr("__bitmap", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    weight = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("__bit") % 8 + 1).cast("int"))
    return s.filter(byte.bitwiseAND(weight) != 0).select(*rows.columns)


def present(rows: DataFrame, key: str, keys: DataFrame, of: str, bits: int = 16, largest: int = LARGEST) -> DataFrame:
    """The rows whose key is in column ``of`` of keys, exactly: what the index lets through is confirmed by a join."""
    real = keys.select(F.col(of).alias("__real")).distinct()
    return maybe(rows, key, build(keys, of, bits, largest)).join(real, F.col(key) == F.col("__real"), "left_semi")
