"""Shards of bounded bytes by extendible hashing.

A directory is indexed by the leading bits of each document's hash. A bucket above the byte limit is split on its next
bit, and only such a bucket, until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names
from chobo.llm._store import shared_dir, stage

LIMIT = 1 << 20
ID_BITS, TEXT_BITS, ROW_BITS = 48, 64, 48
"""Bits that come from the id; then, for rows that share an id, from the text; then, for repeated rows, from their number."""


def _hash_bits(column):
    return F.lpad(F.conv(F.substring(F.md5(column), 1, 12), 16, 2), 48, "0")


def _bits(id_col, depth: int):
    """The first ``depth`` bits of a row (id, tie, n)."""
    known = [_hash_bits(F.coalesce(id_col.cast("string"), F.lit("")))]
    if depth > ID_BITS:
        known.append(F.lpad(F.bin("tie"), TEXT_BITS, "0"))
    if depth > ID_BITS + TEXT_BITS:
        known.append(_hash_bits(F.col("n").cast("string")))
    return F.substring(F.concat(*known), 1, depth)


def _leaves(fine: DataFrame, start: int, depth: int, limit: int, folder: str) -> DataFrame:
    """bits, shard, shard_bytes, shard_docs: fine (bits, bytes, docs; buckets of ``depth`` bits) with the leaf of each.

    A leaf is a prefix that fits and whose own prefix does not; those of up to ``start`` bits are known not to fit. A
    bucket for which none fits is absent. A prefix is only ever joined with its two halves, and buckets with the
    prefixes of such lengths as leaves have.
    """
    at = fine.select("bytes", "docs", F.explode(F.transform(F.sequence(F.lit(start + 1), F.lit(depth)), lambda d: F.substring("bits", F.lit(1), d))).alias("prefix"))
    nodes = stage(at.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")), folder, f"nodes-{depth}")
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1)
    d = F.length("prefix")
    above = nodes.filter(~fits).select(F.col("prefix").alias("above"))
    whole = nodes.filter(fits & (d == start + 1))
    leaves = stage(whole.union(nodes.filter(fits & (d > start + 1)).join(above, F.substring("prefix", F.lit(1), d - 1) == F.col("above"), "left_semi")), folder, f"leaves-{depth}")
    depths = sorted(r[0] for r in leaves.select(F.length("prefix")).distinct().collect())
    if not depths:
        return leaves.select(F.col("prefix").alias("bits"), F.col("prefix").alias("shard"), "shard_bytes", "shard_docs")
    mine = fine.select("bits", F.explode(F.array(*[F.substring("bits", 1, k) for k in depths])).alias("shard"))
    return mine.join(leaves.withColumnRenamed("prefix", "shard"), "shard").select("bits", "shard", "shard_bytes", "shard_docs")


def shard_documents(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, directory).

    documents: all columns of ``docs`` with n_bytes (UTF-8 bytes of the text; null has none), shard (the bucket's hash
    bits, ``""`` while one shard holds all), depth (their number), shard_bytes, shard_docs, over_limit. directory: one
    row a shard. A shard has at most ``limit`` bytes, but for a single document that is larger; that has a shard of
    its own with over_limit true. Rows that share an id, or have none, share its bits, and part, if they must, on bits
    of their text; repeated rows, which are interchangeable, on those of a row number. Columns may have any names;
    those named as the results are replaced. An empty table has no shard.

    Splitting works on sums by prefix, not on documents: one pass gives the sums of all prefixes that the total calls
    for, and another follows only below buckets that are still too large. The directory stays a table.
    """
    folder = shared_dir(docs.sparkSession)
    new = ["n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "over_limit"]
    text = _names.col(text_col)
    rows, names = _names.packed(docs, new, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), tie=F.xxhash64(text), n=F.monotonically_increasing_id())
    rows = stage(rows, folder, "rows")
    total, n = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    if total <= limit or n <= 1:
        parts = [rows.withColumns({"shard": F.lit(""), "shard_bytes": F.lit(total).cast("long"), "shard_docs": F.lit(n).cast("long")})]
        left = 0
    else:
        parts, left, depth = [], n, 0
        step = step or max(4, math.ceil(math.log2(total / limit)) + 4)
        rest, most = rows, ID_BITS + TEXT_BITS + ROW_BITS
        while left:
            start, depth = depth, min(depth + step, most)
            step = 8
            bits = _bits(_names.field(id_col), depth)
            fine = stage(rest.groupBy(bits.alias("bits")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), folder, f"fine-{depth}")
            leaves = stage(_leaves(fine, start, depth, limit, folder), folder, f"shards-{depth}")
            keyed = rest.withColumn("fine", bits)
            parts.append(keyed.join(leaves, F.col("fine") == F.col("bits")).drop("fine", "bits"))
            left = fine.join(leaves, "bits", "left_anti").limit(1).count() if depth < most else 0
            rest = keyed.join(leaves.select("bits"), F.col("fine") == F.col("bits"), "left_anti").drop("fine")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = _names.unpacked(out, names, "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("over_limit"))
    directory = out.groupBy("shard", "depth", "shard_bytes", "shard_docs", "over_limit").agg(F.count("*").alias("rows")).drop("rows")
    return out, directory


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT), 48, '0') AS bits FROM documents),
p AS (SELECT k, substr(bits, 1, k) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
      FROM d, (SELECT unnest(range(49)) AS k) GROUP BY k, substr(bits, 1, k)),
f AS (SELECT * FROM p WHERE shard_bytes <= {LIMIT} OR shard_docs <= 1),
x AS (SELECT d.doc_id, d.n_bytes, f.shard, f.k::INTEGER AS depth, f.shard_bytes, f.shard_docs,
             row_number() OVER (PARTITION BY d.doc_id ORDER BY f.k) AS r
      FROM d JOIN f ON substr(d.bits, 1, f.k) = f.shard)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, shard_bytes > {LIMIT} AS over_limit FROM x WHERE r = 1
"""
