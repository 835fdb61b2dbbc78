"""Mixing of sources to target weights by weighted fair queueing.

Each document of a shuffled source gets a virtual finish time: the source's words up to and with it, over the source's
target. The mix is all documents by that time, cut where the total budget is used up; a source whose target is above
its size comes round again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chobo.llm import _names
from chobo.llm._store import shared_dir, stage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
PART_ROWS, PART_WORDS = 1 << 20, 1 << 24
"""Rows and words of a part of the sorted order, about."""


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(_names.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target stops at
    ``most`` times its source's size; what is above is shared again by weight. That ends at one level, a target for
    each unit of weight, which running sums over the sources by their stop for each unit of weight give at once. The
    sums run over the sources alone, one row each, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by = [F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()]
    up = Window.orderBy(*by)
    everything = Window.partitionBy()
    t = t.withColumns({"before": F.sum("stop").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("stop"), "w_left": F.sum("w").over(everything) - F.sum("w").over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"), "total": F.sum("source_size").over(everything)})
    level = (F.col("total") * F.lit(float(share)) - F.col("before")) / F.col("w_left")
    t = t.withColumn("level", F.when(level * F.col("w") <= F.col("stop"), level))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.coalesce(F.least("stop", F.col("level") * F.col("w")), F.col("stop")).alias("target"))


def _running(rows: DataFrame, by: list, parts: int, folder: str, name: str) -> DataFrame:
    """rows with part, at (the row's place in its part) and run: the sum of ``size`` up to and with the row in order ``by``.

    The order is one range sort. A part adds up its own rows as they pass, and the parts' sums, one row each, give
    where each part begins; so no task and no group sees more than a part.
    """
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def run(batches):
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            own = np.cumsum(batch.column(batch.schema.get_field_index("size")).to_numpy()) + before
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(own)], names=[*batch.schema.names, "part", "at", "own"])
            at, before = at + n, int(own[-1]) if n else before

    summed = stage(ordered.mapInArrow(run, _names.with_fields(ordered, ordered.columns, "part int, at long, own long")), folder, name)
    begins = summed.groupBy("part").agg(F.max("own").alias("s"))
    begins = begins.select(F.col("part").alias("p"), (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("begin"))
    # one row for each part of the sort
    return summed.join(F.broadcast(begins), F.col("part") == F.col("p")).withColumn("run", F.col("begin") + F.col("own")).drop("p", "begin", "own")


def mix_sources(docs: DataFrame, seed: int = 20, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, part_rows: int = PART_ROWS, part_words: int = PART_WORDS) -> tuple[DataFrame, DataFrame]:
    """(mix, account).

    mix: the columns of ``docs`` with mix_round and mix_time, one row for each time that a document is taken, in the
    order of the mix: partitions and rows within them follow virtual time. account: id_col, size, source_size, target,
    taken, mix_times for each row of ``docs``. Sizes are words ([^\\x20\\x09-\\x0D]+); null and empty texts have none,
    and are taken in turn as others are. Ties of the shuffled order and of virtual time go by id, size and the text's
    hash; rows that tie in all of these are interchangeable. Sources without words have target 0 and nothing of them
    is taken. Columns may have any names; those named as the results are replaced. size_col: a long column that holds
    the sizes already; the text need not be among the columns then.

    Rows are numbered and written once. Both range sorts, by source and shuffled key and then by virtual time, move
    numbers only; texts are joined to what was taken at the end.
    """
    folder, spark = shared_dir(docs.sparkSession), docs.sparkSession
    size = F.coalesce(_names.col(size_col), F.lit(0)).cast("long") if size_col else word_count(text_col)
    tie = F.xxhash64(_names.col(text_col)) if text_col in docs.columns else F.lit(0).cast("long")
    rows, names = _names.packed(docs, ["mix_round", "mix_time"], n=F.monotonically_increasing_id(), size=size, tie=tie)
    rows = stage(rows, folder, "rows")
    key = F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(_names.field(id_col).cast("string"), F.lit("")))))
    small = rows.select("n", "size", "tie", _names.field(id_col).alias("id"), _names.field(source_col).alias("src"), key.alias("key"))
    by_source = stage(small.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), folder, "sources")
    n, total = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // part_rows + 1, total // part_words + 1)
    targets = source_targets(by_source.drop("n"), weights, share, most)
    targets = targets.withColumn("others", F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_last())) - F.col("source_size"))

    timed = _running(small, [F.col("src").asc_nulls_last(), "key", "id", "size", "tie", "n"], parts, folder, "shuffled").drop("part", "at")
    timed = timed.join(targets, F.col("src").eqNullSafe(F.col("source"))).withColumn("upto", F.col("run") - F.col("others"))
    timed = stage(timed.select("n", "size", "tie", "id", "key", "source_size", "target", "upto"), folder, "finish")
    again = F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(most)) - 1)))
    queue = timed.filter("target > 0").select("n", "size", "tie", "id", "key", "source_size", "target", "upto", again.alias("round"))
    queue = queue.withColumn("time", (F.col("source_size") * F.col("round") + F.col("upto")) / F.col("target")).drop("source_size", "target", "upto")
    queue = _running(queue, ["time", "key", "id", "size", "tie", "round", "n"], parts, folder, "queue")
    taken = queue.filter(F.col("run") <= F.lit(total * float(min(share, most)))).select("n", "round", "time", "part", "at")

    times = taken.groupBy("n").agg(F.count("*").alias("mix_times"))
    account = timed.join(times, "n", "left").withColumn("mix_times", F.coalesce("mix_times", F.lit(0)))
    account = account.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("mix_times")).alias("taken"), "mix_times")
    mix = rows.select("n", "row").join(taken, "n").repartitionById(parts, F.col("part")).sortWithinPartitions("at")
    return _names.unpacked(mix, names, F.col("round").alias("mix_round"), F.col("time").alias("mix_time")), account


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('20:' || coalesce(doc_id::VARCHAR, '')) AS k, row_number() OVER () AS rid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
a AS (SELECT source, ss, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, ss * 2.0::DOUBLE AS stop FROM s),
b AS (SELECT *, sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - stop AS before,
             sum(w) OVER () - sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) + w AS wl, (sum(ss) OVER ())::BIGINT AS total FROM a),
c AS (SELECT *, (total * 1.5::DOUBLE - before) / wl AS lv FROM b),
lev AS (SELECT arg_min(lv, stop / w) AS lv FROM c WHERE lv * w <= stop),
t AS (SELECT source, ss, total, coalesce(least(stop, (SELECT lv FROM lev) * w), stop) AS target FROM c),
f AS (SELECT d.*, ss, total, target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, unnest([0, 1]) AS e FROM f WHERE target > 0),
o AS (SELECT rid, size, total, sum(size) OVER (ORDER BY (ss * e + upto) / target, k, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
n AS (SELECT rid, count(*) AS times FROM o WHERE run <= total * 1.5::DOUBLE GROUP BY rid)
SELECT doc_id, size, ss AS source_size, target, (size * coalesce(times, 0))::BIGINT AS taken, coalesce(times, 0)::BIGINT AS mix_times
FROM f LEFT JOIN n USING (rid)
"""
