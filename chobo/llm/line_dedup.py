"""Removal of repeated passages of lines, with DataFrame operations only.

Every three consecutive lines of a text are a window. A window that occurs more than once anywhere keeps its first
occurrence; the lines of all later occurrences go, where overlapping occurrences are merged into spans first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chobo.llm import _names

WINDOW = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with text_col cut down, and n_lines, n_removed, n_spans (longs).

    Lines are parted by a line feed and compared as they are. Occurrences are ordered by id (null first), then by the
    text's hash, then by position; a row that repeats another's id and text counts as the same document, so neither
    loses by the other. Windows of blank lines alone are no windows: they carry no text, and every document with two
    blank lines between paragraphs would lose its layout. Texts of fewer lines than a window have none and stay. Null texts stay null with no lines; an empty text has one line. Windows are compared by two 64-bit hashes.
    Columns may have any names; those named as the results are replaced.

    Counting is pre-aggregated before it is shuffled, and the one join on windows may be split where one is common.
    """
    text = _names.col(text_col)
    base, names = _names.packed(docs, ["n_lines", "n_removed", "n_spans"], id=_names.col(id_col), t=F.xxhash64(text), text=text, lines=F.split(text, "\n", -1))
    n = F.size("lines")
    at = lambda i, k: F.element_at(F.col("lines"), i + k + 1)
    cut = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[at(i, k) for k in range(window)]).alias("h1"), F.xxhash64(F.lit(1), *[at(i, k) for k in reversed(range(window))]).alias("h2"), F.concat(*[at(i, k) for k in range(window)]).rlike(r"[^\x20\x09-\x0D]").alias("full"))
    found = base.filter(n >= window).select("id", "t", F.explode(F.transform(F.sequence(F.lit(0), n - window), cut)).alias("w"))
    found = found.filter("w.full").select("id", "t", "w.pos", "w.h1", "w.h2")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("id", "t", "pos")).alias("first")).filter("times > 1").drop("times")
    later = found.join(first, ["h1", "h2"]).filter(~F.struct("id", "t", "pos").eqNullSafe(F.col("first"))).select("id", "t", "pos").distinct()
    w = Window.partitionBy("id", "t").orderBy("pos")
    runs = later.withColumn("new", (F.col("pos") >= F.lag("pos", 1, -window - 1).over(w) + window + 1).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("id", "t", "run").agg(F.min("pos").alias("a"), (F.max("pos") + window).alias("b"))
    spans = runs.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")).withColumnsRenamed({"id": "i", "t": "u"})
    joined = base.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left")
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s.b))
    ends = F.concat(F.transform("spans", lambda s: s.a), F.array(n))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: F.slice("lines", g.a + 1, g.b - g.a)))
    hit = F.col("spans").isNotNull()
    removed = F.aggregate("spans", F.lit(0), lambda s, x: s + x.b - x.a)
    return joined.select(
        *[F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text")).alias(c) if c == text_col else _names.field(c).alias(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(hit, removed).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.size("spans")).otherwise(0).cast("long").alias("n_spans"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, p, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS win
      FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS p FROM l WHERE len(lines) >= 3)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k
      FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM r, (SELECT unnest(range(3)) AS o) WHERE k > 1),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(new)::BIGINT AS n_spans FROM
         (SELECT doc_id, i, CASE WHEN i = lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 1 THEN 0 ELSE 1 END AS new FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM
         (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l) x
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM l LEFT JOIN runs ON l.doc_id = runs.doc_id LEFT JOIN kept ON l.doc_id = kept.doc_id
"""
