"""Benchmark decontamination with a positional inverted index of the training texts.

The index is stored once: for each block of texts, and each term that a test passage asks for, a posting list of rows and
positions. An exact passage is found from its rarest terms: their posting lists, each shifted by the term's offset in the
passage, are intersected on (document, item, alignment), and the alignments left are confirmed word by word on the text.
A proximity match needs an item's rarest terms within so many words, in any order; it is read from the same lists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._store import shared_dir, stage

LENGTH, ANCHORS = 13, 3
MOST_TERMS = 1 << 20
"""Terms that tasks are told of beforehand (8 MB); with more, they index every word and a join leaves those asked for."""


def _words(data, offsets):
    _, _, h, first = _text.words(data, offsets, _text.NOT_ALNUM)
    return h.view(np.int64), first


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), item (the id as text), words array<long> of each test item that has words."""

    def run(batches):
        for batch in _text.pieces(batches, "text"):
            h, first = _words(*_text.utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h))], names=["row", "item", "words"])

    ids = F.coalesce(_names.col(id_col).cast("string"), F.lit(""))
    return items.select(F.monotonically_increasing_id().alias("row"), ids.alias("item"), _names.col(text_col).alias("text")).mapInArrow(run, "row long, item string, words array<long>").filter(F.size("words") > 0)


def _known(terms: DataFrame, most: int):
    """A broadcast of the sorted terms (term), or None if there are too many to send."""
    if terms.limit(most + 1).count() > most:
        return None
    return terms.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term for r in terms.collect()], np.int64)))


def build_index(docs: DataFrame, terms: DataFrame, folder: str, most_terms: int = MOST_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, keys, counts) of docs (key, text), written once.

    index: term, block, docs array<int>, positions array<int>, a row for each block of texts and each of ``terms``
    (term) in it; entry i of both arrays is one occurrence. keys: block, doc, key. counts: term, n.
    """
    shared = _known(terms, most_terms)

    def run(batches):
        known = None if shared is None else shared.value
        block = TaskContext.get().partitionId() << 32
        for batch in _text.pieces(batches, "text"):
            h, first = _words(*_text.utf8(batch.column(1)))
            row = _text.rows_of(first)
            place = np.arange(len(h)) - first[:-1][row]
            if known is not None:
                keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.empty(0, np.int64)
                h, row, place = h[keep], row[keep], place[keep]
            order = np.argsort(h, kind="stable")  # rows and positions ascend
            h, row, place = h[order], row[order], place[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            # one more row, without a term, for the keys of the block's texts
            at = pa.array(np.r_[new, len(h), len(h)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (row, place)]
            keys = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(new) + 1), batch.num_rows].astype(np.int32)), batch.column(0))
            term = pa.array(np.r_[h[new], 0], mask=np.r_[np.zeros(len(new), bool), True])
            yield pa.RecordBatch.from_arrays([term, pa.array(np.full(len(new) + 1, block)), *lists, keys], names=["term", "block", "docs", "positions", "keys"])
            block += 1

    made = stage(docs.select("key", "text").mapInArrow(run, "term long, block long, docs array<int>, positions array<int>, keys array<long>"), folder, "index")
    index = made.filter("term is not null").select("term", "block", "docs", "positions")
    if shared is None:
        index = index.join(terms, "term", "left_semi")
    keys = made.filter("term is null").select("block", F.posexplode("keys").alias("doc", "key"))
    return index, keys, index.groupBy("term").agg(F.sum(F.size("docs")).alias("n"))


def rare_terms(items: DataFrame, counts: DataFrame, length: int = LENGTH, anchors: int = ANCHORS) -> DataFrame:
    """row, term, offset, least, near, slop: the rarest terms of items (row, words), by counts (term, n).

    offset: where one of the ``anchors`` rarest terms of some window is in the item; least: how many must agree. near
    marks the item's rarest ``anchors`` terms, once each; slop: one and a half times the item's words.
    """
    placed = items.select("row", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")

    def run(key, table):
        order = np.argsort(table.column("offset").to_numpy())
        words, n = table.column("term").to_numpy()[order], table.column("n").fill_null(0).to_numpy()[order]
        rank = np.lexsort((np.arange(len(n)), n))
        place = np.empty(len(n), np.int64)
        place[rank] = np.arange(len(n))
        width = min(length, len(n))
        windows = np.lib.stride_tricks.sliding_window_view(place, width)
        least = min(anchors, width)
        chosen = set(rank[np.unique(np.sort(windows, 1)[:, :least])].tolist())
        near = {}
        for i in rank.tolist():
            if len(near) < anchors:
                near.setdefault(int(words[i]), i)
        rows = sorted(chosen | set(near.values()))
        marks = set(near.values())
        return pa.table({"row": pa.array([key[0].as_py()] * len(rows)), "term": pa.array(words[rows]), "offset": pa.array([i if i in chosen else None for i in rows], pa.int32()), "least": pa.array([least] * len(rows), pa.int32()), "near": pa.array([i in marks for i in rows]), "slop": pa.array([len(n) * 3 // 2] * len(rows), pa.int32())})

    return placed.groupBy("row").applyInArrow(run, "row long, term long, offset int, least int, near boolean, slop int")


def exact_candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """block, doc, row, shift: alignments (position in the document less offset in the item) at which the rarest terms agree."""
    wanted = rare.filter("offset is not null").select("row", "term", "offset", "least")
    hits = index.join(wanted, "term").select("block", "row", "offset", "least", F.explode(F.arrays_zip("docs", "positions")).alias("p"))
    hits = hits.groupBy("block", F.col("p.docs").alias("doc"), "row", (F.col("p.positions") - F.col("offset")).alias("shift")).agg(F.count("*").alias("n"), F.max("least").alias("least"))
    return hits.filter("n >= least").select("block", "doc", "row", "shift")


def proximity_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query, block, doc, position: where all terms of a query follow within its slop, in any order.

    queries: query, term, slop (words from the first to the last, both included). A match is given by the first of its
    words; of several with one first word the query and document come once for it. The documents of a query's rarest
    term are found first, and the other lists are read for these only.
    """
    wanted = queries.groupBy("query", "term").agg(F.max("slop").alias("slop"))
    df = index.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    rarest = wanted.join(df, "term", "left").groupBy("query").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"), F.count("*").alias("n_terms"))
    docs = index.join(rarest, "term").select("query", "n_terms", "block", F.explode(F.array_distinct("docs")).alias("doc"))
    # lists of the blocks that hold a query's rarest term, then of its documents
    rows = index.join(wanted, "term").join(docs.select("query", "block").distinct(), ["query", "block"], "left_semi")
    rows = rows.select("query", "block", "term", "slop", F.explode(F.arrays_zip("docs", "positions")).alias("p")).select("query", "block", F.col("p.docs").alias("doc"), "term", "slop", F.col("p.positions").alias("position"))
    found = rows.join(docs, ["query", "block", "doc"]).groupBy("query", "block", "doc").agg(F.max("n_terms").alias("n_terms"), F.max("slop").alias("slop"), F.collect_list(F.struct("position", "term")).alias("at")).filter(F.size("at") >= F.col("n_terms"))

    def run(batches):
        for batch in batches:
            of, places = [], []
            for i in range(batch.num_rows):
                at = batch.column("at")[i].values
                position, term = at.field(0).to_numpy(), at.field(1).to_numpy()
                order = np.argsort(position)
                position, kind = position[order], np.unique(term, return_inverse=True)[1][order]
                n, slop = batch.column("n_terms")[i].as_py(), batch.column("slop")[i].as_py()
                if len(set(kind.tolist())) < n:
                    continue
                held, end = np.zeros(n, np.int64), 0
                for begin in range(len(position)):
                    while end < len(position) and position[end] < position[begin] + slop:
                        held[kind[end]] += 1
                        end += 1
                    if held.all():
                        of.append(i)
                        places.append(int(position[begin]))
                    held[kind[begin]] -= 1
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("query", "block", "doc")), pa.array(places, pa.int32())], names=["query", "block", "doc", "position"])

    return found.mapInArrow(run, _names.with_fields(found, ["query", "block", "doc"], "position int"))


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    return [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, n_near, one row a row.

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower case. A window is ``length`` consecutive words of an
    item; an item of fewer is one window, one of none has none. n_hit: words of the document within occurrences of
    windows; n_items: items with occurring windows, whose ids as sorted text make items_sha256 (of the empty text if
    there are none); contaminated: n_hit > 0 and 100 * n_hit >= percent * n_words. n_near: items whose rarest ANCHORS
    terms occur, in any order, within one and a half times the item's words; it decides nothing. Null and empty texts
    have no words. Items that share an id count as one, null ids as ``""``. Rows that share a document id, or have
    none, are judged by their own texts. Columns may have any names; those named as the results are replaced.
    """
    folder = shared_dir(docs.sparkSession)
    items = stage(item_words(items, item_col, item_text), folder, "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    text = _names.col(text_col)
    # a text's results depend on the text alone: its hash is the key
    index, keys, counts = build_index(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), terms, folder, most_terms)
    rare = stage(rare_terms(items, counts, length, ANCHORS), folder, "rare")
    exact = exact_candidates(index, rare).withColumn("near", F.lit(False))
    near = proximity_matches(index, rare.filter("near").select(F.col("row").alias("query"), "term", "slop"))
    near = near.select("block", "doc", F.col("query").alias("row"), F.lit(None).cast("int").alias("shift"), F.lit(True).alias("near")).distinct()
    found = exact.union(near).join(keys, ["block", "doc"])
    # an item's words stand once in a document's row, however often they are looked for in it
    found = found.groupBy("key", "row").agg(F.collect_set("shift").alias("shifts"), F.max("near").alias("near"))
    found = found.join(items, "row").groupBy("key").agg(F.collect_list(F.struct("item", "shifts", F.when(F.size("shifts") > 0, F.col("words")).alias("words"), "near")).alias("at"))
    rows, names = _names.packed(docs, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"], text=text, key=F.xxhash64(text))
    joined = rows.join(found, "key", "left").select("row", "text", "at")

    def run(batches):
        none = hashlib.sha256(b"").hexdigest()
        for batch in _text.pieces(batches, "text"):
            h, first = _words(*_text.utf8(batch.column(1)))
            at, n = batch.column(2), batch.num_rows
            n_words, n_hit, n_items, n_near, sha = np.diff(first), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
            for i in np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)):
                own = h[first[i] : first[i + 1]]
                hit, ids, close = np.zeros(len(own), bool), set(), set()
                for c in at[i]:
                    item = c["item"].as_py()
                    if c["near"].as_py():
                        close.add(item)
                    if not c["words"].is_valid:
                        continue
                    words = c["words"].values.to_numpy()
                    for shift in c["shifts"].values.to_numpy().tolist():
                        a, b = max(0, shift), min(len(own), shift + len(words))
                        if b <= a:
                            continue
                        for x, y in _runs(own[a:b] == words[a - shift : b - shift], min(length, len(words))):
                            hit[a + x : a + y] = True
                            ids.add(item)
                n_hit[i], n_items[i], n_near[i] = hit.sum(), len(ids), len(close)
                if ids:
                    sha[i] = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            bad = (n_hit > 0) & (100 * n_hit >= percent * n_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(bad), pa.array(n_near)], names=["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])

    results = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"
    return _names.unpacked(joined.mapInArrow(run, _names.with_fields(joined, ["row"], results)), names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


ORACLE = r"""
WITH t AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, t),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, t),
iw AS (SELECT item, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p, w FROM i WHERE len(w) > 0),
wi AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM iw),
ns AS (SELECT DISTINCT n FROM wi),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, ns WHERE len(w) >= n),
x AS (SELECT doc_id, p, dw.n, item FROM dw JOIN wi ON dw.n = wi.n AND array_to_string(w[p : p + dw.n - 1], ' ') = wi.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM x) GROUP BY doc_id),
b AS (SELECT row_number() OVER () AS rn, item, w FROM i WHERE len(w) > 0),
o AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
c AS (SELECT term, count(*) AS n FROM o GROUP BY term),
u AS (SELECT rn, slop, term, min(pos) AS pos FROM (SELECT rn, len(w) * 3 // 2 AS slop, unnest(w) AS term, unnest(range(len(w))) AS pos FROM b) GROUP BY rn, slop, term),
rare AS (SELECT rn, slop, term FROM u LEFT JOIN c USING (term) QUALIFY row_number() OVER (PARTITION BY rn ORDER BY coalesce(n, 0), pos) <= 3),
sizes AS (SELECT rn, count(*) AS n_terms FROM rare GROUP BY rn),
seen AS (SELECT doc_id, rn, n_terms, count(DISTINCT term) OVER (PARTITION BY doc_id, rn ORDER BY pos RANGE BETWEEN CURRENT ROW AND slop - 1 FOLLOWING) AS s
         FROM o JOIN rare USING (term) JOIN sizes USING (rn)),
nr AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM seen JOIN b USING (rn) WHERE s = n_terms GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM x) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
