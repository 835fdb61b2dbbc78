"""Ranked lexical search: the best documents of each query, without scoring them all.

The index holds, for each block of documents and each term, a posting list of documents and occurrences, stored once.
With the counts of the whole corpus every posting has a whole-number impact. A search works shard by shard (a few
blocks): each posting list gets a sparse table that answers which posting of any range has the greatest impact. The
documents of a shard are one interval; the sum of its terms' greatest impacts bounds the score of every document in it.
The intervals of greatest bound are split at the document where their greatest single impact is: that document is scored,
the two sides get bounds of their own, short intervals are scored whole. A query is done when no bound reaches its
k-th best score; equal scores go by document, and intervals that could only tie with later documents are left too.
The best of the shards are then ranked against each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chobo.llm import _names, _text
from chobo.llm._store import shared_dir, stage

TOP = 20
MOST_TERMS = 1 << 20
"""Query terms that tasks are told of beforehand; with more, they index every term and a join leaves those asked for."""
MOST_PAIRS = 1 << 18
"""Pairs of a query and a term of it that are searched at a time (some 10 MB); a larger set is searched part by part."""
SHARD_POSTINGS = 1 << 20
"""Postings of a shard, about: with their tables some 100 MB of a task."""
AT_ONCE, WIDTH, SHORT = 256, 16, 256
"""Queries of a shard in hand at a time, intervals of each that are split at a time, postings of an interval that is scored whole."""


def _terms(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each term, different terms by number, first term of each row) of texts, A-Z as a-z."""
    data, offsets = _text.utf8(text)
    s, e, _, first = _text.words(data, offsets, _text.NOT_ALNUM, hashes=False)
    numbers, terms = _text.named(data, s, e, lower=True)
    return numbers, terms.cast(pa.string()), first


def _tally(row: np.ndarray, number: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, row, times) of the pairs of both, by number and row."""
    key, times = np.unique(number.astype(np.int64) * rows + row, return_counts=True)
    return key // max(rows, 1), key % max(rows, 1), times


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """number (of the row), item, term, times of the terms of each query."""

    def run(batches):
        for b in _text.pieces(batches, "text"):
            numbers, terms, first = _terms(b.column("text"))
            term, row, times = _tally(_text.rows_of(first), numbers, b.num_rows)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("number").take(at), b.column("item").take(at), terms.take(pa.array(term)), pa.array(times)], names=["number", "item", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("number"), _names.col(id_col).alias("item"), _names.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _names.with_fields(rows, ["number", "item"], "term string, times bigint"))


def build_index(docs: DataFrame, terms: DataFrame, folder: str, most_terms: int = MOST_TERMS) -> DataFrame:
    """The stored index of docs (id long, text) for ``terms`` (term, different ones).

    A row for each block and term of it: block, term, places and counts (int32 arrays as bytes: documents by their place
    in the block, occurrences), df. A row without term for each block: ids, counts (terms of each document), df
    (documents of the block with a term at all) and words (all their terms). Documents without any of ``terms`` have no
    place in ids, but are counted.
    """
    spark = docs.sparkSession
    shared = None
    if terms.limit(most_terms + 1).count() <= most_terms:
        shared = spark.sparkContext.broadcast(terms.select("term").toArrow().column(0).combine_chunks())

    def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(4 * np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(values.astype(np.int32))])

    def run(batches):
        wanted = None if shared is None else shared.value
        block = TaskContext.get().partitionId() << 33
        for b in _text.pieces(batches, "text"):
            numbers, words, first = _terms(b.column("text"))
            sizes = np.diff(first)
            row = _text.rows_of(first)
            if wanted is not None:
                known = pc.is_in(words, value_set=wanted).to_numpy(zero_copy_only=False)
                here = known[numbers] if len(numbers) else np.empty(0, bool)
                row, numbers = row[here], numbers[here]
            term, row, times = _tally(row, numbers, b.num_rows)
            docs_here, place = np.unique(row, return_inverse=True)
            at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
            df = np.diff(np.r_[at, len(term)])
            n = len(at)
            ids = pa.ListArray.from_arrays(pa.array(np.array([0] * (n + 1) + [len(docs_here)], np.int32)), b.column("id").take(pa.array(docs_here)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, block)), pa.concat_arrays([words.take(pa.array(term[at])), pa.nulls(1, pa.string())]), ids, binary(place, np.r_[df, 0]), binary(np.concatenate([times, sizes[docs_here]]), np.r_[df, len(docs_here)]), pa.array(np.r_[df, (sizes > 0).sum()]), pa.array(np.r_[np.zeros(n, np.int64), sizes.sum()])],
                names=["block", "term", "ids", "places", "counts", "df", "words"],
            )
            block += 1

    index = docs.mapInArrow(run, "block bigint, term string, ids array<bigint>, places binary, counts binary, df bigint, words bigint")
    return stage(index, folder, "index")


class Shard:
    """Posting lists of a shard, with range-maximum tables, and the best-first search over its documents.

    docs, terms, impacts: of every posting, by term and document; n_docs: documents, numbered in the order of ties.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        self.docs, self.impacts, self.n_docs = docs, impacts, n_docs
        self.keys = terms * n_docs + docs
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        # best[k][i]: the place of the greatest impact of the 2**k postings from i on; ranges never leave a list
        self.best = [np.arange(len(docs), dtype=np.int32)]
        for k in range(max(longest, 1).bit_length() - 1):
            below = self.best[-1]
            a, b = below[: len(docs) - (2 << k) + 1], below[1 << k : len(docs) - (1 << k) + 1]
            self.best.append(np.where(impacts[a] >= impacts[b], a, b))
        self.start = np.r_[0, np.cumsum([len(x) for x in self.best])]
        self.best = np.concatenate(self.best)

    def top(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, place) of the greatest impact among the postings of each range; 0 and -1 of an empty one."""
        value, place = np.zeros(len(lo), np.int64), np.full(len(lo), -1, np.int64)
        at = np.flatnonzero(hi > lo)
        lo, hi = lo[at], hi[at]
        k = np.frexp((hi - lo).astype(float))[1] - 1
        a, b = self.best[self.start[k] + lo], self.best[self.start[k] + hi - (1 << k)]
        place[at] = np.where(self.impacts[a] >= self.impacts[b], a, b)
        value[at] = self.impacts[place[at]]
        return value, place

    def search(self, first: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the k best documents of each query; its terms are first[q] .. first[q + 1]."""
        n = len(first) - 1
        found = (np.empty(0, np.int64),) * 3
        floor, edge = np.zeros(n, np.int64), np.zeros(n, np.int64)
        query, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, self.n_docs, np.int64)
        of, x, begin = self._rows(query, first)
        bound = self._sums(of, times[x] * self.top(self._at(terms[x], lo[of]), self._at(terms[x], hi[of]))[0], n)
        while True:
            # an interval stays while a document of it could come before the k-th best one
            live = (bound > floor[query]) | ((bound == floor[query]) & (bound > 0) & (lo < edge[query]))
            query, lo, hi, bound = query[live], lo[live], hi[live], bound[live]
            if not len(query):
                return found
            order = np.lexsort((lo, -bound, query))
            query, lo, hi, bound = query[order], lo[order], hi[order], bound[order]
            group = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            chosen = np.arange(len(query)) - np.repeat(group, np.diff(np.r_[group, len(query)])) < WIDTH
            q, a, b = query[chosen], lo[chosen], hi[chosen]
            rest = [v[~chosen] for v in (query, lo, hi, bound)]
            of, x, begin = self._rows(q, first)
            p, r = self._at(terms[x], a[of]), self._at(terms[x], b[of])
            short = self._sums(of, r - p, len(q)) <= SHORT
            got, sides = [self._whole(q, of, times[x], p, r, short)], []
            if not short.all():
                use = ~short[of]
                of, x, p, r = of[use], x[use], p[use], r[use]
                value, place = self.top(p, r)
                value = value * times[x]
                head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                long = of[head]
                # the posting of the greatest impact of each interval: where it is split
                best = np.lexsort((-value, of))[head]
                cut = np.zeros(len(q), np.int64)
                cut[long] = self.docs[place[best]]
                middle = self._at(terms[x], cut[of])
                there = (middle < r) & (self.docs[np.minimum(middle, len(self.docs) - 1)] == cut[of])
                score = self._sums(of, np.where(there, times[x] * self.impacts[np.minimum(middle, len(self.docs) - 1)], 0), len(q))
                got.append((q[long], cut[long], score[long]))
                for s, e, left in ((p, middle, True), (middle + there, r, False)):
                    high = self._sums(of, times[x] * self.top(s, e)[0], len(q))
                    sides.append((q[long], a[long] if left else cut[long] + 1, cut[long] if left else b[long], high[long]))
            found = self._best(found, got, k)
            size = np.bincount(found[0], minlength=n)
            full = np.flatnonzero(size >= k)
            last = np.cumsum(size)[full] - 1
            floor[full], edge[full] = found[2][last], found[1][last]
            query, lo, hi, bound = (np.concatenate(v) for v in zip(rest, *sides, strict=True))

    def _rows(self, query, first):
        """(interval, place in terms) of every pair of an interval and a term of its query, and where each interval begins."""
        size = np.diff(first)[query]
        begin = np.r_[0, np.cumsum(size)]
        of = np.repeat(np.arange(len(query)), size)
        return of, np.arange(begin[-1]) - begin[of] + first[query][of], begin

    def _at(self, term, doc):
        return np.searchsorted(self.keys, term * self.n_docs + doc)

    @staticmethod
    def _sums(of, values, n):
        out = np.zeros(n, np.int64)
        np.add.at(out, of, values)
        return out

    def _whole(self, q, of, times, p, r, short):
        """(query, document, score) of all documents with a posting in the short intervals."""
        use = short[of] & (r > p)
        of, times, p, r = of[use], times[use], p[use], r[use]
        size = r - p
        row = np.repeat(np.arange(len(p)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + p[row]
        key, own = np.unique(of[row] * self.n_docs + self.docs[at], return_inverse=True)
        return q[key // self.n_docs], key % self.n_docs, self._sums(own, times[row] * self.impacts[at], len(key))

    @staticmethod
    def _best(found, got, k):
        query, doc, score = (np.concatenate(v) for v in zip(found, *got, strict=True))
        good = score > 0
        query, doc, score = query[good], doc[good], score[good]
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        group = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        keep = np.arange(len(query)) - np.repeat(group, np.diff(np.r_[group, len(query)])) < k
        return query[keep], doc[keep], score[keep]


def _impacts(tf: np.ndarray, size: np.ndarray, weight: np.ndarray, n: int, words: int) -> np.ndarray:
    m = 75 + 25 * size * n // max(words, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _shard_of(rows: pa.Table, wanted: pa.Array, weight: np.ndarray, n: int, words: int):
    """(Shard, ids by document) of the rows of the index that belong to some blocks; wanted: terms by number."""
    rows = rows.combine_chunks()
    number = pc.index_in(rows.column("term"), value_set=wanted).combine_chunks().to_pylist()
    ids, place, sizes, lists = [], {}, [], []
    done = 0
    for i, term in enumerate(rows.column("term").is_null().to_pylist()):
        if term:
            own = rows.column("ids")[i].values
            place[rows.column("block")[i].as_py()] = done
            ids.append(own)
            sizes.append(np.frombuffer(rows.column("counts")[i].as_py(), np.int32))
            done += len(own)
        elif number[i] is not None:
            lists.append(i)
    ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
    sizes = np.concatenate(sizes or [np.empty(0, np.int32)]).astype(np.int64)
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(done, np.int64)
    rank[order] = np.arange(done)
    raw = [(rows.column("places")[i].as_py(), rows.column("counts")[i].as_py(), place[rows.column("block")[i].as_py()], number[i]) for i in lists]
    length = np.array([len(x[0]) // 4 for x in raw], np.int64)
    docs = np.frombuffer(b"".join(x[0] for x in raw), np.int32).astype(np.int64) + np.repeat(np.array([x[2] for x in raw], np.int64), length)
    tf = np.frombuffer(b"".join(x[1] for x in raw), np.int32).astype(np.int64)
    terms = np.repeat(np.array([x[3] for x in raw], np.int64), length)
    impacts = _impacts(tf, sizes[docs], weight[terms], n, words)
    docs = rank[docs]
    by = np.lexsort((docs, terms))
    return Shard(terms[by], docs[by], impacts[by], done), ids.take(pa.array(order))


def _searcher(shared, n: int, words: int, top: int):
    """The search of one shard, given the rows of the index that belong to it."""

    def run(rows: pa.Table) -> pa.Table:
        number, code, times, terms, by_term = shared.value
        shard, ids = _shard_of(rows, terms, by_term, n, words)
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
        queries, first = number[first], np.r_[first, len(number)]
        got = [(np.empty(0, np.int64),) * 3]
        for a in range(0, len(queries), AT_ONCE):
            b = min(a + AT_ONCE, len(queries))
            s, e = first[a], first[b]
            q, doc, score = shard.search(first[a : b + 1] - s, code[s:e], times[s:e], top)
            got.append((queries[a:b][q], doc, score))
        query, doc, score = (np.concatenate(v) for v in zip(*got, strict=True))
        return pa.table({"number": pa.array(query), "id": ids.take(pa.array(doc)), "score": pa.array(score)})

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_terms: int = MOST_TERMS, most_pairs: int = MOST_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_col, rank (int, from 1), id_col (long), score (long): the ``top`` best documents of each row of ``items``.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of whole texts with A-Z as a-z. With N documents that have a term, L
    terms of them all, n of one document, df documents with a term and tf times that it is in one: a term weighs
    floor(1000 * ln((2N + 2) / (2df + 1))) and adds weight * (10**9 * tf div (1000 * tf + 12 * m)) each time that the
    query holds it, m = 75 + 25 * n * N div L. Only scores above 0 are ranked; equal ones go by document, null last.

    Null and empty texts have no terms; queries without terms, or whose terms no document has, have no rows. Each row of
    ``items`` is a query of its own, whatever its id, and each row of ``docs`` a document of its own; ids that are no
    whole numbers count as null. Other columns do not matter. Without documents there are no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    asked = stage(query_terms(items, item_col, item_text_col), folder, "queries")
    texts = docs.select(_names.col(id_col).try_cast("long").alias("id"), _names.col(text_col).cast("string").alias("text"))
    index = build_index(texts, asked.select("term").distinct(), folder, most_terms)
    lists = index.filter("term is not null")
    of_blocks = lambda c: F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col(c))), F.lit(0))
    n, words, blocks, postings = index.agg(of_blocks("df"), of_blocks("words"), F.count_if(F.col("term").isNull()), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("df"))), F.lit(0))).first()
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = stage(asked.join(df, "term").select("number", "term", "times", weight.alias("weight")), folder, "pairs")
    parts, shards = max(1, -(-pairs.count() // most_pairs)), max(1, min(blocks, -(-postings // shard_postings)))
    out = None
    for part in range(parts):
        own = pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == part)
        t = own.select("number", "term", "times", "weight").toArrow().combine_chunks()
        t = t.sort_by("number")
        coded = t.column("term").combine_chunks().dictionary_encode() if t.num_rows else pa.array([], pa.string()).dictionary_encode()
        number, times, weights, code = t.column("number").to_numpy(), t.column("times").to_numpy(), t.column("weight").to_numpy(), coded.indices.to_numpy()
        by_term = np.zeros(len(coded.dictionary), np.int64)
        by_term[code] = weights
        shared = spark.sparkContext.broadcast((number, code.astype(np.int64), times, coded.dictionary, by_term))

        rows = index.filter("term is null").unionByName(lists.join(own.select("term").distinct(), "term", "left_semi").select(index.columns))
        rows = rows.select(F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"), "block", "term", "ids", "places", "counts")
        best = rows.groupBy("shard").applyInArrow(_searcher(shared, n, words, top), "number bigint, id bigint, score bigint")
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = asked.select("number", "item").distinct()
    return ranked.join(names, "number").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


ORACLE = r"""
WITH term AS (SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
              FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
tf AS (SELECT doc_id, row, t, count(*) AS tf FROM term GROUP BY ALL),
size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS words FROM size),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
item AS (SELECT item_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
         FROM (SELECT item_id, text, row_number() OVER () AS row FROM benchmark)),
asked AS (SELECT item_id, row, t, count(*) AS times FROM item GROUP BY ALL),
scored AS (SELECT item_id, asked.row AS item_row, doc_id, tf.row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // words))))::BIGINT AS score
           FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN size ON tf.row = size.row, total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
