"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chobo.llm.ranked_search import Shard, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain(docs, items, top=20):
    """(item, rank, doc, score) of all items, every document scored."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in words(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(25))
def test_intervals(seed, monkeypatch):
    """Best-first search of one shard, with many ties, and with intervals that are hardly ever scored whole."""
    from chobo.llm import ranked_search

    rng = np.random.default_rng(seed)
    monkeypatch.setattr(ranked_search, "SHORT", int(rng.choice([0, 3, 40])))
    monkeypatch.setattr(ranked_search, "WIDTH", int(rng.choice([1, 2, 16])))
    n_docs, n_terms = int(rng.integers(1, 400)), 12
    table = np.where(rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)), rng.integers(0, int(rng.choice([3, 1000])), (n_terms, n_docs)), -1)
    terms, docs = np.nonzero(table >= 0)
    shard = Shard(terms, docs, table[terms, docs].astype(np.int64), n_docs)
    asked = [np.unique(rng.integers(0, n_terms, int(rng.integers(1, 8)))) for _ in range(9)]
    first, code = np.r_[0, np.cumsum([len(a) for a in asked])], np.concatenate(asked)
    times = rng.integers(1, 4, len(code))
    q, d, s = shard.search(first, code, times, 7)
    for k in range(9):
        own = slice(first[k], first[k + 1])
        total = (np.maximum(table[code[own]], 0) * times[own, None]).sum(axis=0)
        want = [(i, total[i]) for i in np.lexsort((np.arange(n_docs), -total)) if total[i] > 0][:7]
        assert list(zip(d[q == k], s[q == k], strict=True)) == want


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["alpha", "BETA", "gämma", "the", "The", "x1", "9", "日本", "a_b", "don't", *(f"w{i}" for i in range(60))]
    text = lambda size: " ".join(rng.choice(vocabulary[: rng.choice([8, 70])]) for _ in range(size))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(n)]
    docs += [(1000 + i, "alpha beta alpha copy") for i in range(50)] + [(3, docs[3][1]), (None, "alpha beta alpha copy"), (7, None), (8, ""), (9, "... --- ..."), (5000, "w1 " * 40_000)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(30, "alpha copy"), (31, "nowhere"), (32, None), (33, ""), (34, "the the The THE"), (34, "w3"), (None, "w4 w4")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"most_terms": 3, "most_pairs": 40, "shard_postings": 500}])
def test_rankings(spark, limits):
    docs, items = corpus(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id int, text string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in search(d, q, **limits).collect()]
    assert sorted(got, key=str) == plain(docs, items)


def test_odd_columns_and_empty_tables(spark):
    d = spark.createDataFrame([("7", "a b", 1, 2), ("x", "a a", 1, 2), ("5", "c", 1, 2)], "`my.id` string, `te``xt` string, term int, block int")
    q = spark.createDataFrame([("q", "A", 1)], "key string, text string, number int")
    got = [tuple(r) for r in search(d, q, id_col="my.id", text_col="te`xt", item_col="key").orderBy("rank").collect()]
    want = plain([(7, "a b"), (None, "a a"), (5, "c")], [("q", "a")])
    assert sorted(got, key=str) == want and len(want) == 2
    assert search(d.filter("false"), q, id_col="my.id", text_col="te`xt", item_col="key").collect() == []
    assert search(d, q.filter("false"), id_col="my.id", text_col="te`xt", item_col="key").collect() == []
