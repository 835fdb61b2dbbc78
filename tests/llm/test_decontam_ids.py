"""Benchmark rows that share an id, or have none, are looked for each by its own length."""

import hashlib
import re

from chobo.llm import decontam

WORDS = re.compile(r"[a-z0-9]+")


def test_items_that_share_an_id(spark):
    long = "an item of many words that nothing else in here does hold at all today"
    items = [(1, "zebra"), (1, long), (None, "yak wool"), (None, long + " or ever"), (2, "zebra"), (3, "x y")]
    docs = [(0, "a zebra came"), (1, "yak wool and zebra and yak wool"), (2, long), (3, "nothing"), (4, "zebra " * 5000), (5, None)]
    for order in (items, items[::-1]):
        frame = spark.createDataFrame(order, "item_id long, text string").coalesce(1)
        got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
        for i, t in docs:
            w, hit, found = WORDS.findall(t or ""), set(), set()
            for item, text in items:
                v = WORDS.findall(text)
                n = min(13, len(v))
                windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in windows:
                        hit |= set(range(p, p + n))
                        found.add("" if item is None else str(item))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found)), i
            assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
