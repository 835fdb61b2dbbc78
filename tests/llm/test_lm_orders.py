"""The language model of order 3 against a plain version, on texts with nulls, copies, unknown words and hot words."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chobo.llm import lm_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kneser_ney(texts, order):
    """A function that scores a text by interpolated modified Kneser-Ney, with order - 1 starts before each text."""
    pad = lambda t: ["<s>"] * (order - 1) + WORD.findall((t or "").lower()) + ["</s>"]
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        s = pad(t)
        for i in range(order - 1, len(s)):
            grams[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        grams[n] = collections.Counter(g[1:] for g in grams[n + 1])
    cut = [lm_score._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in grams]
    d = lambda n, c: cut[n][min(c, 3) - 1] if c else 0
    of = [collections.defaultdict(list) for _ in grams]
    for n in range(1, order + 1):
        for g, c in grams[n].items():
            of[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(grams[1]) + 1)
        own, c = of[n][gram[:-1]], grams[n][gram]
        if not own:
            return p(gram[1:])
        return (c - d(n, c)) / sum(own) + sum(d(n, x) for x in own) / sum(own) * p(gram[1:])

    def total(t):
        s = pad(t)
        return sum(math.log10(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))

    return total


@pytest.mark.parametrize("order", [2, 3])
def test_orders(spark, order):
    r = random.Random(5)
    words = ["the", "of", *(f"w{i}" for i in range(60))]
    line = lambda k: " ".join(r.choice(words[:2] if r.random() < 0.4 else words) for _ in range(k))
    seen = [line(r.randint(1, 60)) for _ in range(60)]
    seen += [seen[0], seen[0], None, "", "THE of the", "the of " * 400, "rare", line(3000)]
    other = [line(40), "unknown the of", "the unknown of the of", "of of unknown", "w1 unknown", None, "the of the of"]
    rows = [(i, t, i < len(seen)) for i, t in enumerate([*seen, *other])]
    df = spark.createDataFrame(rows, "doc_id long, text string, seen boolean").repartition(3)
    plain = kneser_ney(seen, order)
    got = {x.doc_id: x.score for x in lm_score.score(df, lm_score.train(df.filter("seen"), order=order)).collect()}
    for i, t, _ in rows:
        assert abs(got[i] - plain(t)) < 1e-6 * max(1, abs(got[i])), (i, t)


def test_runs_of_parts(spark, monkeypatch):
    """Keys that cannot hold the bigrams of all parts count from the first of a few parts, and scores are the same."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {x.doc_id: x.score for x in lm_score.score(df, lm_score.train(df, order=3)).collect()}
    made = []
    own = lm_score._key_runs
    monkeypatch.setattr(lm_score, "KEYS", 20_000)
    monkeypatch.setattr(lm_score, "_key_runs", lambda *a: made.append(own(*a)) or made[-1])
    parted = {x.doc_id: x.score for x in lm_score.score(df, lm_score.train(df, order=3)).collect()}
    assert len(made[0]) > 2 and parted == whole
    plain = kneser_ney([t for _, t in rows], 3)
    assert all(abs(parted[i] - plain(t)) < 1e-6 * abs(parted[i]) for i, t in rows)
    with pytest.raises(ValueError):
        own([0, 5000, 5001], 60)


def test_counts_above_32_bits():
    from chobo.llm._keys import blobs, merged

    keys, counts = np.array([3, 9, 12], np.uint64), np.array([1, (1 << 33) + 5, 7])
    batches = [blobs(keys, counts, np.zeros(3, np.int64)), blobs(keys[:2], counts[[0, 2]], np.zeros(2, np.int64))]
    assert [x.tolist() for x in merged(pa.Table.from_batches(batches))] == [[3, 9, 12], [2, (1 << 33) + 12, 7]]


def test_order_3_sees_two_words_back(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "x b d"), (2, "a b c"), (3, "x b d")], "doc_id long, text string")
    both = spark.createDataFrame([(0, "a b c"), (1, "a b d")], "doc_id long, text string")
    two, three = ({x.doc_id: x.score for x in lm_score.score(both, lm_score.train(df, order=n)).collect()} for n in (2, 3))
    assert abs(two[0] - two[1]) < 1e-9 and three[0] > three[1] + 0.01


def test_order_3_of_nothing(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm_score.score(df, lm_score.train(df.filter("doc_id > 5"), order=3)).collect()}
    assert got == {0: 0.0, 1: 0.0}
    with pytest.raises(ValueError):
        lm_score.train(df, order=4)
