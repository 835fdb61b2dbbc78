"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chobo.llm.periodic_runs import periodic_runs, runs_of
from chobo.llm.queries import op11_periodic_runs


def plain(w, least=12):
    """start, end, period of every run: all lags, the least lag of a stretch is its period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(600))]
    if kind == 1:  # Fibonacci words: runs within runs
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(4, 13)):
            a, b = b, b + a
        return b[:700]
    if kind == 2:  # Thue-Morse words, which collide under a polynomial modulo a power of two
        a = [0]
        for _ in range(rng.randrange(4, 10)):
            a += [1 - x for x in a]
        return a
    if kind == 3:  # touching runs of the same period: many longer periods at the place where they meet
        a = [i % rng.randrange(1, 5) for i in range(rng.randrange(1, 250))]
        return a + a[: rng.randrange(1, len(a) + 1)] + a
    if kind == 4:
        return [x for _ in range(rng.randrange(1, 8)) for x in [rng.randrange(3) for _ in range(rng.randrange(1, 60))] * rng.randrange(1, 5)]
    if kind == 5:  # long periods
        base = [rng.randrange(1000) for _ in range(rng.randrange(30, 200))]
        return [7] * rng.randrange(5) + base * rng.randrange(2, 5) + base[: rng.randrange(len(base))]
    b = [0] * rng.randrange(10, 150) + [1]
    return b * rng.randrange(2, 5) + [0] * rng.randrange(200)


@pytest.mark.parametrize("seed", range(60))
def test_all_runs(seed):
    rng = random.Random(seed)
    docs = sorted((some_words(rng) for _ in range(rng.randrange(1, 4))), key=len, reverse=True)
    w, want = [], []
    for k, d in enumerate(docs):
        want += [(s + len(w), e + len(w), q) for s, e, q in plain(d)]
        w += [*d, -1 - k]
    got = runs_of(np.array(w, np.int64), np.array([len(d) for d in docs]))
    assert [tuple(r) for r in got.tolist()] == want


def test_rows(spark):
    """Nulls, empty and blank texts, repeated rows, columns of clashing names, all separators."""
    loop = "é b\tC " * 9 + "é"
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(None, None, "n"), (1, "", "e"), (2, " \n\t", "b"), (3, loop, "l"), (3, loop, "l"), (4, "a " * 11, "short"), (5, "a\x0b" * 12, "a"), (6, long, "long"), (7, "x y A a A a A a A a A a A a z", "case"), (8, "p\xa0q " * 12, "nbsp")]
    df = spark.createDataFrame(rows, "id long, text string, runs string").withColumn("row", df_lit("r")).withColumn("a`b.c", df_lit(1))
    out = periodic_runs(df)
    assert out.columns == ["id", "text", "row", "a`b.c", "n_words", "runs", "collapsed"]
    got = sorted(out.collect(), key=lambda r: (r.id or 0, r.text or ""))
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = plain(w) if len(w) < 1000 else [(0, 40_000, 997)]
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == want, r.id
        assert r.n_words == len(w) and r.collapsed == (None if r.text is None else collapse(w, want))
    assert got[0].collapsed is None and periodic_runs(df.filter("false")).collect() == []


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_query(spark, tmp_path):
    """The query on small documents, a tenth of which are made to repeat, against the contract in plain Python."""
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(4 if i % 3 else 900)) for _ in range(rng.randrange(0, 400)))) for i in range(150)] + [(None, "a " * 40), (1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    turned = 0
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            turned += 1
        runs = plain(w)
        r = got[key]
        best = max(runs, key=lambda x: (x[1] - x[0], -x[0], -x[2]), default=None)
        want = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert turned > 5
