"""Each operator against a plain version on small tables with nulls, ties, repeated rows, long texts and clashing names."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chobo.llm import decontam, line_dedup, lm_score, mixing, near_dup, quality_classifier, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, kept string"


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = ["the", "of", "and", *("".join(r.choice("abcdeéß日") for _ in range(r.randint(2, 7))) for _ in range(300))]
    line = lambda: " ".join(r.choice(vocabulary[:3] if r.random() < 0.3 else vocabulary) for _ in range(r.randint(3, 12)))
    base = ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(40)]
    out = list(base)
    for b in base[:15]:
        w = b.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 12))):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            out.append(" ".join(v))
    out += [base[0].upper(), base[1], base[1], "", None, " \n\t", "one two", "one  TWO", "x" * 200_000, "a " * 30_000, base[2] + "\n" + base[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7 % 1009, t, f"s{i % 5}" if i % 11 else None, "k") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(3)


def shingle_set(t, n=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates(docs):
    rows, df = docs
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.doc_id, r.n_shingles, r.component_id, r.kept) == (r.doc_id, len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_line_dedup(docs):
    rows, df = docs
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if t is not None and WORD.search("".join(w)):
                first.setdefault(w, (i, p))
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            if first.get(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    out = line_dedup.dedup_lines(df.withColumn("n_spans", F.lit("clash")))
    got = out.collect()
    assert len(got) == len(rows) + 2 and "kept" in out.columns
    for r in got:
        assert (r.text, r.n_removed) == want[r.doc_id]


def test_mixing(docs):
    rows, df = docs
    runs = [sorted(map(tuple, mixing.mix_sources(df)[1].collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows) + 2
    mix, account = mixing.mix_sources(df)
    total, sizes, targets, taken = 0, collections.Counter(), {}, collections.Counter()
    source = {i: s for i, _, s, _ in rows}
    for r in account.collect():
        s = source[r.doc_id]
        total += r["size"]
        sizes[s] += r["size"]
        targets[s] = r.target
        taken[s] += r.taken
        assert r.taken <= 2 * r["size"]
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in targets)
    assert sum(taken.values()) <= 1.5 * total
    assert mix.count() == account.agg(F.sum("mix_times")).first()[0]
    times = [r.mix_time for r in mix.collect()]
    assert times == sorted(times)


def test_decontamination(spark, docs, texts):
    rows, df = docs
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [(1, " ".join(texts[2].split()[3:30])), (2, texts[9]), (10, "one two"), (11, ""), (12, None), (13, "nowhere to be found at all")]
    got = {r.doc_id: r for r in decontam.contamination(df.withColumn("n_hit", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_proximity(spark, docs, texts, tmp_path):
    rows, df = docs
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    turned = words(texts[2])[5:25][::-1]
    items = [(1, " ".join(turned)), (2, texts[9]), (3, "one two"), (4, "nowhere at all"), (5, "a"), (None, texts[2][:60])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    n = collections.Counter(w for i, t, *_ in [*rows, rows[3], rows[3]] for w in words(t))
    for item, text in items:
        own = words(text)
        terms = list(dict.fromkeys(w for _, _, w in sorted((n[w], k, w) for k, w in enumerate(own))))[:3]
        for i, t, *_ in rows:
            at = [(p, w) for p, w in enumerate(words(t)) if w in terms]
            want[i] += bool(terms) and any({w for q, w in at if p <= q < p + len(own) * 3 // 2} == set(terms) for p, _ in at)
    for most in (1 << 20, 3):  # terms sent to all tasks, or joined
        got = {r.doc_id: r for r in decontam.contamination(df, frame, most_terms=most).collect()}
        assert {i: got[i].n_near for i, *_ in rows} == {i: want[i] for i, *_ in rows}
    assert sum(want.values()) > 5


def test_sharding(docs):
    rows, df = docs
    limit = 1500
    out, directory = sharding.shard_documents(df, limit)
    got = out.collect()
    assert len(got) == len(rows) + 2
    held, n = collections.Counter(), collections.Counter()
    for r in got:
        held[r.shard] += len((r.text or "").encode())
        n[r.shard] += 1
    for r in got:
        assert r.shard_bytes == held[r.shard] and r.shard_docs == n[r.shard] and (held[r.shard] <= limit or n[r.shard] == 1) and r.over_limit == (held[r.shard] > limit)
    shards = [r.shard for r in directory.collect()]
    assert sorted(shards) == sorted(held) and not any(a != b and b.startswith(a) for a in shards for b in shards)
    for s in shards:  # only what was too large has been split
        if s:
            assert sum(v for k, v in held.items() if k.startswith(s[:-1])) > limit


def kneser_ney(train, text):
    """Interpolated modified Kneser-Ney of order two, from plain counts."""
    seqs = [["<s>", *WORD.findall(lower(t)), "</s>"] for t in train]
    pairs = collections.Counter(p for s in seqs for p in zip(s, s[1:]))
    words = {w for s in seqs for w in s[1:]}
    discounts = lambda c: lm_score._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    d = lambda k, ds: 0 if k == 0 else ds[min(k, 3) - 1]
    before = collections.Counter(w for _, w in pairs)
    d2, d1 = discounts(pairs), discounts(before)
    total = collections.Counter()
    for (u, _), c in pairs.items():
        total[u] += c
    left1 = sum(d(c, d1) for c in before.values()) / len(pairs)
    score, s = 0.0, ["<s>", *WORD.findall(lower(text)), "</s>"]
    for u, w in zip(s, s[1:]):
        low = max(before[w] - d(before[w], d1), 0) / len(pairs) + left1 / (len(words) + 1)
        if total[u]:
            own = [c for (x, _), c in pairs.items() if x == u]
            p = (pairs[u, w] - d(pairs[u, w], d2)) / total[u] + sum(d(c, d2) for c in own) / total[u] * low
        else:
            p = low
        score += math.log10(p)
    return score


def test_lm_score(spark, docs):
    rows, df = docs
    rows = [r for r in rows if len(r[1] or "") < 5000]
    df = df.filter(F.coalesce(F.length("text"), F.lit(0)) < 5000).dropDuplicates(["doc_id"])
    train = df.filter("doc_id % 3 != 0")
    model = lm_score.train(train)
    counts = collections.Counter(w for i, t, *_ in rows if i % 3 for w in [*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.score(df.withColumn("score", F.lit("clash")), model).collect()}
    assert len(got) == len(rows)
    kept = [t for i, t, *_ in rows if i % 3]
    for i, t, *_ in rows:
        own = [*WORD.findall(lower(t)), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert abs(r.score - kneser_ney(kept, t)) < 1e-6 * max(1, abs(r.score))


def test_quality(spark, docs):
    rows, df = docs
    junk = [(5000 + i, " ".join(w.upper() + "!!" for w in (t or "a b c").split()[:60]), "s", "k") for i, (_, t, *_) in enumerate(rows[:30])]
    both = df.unionByName(spark.createDataFrame(junk, SCHEMA))
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:40]] + [(r[0], 0) for r in junk[:20]] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality_classifier.train(both, labels)
    got = {r.doc_id: r for r in quality_classifier.score(both, model).collect()}
    assert all(got[r[0]].predicted == 0 for r in junk[20:]) and sum(got[r[0]].predicted for r in rows[40:85]) >= 43
    assert all(0 <= r.score <= 1 for r in got.values())
    ratios = quality_rules.fit(both, labels.filter("quality = 1"))
    ruled = {r.doc_id: r for r in quality_rules.apply_rules(both, ratios).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cov = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = ruled[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 20 or 100 * len(cov) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_duplicates(none).collect() == [] and line_dedup.dedup_lines(none).collect() == []
    assert [x.collect() for x in mixing.mix_sources(none)] == [[], []] and decontam.contamination(none, items).collect() == []
    assert [x.collect() for x in sharding.shard_documents(none)] == [[], []]
    assert quality_classifier.score(none, quality_classifier.train(none, labels)).collect() == []
    assert quality_rules.apply_rules(none, quality_rules.fit(none, labels)).collect() == []
    assert lm_score.score(none, lm_score.train(none)).collect() == []
