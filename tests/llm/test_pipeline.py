"""Each stage of the pipeline, and all of them, against plain Python; the classifier's updates and the rules' ratio too."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chobo.llm import _text, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[a-z0-9]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `odd name.x` string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    good = [line(r.randint(30, 60)) for _ in range(60)]
    bad = [" ".join("!!" + w.upper() + "$" for w in line(30).split()) for _ in range(30)]
    near = [t + " tail" for t in good[:8]] + [good[3], good[3]]
    items = [line(20) for _ in range(4)]
    dirty = [line(10) + " " + items[k % 4] + " " + line(10) for k in range(6)]
    texts = good + bad + near + dirty + ["", None, good[5] + " " + line(3000)]
    rows = [(i, t, "x", [None, "a", "b", "c"][i % 4], len(t or ""), "mine", f"o{i}") for i, t in enumerate(texts)]
    rows += [(None, good[9], "x", "a", 1, None, None), (None, None, None, None, None, None, None), rows[7], (7, line(40), "x", "b", 1, "other", "text")]
    labels = [(i, int(i < 60)) for i in range(90)] + [(None, 1), (3, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_near_duplicates(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    ids = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    groups = collections.defaultdict(list)
    for i in ids:
        groups[root[i]].append(i)
    return groups, [i for i in range(len(rows)) if i not in set(ids)]


def plain_contaminated(text, items):
    w, hit = ALNUM.findall((text or "").lower()), set()
    for it in items:
        v = ALNUM.findall(it)
        windows = {tuple(v[k : k + 13]) for k in range(len(v) - 12)}
        for p in range(len(w) - 12):
            if tuple(w[p : p + 13]) in windows:
                hit |= set(range(p, p + 13))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_quality_stage(spark, world):
    folder, rows, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["quality classifier"](spark, docs, folder)
    assert out.columns == docs.columns
    kept = collections.Counter(rows_of(out))
    assert not kept - collections.Counter(rows_of(docs))
    ids = {r.doc_id for r in out.collect()}
    assert set(range(60)) <= ids and not ids & set(range(60, 90))


def test_near_duplicate_stage(spark, world):
    folder, rows, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["MinHash near-dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    left = collections.Counter(rows_of(out))
    groups, alone = plain_near_duplicates(rows)
    assert sum(left.values()) == len(groups) + len(alone)
    assert all(left[repr(rows[i])] for i in alone)
    for members in groups.values():  # one row of the least id, and with its text
        least = min(rows[i][0] for i in members)
        assert sum(left[x] for x in {repr(rows[i]) for i in members}) == 1
        assert any(left[repr(rows[i])] for i in members if rows[i][0] == least)


def test_decontamination_stage(spark, world):
    folder, rows, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["benchmark decontamination"](spark, docs, folder)
    assert rows_of(out) == sorted(repr(r) for r in rows if not plain_contaminated(r[1], items))
    assert out.count() == len(rows) - 6


def test_mixing_and_sharding_stages(spark, world):
    folder, rows, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mix = STAGES["mixing sources to target weights"](spark, docs, folder)
    assert mix.columns == docs.columns
    taken, have = collections.Counter(rows_of(mix)), collections.Counter(map(repr, rows))
    size = lambda r: len(WORD.findall(r[1] or ""))
    total = sum(map(size, rows))
    assert all(taken[k] <= 2 * have[k] for k in taken) and not set(taken) - set(have)
    words = sum(size(tuple(r)) for r in mix.collect())
    assert 1.5 * total - max(map(size, rows)) <= words <= 1.5 * total
    out = STAGES["sharding"](spark, docs, folder)
    assert rows_of(out.select(*[f"`{c}`" for c in docs.columns])) == sorted(map(repr, rows))
    assert out.agg(F.sum("n_bytes")).first()[0] == sum(len((r[1] or "").encode()) for r in rows)


def test_run_is_its_stages(spark, world):
    folder, rows, items = world
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert out.columns == [*docs.columns, "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "over_limit"]
    kept = [r for r in STAGES["quality classifier"](spark, docs, folder).collect()]
    groups, alone = plain_near_duplicates([tuple(r) for r in kept])
    clean = [kept[i] for i in alone] + [kept[min(m, key=lambda i: kept[i][0])] for m in groups.values()]
    most = {r["odd name.x"] for r in clean if not plain_contaminated(r[1], items)}
    got = [r["odd name.x"] for r in out.collect() if r.doc_id is not None]
    # of ids with two texts the stage may keep either
    assert set(got) - {"text", "o7"} <= most and max(collections.Counter(got).values()) <= 2
    size = {r["odd name.x"]: len(WORD.findall(r[1] or "")) for r in clean}
    assert sum(size.get(x, 0) for x in got) <= 1.5 * sum(size.values()) + 100


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def features(text, bits):
    """Counts of a text's hashed word 1- and 2-grams."""
    _, bucket, count = _text.features(*_text.utf8(pa.array([text], pa.string())), bits)
    return dict(zip(bucket.tolist(), count.tolist(), strict=True))


def test_classifier_against_plain_updates(spark, world):
    """Follow the regularised leader, feature by feature, over the rows in the order of their hashed ids."""
    folder, rows, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("doc_id % 4 != 2")
    bits, alpha, beta, l1, epochs = 12, 2.0, 1.0, 0.0005, 3
    model = quality_classifier.train(docs, labels, bits=bits)
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    data = docs.join(known, "doc_id").select(F.xxhash64("doc_id", F.lit(12)).alias("o"), "y", "text").orderBy("o", "y").collect()
    z, n = collections.Counter(), collections.Counter()
    weight = lambda j: 0.0 if abs(z[j]) <= l1 else (math.copysign(l1, z[j]) - z[j]) / ((beta + math.sqrt(n[j])) / alpha)
    for _ in range(epochs):
        for r in data:
            counts = features(r.text, bits)
            x = {j: math.sqrt(c / sum(counts.values())) for j, c in counts.items()} | {"bias": 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - r.y) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * w[j]
                n[j] += g * g
    assert abs(model.bias - weight("bias")) < 1e-4
    assert max(abs(model.weights[j] - weight(j)) for j in range(1 << bits)) < 1e-4
    for r in quality_classifier.score(docs, model).collect():
        counts = features(r.text, bits)
        s = weight("bias") + sum(weight(j) * math.sqrt(c / sum(counts.values())) for j, c in counts.items())
        assert abs(r.score - 1 / (1 + math.exp(-s))) < 1e-4 and r.predicted == (r.score >= 0.7)


def test_rules_ratio_and_verdict(spark, world):
    folder, rows, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    trusted = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    raw, good = collections.Counter(), collections.Counter()
    for r in rows:
        counts = features(r[1], quality_rules.BITS)
        raw.update(counts)
        if r[0] is not None and r[0] < 60:
            good.update(counts)
    n_raw, n_good, t, size = sum(raw.values()), sum(good.values()), quality_rules.TRUST, 1 << quality_rules.BITS
    score = lambda j: math.log((1 - t) * (good[j] / n_good) / ((raw[j] + 1) / (n_raw + size)) + t)
    got = quality_rules.apply_rules(docs, quality_rules.fit(docs, trusted)).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = features(r.text, quality_rules.BITS)
        ratio = sum(c * score(j) for j, c in counts.items()) / max(1, sum(counts.values()))
        assert abs(r.ratio - ratio) < 1e-9 and r.kept == (not r.base_failed and ratio >= quality_rules.THRESHOLD)
    assert 0 < sum(r.kept for r in got) < len(rows)


def test_features_count_what_they_should():
    got = features("One two, two two one", 30)
    assert sum(got.values()) == 6 + 5
