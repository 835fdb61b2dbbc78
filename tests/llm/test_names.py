"""Columns with odd names and with the names of results pass through every operator."""

import public_tokenizers
import pytest

from chobo.llm import decontam, line_dedup, lm_score, mixing, near_dup, quality_classifier, quality_rules, sharding, suffix_dedup, token_count

ODD = ["a b.c", "__id", "row", "text.x", "id", "t", "n", "size", "key", "`q`"]
LABELS = "doc_id long, quality int"


@pytest.fixture(scope="module")
def docs(spark):
    text = "one line of many words here\nand a second one\nand a third one\nand a fourth one that ends it"
    rows = [(i, text if i % 2 else f"{text} {i}", f"s{i % 3}", *(f"v{i}-{k}" for k in range(len(ODD)))) for i in range(12)]
    rows += [(None, None, None, *[None] * len(ODD)), (3, "", None, *[None] * len(ODD))]
    quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {quoted}")


def same(docs, out):
    own = lambda df: sorted(map(repr, ([r[c] for c in ("doc_id", *ODD)] for r in df.collect())))
    assert own(out) == own(docs) and set(docs.columns) <= set(out.columns)


def test_operators_that_keep_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], LABELS)
    items = spark.createDataFrame([(1, "and a third one and a fourth")], "item_id long, text string")
    same(docs, line_dedup.dedup_lines(docs))
    same(docs, decontam.contamination(docs, items))
    same(docs, lm_score.score(docs, lm_score.train(docs)))
    same(docs, quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)))
    same(docs, quality_classifier.score(docs, quality_classifier.train(docs, labels)))
    same(docs, token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk=32, overlap=16))
    same(docs, sharding.shard_documents(docs, 200)[0])


def test_operators_that_choose_rows(docs):
    mix, account = mixing.mix_sources(docs)
    assert set(docs.columns) <= set(mix.columns) and mix.count() > 0 and account.count() == docs.count()
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["a b.c"]) for r in left.collect() if r.text) == [(0, "v0-0")]
    assert near_dup.near_duplicates(docs).count() == suffix_dedup.remove_repeats(docs).count() == docs.count()


@pytest.mark.parametrize("name", ["n_bytes", "n_tokens", "over_limit", "shard", "depth", "component_id", "n_shingles", "mix_time"])
def test_names_of_results(spark, name):
    docs = spark.createDataFrame([(i, "a b c d e f", "s", "mine") for i in range(3)], f"doc_id long, text string, source string, {name} string")
    assert token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).filter("n_bytes = 11 and n_tokens > 0 and not over_limit").count() == 3
    assert sharding.shard_documents(docs)[0].filter("n_bytes = 11 and shard = '' and depth = 0").count() == 3
    assert [r.component_id for r in near_dup.near_duplicates(docs).collect()] == [0, 0, 0]
    assert mixing.mix_sources(docs)[0].filter("cast(mix_time as double) > 0").count() > 0
