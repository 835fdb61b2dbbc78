import random

import public_tokenizers
from tokenizers import Tokenizer

from chobo.llm.token_count import count_tokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "Zé", "don't", "we're", "'r", "e", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "12", "٣", "...", "<|endoftext|>", "<|", "endoftext|>", "日本語", "😀", "é", "\x00", "!!", "$$$"]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(n, length, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, length))) for _ in range(n)]


def test_stretches_add_up():
    texts = odd_texts(3000, 30)
    assert count_tokens(PATH, texts) == whole(texts)


def test_splicing_equals_whole_texts(spark):
    texts = odd_texts(60, 400, 2) + ["x" * 5000, "word " * 3000, " " * 3000, "", None, "ab" * 900 + " tail"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, texts[3], "k")], "doc_id long, text string, n_tokens string")
    got = token_counts(docs, PATH, chunk=128, overlap=64, limit=50).collect()
    assert len(got) == len(texts) + 1
    want = whole(texts)
    for r in got:
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (want[r.doc_id], want[r.doc_id] > 50, len((texts[r.doc_id] or "").encode()))


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
