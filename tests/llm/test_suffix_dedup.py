import hashlib
import random

import numpy as np
import pytest

from chobo.llm import suffix_dedup
from chobo.llm.suffix_dedup import remove_repeats


def brute(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_transform_and_common_prefixes(monkeypatch, tmp_path, block, letters):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(3)
    strings = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))).encode() for _ in range(60)] + [b"aaaa", b"aaaa"]
    strings.sort(key=len, reverse=True)
    size = np.array([len(s) for s in strings])
    path = suffix_dedup.suffix_transform(np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum(size)], str(tmp_path))
    records = np.fromfile(path, np.uint16)
    got = [None] * len(records)
    for n, places in suffix_dedup.read_back(path, size):
        for s, p in zip(strings, places.tolist()):
            got[p] = s[len(s) - n :] if n else b""
    assert None not in got and got == sorted(got) and len(got) == sum(map(len, strings)) + len(strings)
    assert [f.name for f in tmp_path.iterdir()] == [path.rsplit("/", 1)[1]]
    for a, b, c in zip(got, got[1:], (records >> 8).tolist()[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert c == n


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "béta", "gamma", "δ", "of", "the", "and", "zeta", "eta", "日本"]
    para = [" ".join(r.choice(words) for _ in range(r.randint(8, 30))) for _ in range(12)]
    docs = [" ".join(r.choice(para) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(20)) for _ in range(r.randint(0, 5))) for _ in range(40)]
    return docs + [docs[3], docs[3], "", None, "a" * 400, "b" + "a" * 300, "x" * 49, "x" * 50, "x" * 50, " ".join(para) * 40, "y" + " ".join(para) * 40, "é" * 5000]


def test_against_brute_force(spark):
    for seed, hot in ((1, 50_000), (2, 2)):
        docs = [(i * 3 % 101, t) for i, t in enumerate(texts(seed))]
        docs += [(docs[5][0], docs[5][1]), (docs[5][0], docs[6][1])]
        df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(3)
        got = {}
        for r in remove_repeats(df, hot=hot).collect():
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
            got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert {i: sorted(v) for i, v in got.items()} == brute(docs, 50)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "y" * 60), (None, "y" * 60), (4, "y" * 60)], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(df).collect()) == [0, 0, 0]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_strings_alone_with_their_minimizer_need_no_suffix_order(monkeypatch, tmp_path):
    ordered = []
    plain = suffix_dedup._least_ids
    monkeypatch.setattr(suffix_dedup, "_least_ids", lambda data, size, *more: ordered.append(len(size)) or plain(data, size, *more))
    strings = [b"abcdefgh", b"xabcdy", b"zabcd", b"qrstuvw", b"hijkl", b"mnop", b"mnopq"]
    key = np.array([1, 3, 3, 5, 6, 8, 9], np.uint64)
    size, doc = np.array([len(s) for s in strings]), np.array([7, 5, 2, 1, 4, 9, 8])
    got = suffix_dedup._least_of_strings(key, np.frombuffer(b"".join(strings), np.uint8), size, doc, 4, str(tmp_path))
    # of one window is "mnop", ordered all the same; windows of other keys are no matter of those alone
    assert got.tolist() == [7] * 5 + [5, 2, 5] + [2, 2] + [1] * 4 + [4] * 2 + [9] + [8] * 2 and ordered == [3]
    none = np.empty(0, np.int64)
    assert not len(suffix_dedup._least_of_strings(key[:0], np.empty(0, np.uint8), none, none, 4, str(tmp_path)))
