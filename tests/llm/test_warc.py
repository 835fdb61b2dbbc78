"""Archives and their index against the rows they were made from."""

import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chobo.llm import warc

BIG, ODD = "<p>é</p>" * 300, "x" * 999 + "é"


def rows():
    rng = random.Random(4)
    out = [(i, f"https://User@WWW.h{i % 7}.Example.com:8080/p/{i % 40}?q={i}#f", "".join(rng.choice("abé<> \n") for _ in range(rng.randrange(0, 3000)))) for i in range(300)]
    out += [(1000 + i, "http://hot.example/", BIG) for i in range(200)] + [(5, "http://a.b/", ODD), (6, "http://a.b/", ODD), (7, "http://a.b/", "x" * 999), (8, "http://a.b/", "x" * 999)]
    return out + [(9, None, None), (10, "", ""), (None, "no scheme\tat all\r\n#x", BIG), (1199, "http://hot.example/", BIG), (None, "http://lone/", "y" * 2000), (11, "http://x/ü a", "long" * 400_000)]


def want(data):
    best = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(i, best.get(h, i))
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        to = best.get(h) if best.get(h) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumns({"key": F.lit(1), "payload": F.lit(2), "t": F.lit(3)}).repartition(3)
    return df, warc.write(df, roll=60_000, block=7, a_file=90)


def records(r):
    return (int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None)


def test_every_page_is_found_once(archive):
    df, a = archive
    assert len(a.files) > 4
    found = warc.look_up(df.select(*warc.one_page(F.col("url"), F.col("page_id"))), a)
    got = warc.read_records(found, a).collect()
    assert sorted(map(records, got), key=str) == want(rows())
    texts = {(i, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows()}
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or r.payload == texts[(int(r.record_id) if r.record_id else None, r.payload_digest)]
    full = warc.resolve(warc.read_records(a.captures, a)).collect()
    assert sorted(hashlib.sha1(r.payload).hexdigest() for r in full) == sorted(x[2] for x in want(rows()))


def test_captures_of_a_url(spark, archive):
    _, a = archive
    urls = spark.createDataFrame([("http://hot.example",), ("HTTP://h3.example.com:8080/p/3?q=3",), ("//www.H3.example.com:8080/p/3?q=3",), ("http://absent.example/",), (None,)], "u string")
    got = warc.look_up(urls.select(*warc.all_of_url(F.col("u"))), a).groupBy("key").count().collect()
    keys = {r.key: r["count"] for r in got}
    assert sum(v for k, v in keys.items() if k.startswith("example,hot)/ ")) == 201 and keys["example,hot)/ 1199"] == 2
    assert keys["com,example,h3,www:8080)/p/3?q=3 3"] == 1 and not any(k.startswith("com,example,h3:") for k in keys)
    assert keys[")/ 9"] == 1 and keys[")/ 10"] == 1
    host = spark.createDataFrame([("com,example,h3,", "com,example,h3-")], "`from` string, `to` string")
    assert warc.look_up(host, a).count() == 43


def test_archives_are_plain_gzip(archive):
    _, a = archive
    folder = a.folder.removeprefix("file://")
    named = {r.file for r in a.captures.select("file").distinct().collect()}
    members = b"".join(gzip.open(f"{folder}/archive/{f}").read() for f in named)
    assert members.count(b"WARC/1.1\r\n") == len(rows()) and len(named) > 3
    assert {n for _, n in a.files} <= {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/index/*")}


def test_damage_is_noticed():
    raw = warc.record("1", "http://a/", b"abc", hashlib.sha1(b"abc").hexdigest(), None, None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(raw).replace(b"abc", b"abd")))
    odd = warc.parse(warc.record("a%20b", "http://a/\r\nX: y", b"", hashlib.sha1(b"").hexdigest(), None, None, "1970-01-01T00:00:00Z"))
    assert odd["record_id"] == "a b" and odd["url"] == "http://a/%0D%0AX:%20y"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    a = warc.write(empty)
    assert a.files == [] and warc.read_records(warc.look_up(empty.select(*warc.one_page(F.col("url"), F.col("page_id"))), a), a).collect() == []
