"""Web archives (WARC): written by the executors, found again through a two-level capture index.

Every page is a record, a gzip member of its own, of some archive file. Payloads that occur again are stored once: the
other records are revisits. Captures are keyed by reversed host, path and id (``com,example)/path 17``), sorted by range,
and written as blocks of compressed lines; each index file ends with a sparse directory, the first key of each block, and
the first keys of the files are the directory above those. A look-up finds its files and then its blocks by binary
search, reads and searches these blocks alone, and then reads the records' own ranges of the archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names
from chobo.llm._store import random_access, shared_dir, stage, stream

LEAST = 1000
"""Bytes from which a payload that occurs again is not stored again."""
ROLL = 256 << 20
"""Bytes after which a task begins another archive file."""
BLOCK, A_FILE, MOST_FILES = 1024, 8192, 4096
"""Captures of an index block; captures for which there is an index file, until there are MOST_FILES of them, which bounds
the upper directory."""
READ_RANGE, MOST_READS = 16 << 20, 1 << 15
"""Bytes of archives that a task reads; tasks at most, which read more each beyond that."""
ID = "urn:chobo:page:"


class Archive(NamedTuple):
    """folder: of archives and index; captures: key, file, offset, size, record_type, digest of every record; files: (first key, name) of each index file; reads: tasks that read all archives."""

    folder: str
    captures: DataFrame
    files: list[tuple[str, str]]
    reads: int


def surt(url: Column) -> Column:
    """The host's labels reversed, port, ``)``, path and query; no scheme, user, fragment or control characters."""
    u = F.replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", ""), F.lit(" "), F.lit("%20"))
    before = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    host = F.lower(F.regexp_extract(u, before + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(u, before + r"(?:[^/?#@]*@)?[^/?#:]*(:[0-9]*)", 1)
    path = F.regexp_replace(F.regexp_replace(u, before + "[^/?#]*", ""), r"(?s)#.*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def _id(key: Column) -> Column:
    return F.coalesce(F.url_encode(key.cast("string")), F.lit(""))


def one_page(url: Column, key: Column) -> list[Column]:
    """The range of keys (from, to) that asks for the captures of a URL with this id."""
    whole = F.concat(surt(url), F.lit(" "), _id(key))
    return [whole.alias("from"), F.concat(whole, F.lit("\0")).alias("to")]


def all_of_url(url: Column) -> list[Column]:
    """The range of keys that asks for all captures of a URL."""
    return [F.concat(surt(url), F.lit(" ")).alias("from"), F.concat(surt(url), F.lit("!")).alias("to")]


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(key: str, url: str, payload: bytes, digest: str, refers: str | None, refers_url: str | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to another record by id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{ID}{key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) or 'about:blank'}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers}>", f"WARC-Refers-To-Target-URI: {_line(refers_url or '') or 'about:blank'}", f"WARC-Refers-To-Date: {date}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(member: bytes) -> dict:
    """url, record_id, record_type, payload (None of a revisit), payload_bytes, payload_digest (hex), refers_to of a record.

    A record whose length or digest is not what it says is refused with an error.
    """
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = h["warc-type"]
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {h['warc-record-id']} is not as it was written")
    name = lambda x: unquote(x.strip("<>").removeprefix(ID)) if x else None
    return {"record_id": name(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": name(h.get("warc-refers-to"))}


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """pages (id, url, payload) with digest, target, target_url: which record has the payload; null where it is a response.

    Payloads are compared by their SHA-1 and length. Groups are made of ids alone and pre-aggregated; the one join is an
    outer one from the pages, whose side may be split where a payload is common.
    """
    s = pages.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    s = s.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    again = s.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("t")).filter("n > 1 and t is not null")
    s = s.join(again.select("digest", "size", "t"), ["digest", "size"], "left")
    later = F.col("t").isNotNull() & ~F.col("id").eqNullSafe(F.col("t.id"))
    return s.select(_id(F.col("id")).alias("id"), F.concat(surt(F.col("url")), F.lit(" "), _id(F.col("id"))).alias("key"), F.coalesce("url", F.lit("")).alias("url"), "payload", "digest", F.when(later, _id(F.col("t.id"))).alias("target"), F.when(later, F.coalesce("t.url", F.lit(""))).alias("target_url"))


CAPTURE = "key string, file string, offset bigint, size bigint, record_type string, digest string"


def _writer(folder: str, roll: int, date: str):
    def run(batches):
        batches = iter(batches)
        batch, at = next(batches, None), 0
        while batch is not None:
            name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
            with stream(f"{folder}/archive/{name}", "wb") as out:
                while batch is not None and offset < roll:
                    part = batch.slice(at, min(batch.num_rows - at, 256)).to_pydict()
                    done = []
                    for k, url, text, digest, to, to_url in zip(*(part[c] for c in ("id", "url", "payload", "digest", "target", "target_url")), strict=True):
                        raw = record(k, url, text.encode(), digest, to, to_url, date)
                        out.write(raw)
                        done.append((offset, len(raw), "response" if to is None else "revisit"))
                        offset += len(raw)
                        if offset >= roll:
                            break
                    n = len(done)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, n), pa.array([name] * n, pa.string()), *(pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))), batch.column("digest").slice(at, n)], names=["key", "file", "offset", "size", "record_type", "digest"])
                    at += n
                    while batch is not None and at >= batch.num_rows:
                        batch, at = next(batches, None), 0

    return run


def _indexer(folder: str, block: int):
    """Sorted captures to one index file: blocks of lines, their directory, where that is."""

    def run(batches):
        name, directory, lines, offset, out = f"{uuid.uuid4().hex}.index", [], [], 0, None

        def close_block():
            nonlocal lines, offset
            raw = zlib.compress("\n".join(lines).encode())
            out.write(raw)
            directory.append(f"{offset}\t{len(raw)}\t{lines[0].partition(chr(9))[0]}")
            offset, lines = offset + len(raw), []

        with stream(f"{folder}/index/{name}", "wb") as out:
            for batch in batches:
                for row in zip(*batch.to_pydict().values(), strict=True):
                    lines.append("\t".join(map(str, row)))
                    if len(lines) == block:
                        close_block()
            if lines:
                close_block()
            raw = zlib.compress("\n".join(directory).encode())
            out.write(raw + offset.to_bytes(8, "big") + len(raw).to_bytes(8, "big"))
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t", 2)[2]]), pa.array([name])], names=["first", "file"])

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL, block: int = BLOCK, a_file: int = A_FILE) -> Archive:
    """Archives of pages, a record a row, and their index, in the session's shared folder.

    The payload is payload_col in UTF-8, null as empty. Of records with equal payloads of at least ``least`` bytes, those of
    the largest id hold it as responses (repeated rows of that id each), all others are revisits that refer to it; rows
    without id refer as others do, and hold their payload if no equal one has an id. Shorter payloads are always held. Null
    and odd URLs are keys like others (a null one is empty); ids may be of any type that casts to text. Other columns are
    not written. An empty table gives no files. Archive files of attempts that failed are named nowhere and never read.
    """
    folder = shared_dir(pages.sparkSession)
    rows = pages.select(_names.col(id_col).alias("id"), _names.col(url_col).cast("string").alias("url"), _names.col(payload_col).cast("string").alias("payload"))
    captures = stage(_marked(rows, least).mapInArrow(_writer(folder, roll, date), CAPTURE), folder, "captures")
    n, held = captures.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    order = ["key", "file", "offset"]
    parts = captures.repartitionByRange(max(1, min(MOST_FILES, -(-n // a_file))), *order).sortWithinPartitions(*order)
    files = stage(parts.mapInArrow(_indexer(folder, block), "first string, file string"), folder, "files")
    return Archive(folder, captures, sorted((r.first, r.file) for r in files.collect()), max(1, min(MOST_READS, held // READ_RANGE)))


def _finder(folder: str, names: list[str]):
    """Rows (part, from, to), sorted, to the captures in their ranges."""

    def run(batches):
        part, f, firsts, blocks, at, lines = None, None, [], [], None, []
        try:
            for batch in batches:
                found = []
                for p, lo, hi in zip(*batch.to_pydict().values(), strict=True):
                    if p != part:
                        if f:
                            f.close()
                        part, f, at = p, random_access(f"{folder}/index/{names[p]}"), None
                        end = f.seek(0, 2)
                        f.seek(end - 16)
                        tail = f.read(16)
                        f.seek(int.from_bytes(tail[:8], "big"))
                        rows = [x.split("\t", 2) for x in zlib.decompress(f.read(int.from_bytes(tail[8:], "big"))).decode().split("\n")]
                        firsts, blocks = [x[2] for x in rows], [(int(x[0]), int(x[1])) for x in rows]
                    b = max(0, bisect_left(firsts, lo) - 1)
                    while b < len(firsts) and firsts[b] < hi:
                        if at != b:
                            f.seek(blocks[b][0])
                            lines = [x.split("\t") for x in zlib.decompress(f.read(blocks[b][1])).decode().split("\n")]
                            at = b
                        i = bisect_left(lines, lo, key=lambda x: x[0])
                        while i < len(lines) and lines[i][0] < hi:
                            found.append(lines[i])
                            i += 1
                        b += 1
                    if len(found) >= 4096:
                        yield _captures(found)
                        found = []
                if found:
                    yield _captures(found)
        finally:
            if f:
                f.close()

    return run


def _captures(rows: list[list[str]]) -> pa.RecordBatch:
    key, file, offset, size, kind, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(file), pa.array(map(int, offset), pa.int64()), pa.array(map(int, size), pa.int64()), pa.array(kind), pa.array(digest)], names=["key", "file", "offset", "size", "record_type", "digest"])


def look_up(ranges: DataFrame, archive: Archive) -> DataFrame:
    """The captures (key, file, offset, size, record_type, digest) within ranges of keys (from, to; see one_page and
    all_of_url), each once for every different range that holds it."""
    firsts = [x[0] for x in archive.files]

    def assign(batches):
        for batch in batches:
            lo, hi = batch.to_pydict().values()
            rows = [(p, a, b) for a, b in zip(lo, hi, strict=True) for p in range(max(0, bisect_left(firsts, a) - 1), bisect_left(firsts, b))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))], names=["part", "from", "to"])

    ranges = ranges.select("from", "to").filter("`from` is not null and `to` is not null").distinct()
    asked = ranges.mapInArrow(assign, "part int, from string, to string")
    return asked.repartition(max(1, len(archive.files)), "part").sortWithinPartitions("part", "from", "to").mapInArrow(_finder(archive.folder, [x[1] for x in archive.files]), CAPTURE)


def read_records(captures: DataFrame, archive: Archive, payloads: bool = True) -> DataFrame:
    """record_id, url, record_type, payload (of responses, if asked for), payload_bytes, payload_digest, refers_to of captures.

    Reads are dealt by ranges of the archives and sorted, so that each is read from its beginning to its end.
    """
    folder = archive.folder
    ddl = "record_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        name, f = None, None
        try:
            for batch in batches:
                rows, held = [], 0
                for file, offset, size in zip(*batch.to_pydict().values(), strict=True):
                    if file != name:
                        if f:
                            f.close()
                        name, f = file, random_access(f"{folder}/archive/{file}")
                    f.seek(offset)
                    r = parse(f.read(size))
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 2048 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(rows[0], types, strict=True)], names=list(rows[0]))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(rows[0], types, strict=True)], names=list(rows[0]))
        finally:
            if f:
                f.close()

    part = F.floor(F.col("offset") / READ_RANGE)
    return captures.select("file", "offset", "size").repartition(archive.reads, "file", part).sortWithinPartitions("file", "offset").mapInArrow(run, ddl)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload of what they refer to."""
    held = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.any_value("payload").alias("of"))
    out = records.join(held, ["refers_to", "payload_digest"], "left")
    return out.select(*[F.coalesce("payload", "of").alias(c) if c == "payload" else F.col(c) for c in records.columns])


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT page_id, payload, strlen(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS target FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to FROM m
"""
