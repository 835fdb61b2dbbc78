"""Token counts of whole texts, with huge texts cut into overlapping chunks that are spliced exactly.

The tokenizer (byte-level BPE) first cuts a text into pieces with a pattern that runs from left to right and keeps no
state, then encodes each piece on its own. That has two uses here. A text of usual size is cut where any such piece
must end, before white space, and each distinct stretch is encoded once in a worker. A huge text becomes chunks on all
tasks; two neighbours are spliced at a position where both begin a piece: from there on the right one is as the
whole text is. Where an overlap has no such position, it is widened and the text encoded again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._store import shared_dir, stage

CHUNK, OVERLAP, LIMIT = 65_536, 512, 512
CACHE = 400_000
"""Distinct stretches of text that a worker remembers; then it begins anew."""
SAFE = 32
"""A piece's end this far before a chunk's end cannot depend on what follows the chunk."""
_WHITE = "\t-\r" + "".join(map(chr, [0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_STRETCH = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_loaded: dict = {}


def _tokenizer(path: str):
    """The library's tokenizer for a file, loaded once in a worker. It does no threading of its own in a task."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = (t, {})
    return _loaded[path]


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text, from the counts of its stretches."""
    tokenizer, known = _tokenizer(path)
    cut = [_STRETCH.findall(t) for t in texts]
    new = list({s for c in cut for s in c if s not in known})
    if len(known) + len(new) > CACHE:
        known.clear()
        new = list({s for c in cut for s in c})
    for i in range(0, len(new), 20_000):
        some = new[i : i + 20_000]
        known.update(zip(some, [len(e.ids) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)], strict=True))
    get = known.__getitem__
    return [sum(map(get, c)) for c in cut]


def _ends(path: str, text: str, start: int, overlap: int) -> tuple:
    """Of a chunk: tokens, and (position, tokens before it) of the pieces that begin in its first and last ``overlap``."""
    e = _tokenizer(path)[0].encode(text, add_special_tokens=False)
    words = [-1 if w is None else w for w in e.word_ids]
    at, n, last = [], [], None
    for i, (w, (a, _), special) in enumerate(zip(words, e.offsets, [w is None for w in e.word_ids], strict=True)):
        if special or w != last:
            at.append(start + a)
            n.append(i)
        last = None if special else w
    at, n = np.array(at, np.int64), np.array(n, np.int64)
    head, tail = at < start + overlap, (at >= start + len(text) - overlap) & (at <= start + len(text) - SAFE)
    return len(e.ids), at[head].tolist(), n[head].tolist(), at[tail].tolist(), n[tail].tolist()


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """__row, n_tokens (null where two chunks have no common position) of huge (__row, text)."""
    size = chunk + overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(chunk))
    chunks = huge.select("__row", "text", F.explode(starts).alias("start")).select("__row", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text")).repartition("__row", "start")

    def run(batches):
        for batch in _text.pieces(batches, "text"):
            found = [_ends(path, t, s, overlap) for t, s in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(1, 5))], names=["__row", "start", "n", "ha", "hn", "ta", "tn"])

    def splice(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        total, begin = 0, 0
        for a, b in zip(rows, rows[1:], strict=False):
            left, right = dict(zip(a["ta"], a["tn"], strict=True)), dict(zip(b["ha"], b["hn"], strict=True))
            common = left.keys() & right.keys()
            if not common:
                return pa.table({"__row": [a["__row"]], "n_tokens": pa.array([None], pa.int64())})
            p = min(common)
            total += left[p] - begin
            begin = right[p]
        return pa.table({"__row": [rows[0]["__row"]], "n_tokens": [total + rows[-1]["n"] - begin]})

    parts = chunks.mapInArrow(run, "__row long, start int, n long, ha array<long>, hn array<long>, ta array<long>, tn array<long>")
    return parts.groupBy("__row").applyInArrow(splice, "__row long, n_tokens long")


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: a ``tokenizers`` file of a byte-level BPE, at the same place on every machine. Counts are those of the library
    for the whole text without begin, end or added special tokens; a special string inside a text counts as its
    default is, one token. Null and empty texts have 0. Rows are counted each on their own, repeated ones too. Texts
    of more than chunk + overlap characters are spliced. Columns may have any names; those named as the results are
    replaced.
    """
    text = _names.col(text_col)
    docs, names = _names.packed(docs, ["n_bytes", "n_tokens", "over_limit"], n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), text=text)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap

    def run(batches):
        for batch in _text.pieces(batches, "text", 1 << 20):
            n = count_tokens(path, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    usual = docs.filter(~long).mapInArrow(run, _names.with_fields(docs, ["row", "n_bytes"], "n_tokens long"))
    folder = shared_dir(docs.sparkSession)
    huge = stage(docs.filter(long).withColumn("__row", F.monotonically_increasing_id()), folder, "huge")
    left, done, wide, k = huge.select("__row", "text"), None, overlap, 0
    while True:
        found = stage(_spliced(left, path, max(chunk, 2 * wide), wide), folder, f"spliced-{k}")
        good = found.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("n_tokens is null").select("__row")
        if failed.isEmpty():
            break
        left, wide, k = left.join(failed, "__row", "left_semi"), wide * 8, k + 1
    out = usual.unionByName(huge.join(done, "__row").select("row", "n_bytes", "n_tokens"))
    return _names.unpacked(out, names, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
