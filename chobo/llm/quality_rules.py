"""Quality rules: counted surface rules, and a log-likelihood ratio of trusted text to the raw corpus.

Hashed word n-grams give two multinomials over 2**BITS buckets, one of trusted texts and one of all. A document's ratio,
divided by its number of n-grams, is held against one threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text

BITS = 16
"""Measured on labelled texts: with 18 and 20 bits, texts that are not themselves counted as trusted fall 0.1 and 0.4
behind those that are; with 16, less than 0.1."""
TRUST = 0.05
"""Share of the raw corpus's distribution that is mixed into the trusted one: an n-gram without trust scores log(TRUST)."""
ALIEN = 0.2
"""Share of such n-grams that a kept text may have, all others being as common in trusted as in raw text."""
THRESHOLD = ALIEN * float(np.log(TRUST))
LEAST_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 20, 8, 30
BROADCAST_IDS = 2_000_000
"""Trusted ids that are sent to all tasks at most; more are joined by a shuffle of the texts."""
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass
class Ratios:
    log_ratio: np.ndarray
    bits: int = BITS


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, trust: float = TRUST) -> Ratios:
    """Count the n-grams of all texts and of those whose id is in ``trusted`` (a column named as id_col).

    A task adds up its own counts: at most 2**bits rows leave it, and the sums that reach the driver are that many.
    Without trusted text every ratio is 0. Trusted ids are broadcast while they are few enough.
    """
    ids = trusted.select(_names.col(id_col).cast("long").alias("__id")).filter("__id is not null").distinct().withColumn("__t", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(_names.col(id_col).cast("long").alias("__id"), _names.col(text_col).alias("text")).join(ids, "__id", "left").select(F.coalesce("__t", F.lit(False)).alias("t"), "text")

    def run(batches):
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in _text.pieces(batches, "text"):
            row, bucket, count = _text.features(*_text.utf8(batch.column(1)), bits)
            t = batch.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.empty(0, bool)
            raw += np.bincount(bucket, weights=count, minlength=1 << bits).astype(np.int64)
            good += np.bincount(bucket[t], weights=count[t], minlength=1 << bits).astype(np.int64)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    sums = rows.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[sums.column("bucket").to_numpy()], good[sums.column("bucket").to_numpy()] = sums.column("raw").to_numpy(), sums.column("good").to_numpy()
    if not good.sum():
        return Ratios(np.zeros(1 << bits), bits)
    p = (raw + 1) / (raw.sum() + len(raw))
    return Ratios(np.log((1 - trust) * good / good.sum() / p + trust), bits)


def _surface(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, h, first = _text.words(data, offsets, lower=False)
    row = _text.rows_of(first)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    out = {"n_words": np.diff(first), "word_chars": np.bincount(row, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    line_kind = np.ones(256, np.uint8)
    line_kind[10] = 0
    s, e, lines, at = _text.words(data, offsets, lower=False, kinds=line_kind)
    some = np.r_[0, np.cumsum(~_text.SPACES[data])]
    full = some[e] > some[s]
    key = _text.mix(lines) ^ _text.mix(_text.rows_of(at).astype(np.uint64) + np.uint64(1))
    _, earliest = np.unique(key[full], return_index=True)
    again = np.ones(int(full.sum()), bool)
    again[earliest] = False
    out["n_dup_lines"] = np.bincount(_text.rows_of(at)[full][again], minlength=n)
    covered = np.zeros(len(h) + 1, np.int64)
    begin = np.flatnonzero(_text.starts_of(first, REPEAT_WORDS)) if len(h) else np.empty(0, np.int64)
    if len(begin):
        g = _text.grams(h, REPEAT_WORDS)[begin] ^ _text.mix(row[begin].astype(np.uint64) + np.uint64(1))
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = begin[order[np.r_[same, False] | np.r_[False, same]]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WORDS, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def apply_rules(docs: DataFrame, ratios: Ratios, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    Words are [^\\x20\\x09-\\x0D]+ as they are. base_failed: fewer than 20 words, or more than 30 % of them in repeated
    8-word windows. ratio: the mean log-likelihood ratio of the text's n-grams, 0 without any. kept: not base_failed
    and ratio >= threshold; every document is decided, none by chance. Null and empty texts have no words and fail.
    Columns may have any names; those named as the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    rows, names = _names.packed(docs, new, text=_names.col(text_col))

    def run(batches):
        r = shared.value
        for batch in _text.pieces(batches, "text"):
            data, offsets = _text.utf8(batch.column(1))
            x = _surface(data, offsets)
            failed = (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > REPEAT_PERCENT * x["n_words"])
            row, bucket, count = _text.features(data, offsets, r.bits)
            n = np.bincount(row, weights=count, minlength=batch.num_rows)
            ratio = np.bincount(row, weights=r.log_ratio[bucket] * count, minlength=batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[c].astype(np.int64)) for c in new[:5]), pa.array(failed), pa.array(ratio), pa.array(~failed & (ratio >= threshold))], names=["row", *new])

    results = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    return _names.unpacked(rows.mapInArrow(run, _names.with_fields(rows, ["row"], results)), names, *new)
