"""Language-model scores: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark.

Counting moves sorted arrays, not rows: a task sorts and adds up what it has seen and sends each part of the key space
as one binary row; a part's task merges the runs and stores it as a sorted array in the shared folder. Words are known
by 64-bit hashes and numbered by their place in the vocabulary, so a bigram is one 64-bit key. Bigrams are parted by
their first word, those of very common first words by the whole bigram. Workers map all arrays into memory and score
whole texts; the files, not the heap, grow with the corpus.

A trigram is the number of its last two words' bigram, counted from the first of a run of parts that is short enough for
it, and its first word, again one 64-bit key. It is stored with that bigram, so what precedes a bigram is counted where it lies. Of a trigram's first two words only the repeated trigrams
are sent on: all others of a bigram that occurs n times are seen once, and their number is what n leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._keys import FLUSH, Sums, blobs, merged, pack, unpack
from chobo.llm._store import Maps, drop, map_array, shared_dir, stage, write_array

END = np.uint64(0x5851F42D4C957F2D)
U32 = np.uint64(32)
KEYS = 1 << 64
PART_BYTES = 32 << 20
"""Bytes of text for each part of a model of order 2, about; one of order 3 has parts half as large."""


def _with_end(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text: its words, then the end."""
    return np.insert(h, first[1:], END), first + np.arange(len(first))


@dataclass
class Model:
    """What a worker needs: where the arrays are, and the numbers that are the same for all words."""

    folder: str
    parts: int
    words: list[int] = field(default_factory=list)
    """Words before each part of the vocabulary, and all."""
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pairs: int = 0
    discounts: list[float] = field(default_factory=lambda: [0, 0, 0])
    lower_discounts: list[float] = field(default_factory=lambda: [0, 0, 0])
    lower_left: float = 1.0
    """Weight that the lower order leaves to the uniform distribution over all words and an unknown one."""
    order: int = 2
    places: list[int] = field(default_factory=list)
    """Bigrams before each part, and all. Order 3 only, as are the fields below."""
    texts: int = 0
    top_discounts: list[float] = field(default_factory=lambda: [0, 0, 0])
    start_left: float = 1.0
    """Weight that the trigrams of first words leave to the lower order."""

    @property
    def n_words(self) -> int:
        return self.words[-1] if self.words else 0

    @property
    def wide(self) -> bool:
        """May a part hold 2**32 trigrams or more?"""
        return self.tokens >= 1 << 32

    @property
    def id_step(self) -> int:
        return max(1, -(-(self.n_words + 1) // self.parts))


class _Reader:
    """The mapped arrays of a model, opened as they are needed, in one worker."""

    def __init__(self, model: Model) -> None:
        self.m, self.maps = model, Maps()

    def array(self, name: str, dtype) -> np.ndarray:
        return self.maps.get(f"{self.m.folder}/model/{name}", dtype)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted hashes; id -1 and count 0 where training had none."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bits = self.m.parts.bit_length() - 1
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            keys = self.array(f"words-{p}", np.uint64) if self.m.words[p + 1] > self.m.words[p] else np.empty(0, np.uint64)
            if len(keys):
                a, b = np.searchsorted(part, [p, p + 1])
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes[a:b])
                ids[a:b][hit] = at[hit] + self.m.words[p]
                counts[a:b][hit] = self.array(f"counts-{p}", np.int64)[at[hit]]
        return ids, counts

    def counts(self, name: str, at: np.ndarray) -> np.ndarray:
        """Counts stored by ``_write_counts`` at these places."""
        out = self.array(name, np.uint8)[at].astype(np.int64)
        more = np.flatnonzero(out == 255)
        if len(more):
            out[more] = self.array(f"{name}-more", np.int64)[np.searchsorted(self.array(f"{name}-at", np.int64), at[more])]
        return out

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, numbers) of sorted bigram keys; count 0 and number -1 where training had none."""
        out, number, part = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64), _pair_part(keys, self.m)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            have = self.array(f"pairs-{p}", np.uint64)
            if len(have):
                k = order[cut[p] : cut[p + 1]]
                at = np.minimum(np.searchsorted(have, keys[k]), len(have) - 1)
                hit = have[at] == keys[k]
                out[k[hit]] = self.counts(f"times-{p}", at[hit])
                number[k[hit]] = at[hit] + (self.m.places[p] if self.m.places else 0)
        return out, number

    def by_place(self, numbers: np.ndarray):
        """(part, range, places in the part) of sorted bigram numbers, for each part that has some."""
        cut = np.searchsorted(numbers, self.m.places)
        for p in np.flatnonzero(np.diff(cut)):
            yield p, slice(cut[p], cut[p + 1]), numbers[cut[p] : cut[p + 1]] - self.m.places[p]

    def befores(self, numbers: np.ndarray) -> np.ndarray:
        """How many words precede each bigram, by sorted numbers."""
        out = np.zeros(len(numbers), np.int64)
        for p, some, at in self.by_place(numbers):
            start = self.array(f"starts-{p}", np.int64 if self.m.wide else np.uint32)
            out[some] = start[at + 1].astype(np.int64) - start[at]
        return out

    def lefts(self, numbers: np.ndarray) -> np.ndarray:
        """Weight that the trigrams beginning with each bigram leave to the lower order, by sorted numbers."""
        out = np.full(len(numbers), self.m.top_discounts[0])
        for p, some, at in self.by_place(numbers):
            have = self.array(f"repeats-{p}", np.int64)
            if len(have):
                i = np.minimum(np.searchsorted(have, at), len(have) - 1)
                out[some] = np.where(have[i] == at, self.array(f"top_left-{p}", np.float64)[i], out[some])
        return out

    def triples(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Counts of trigrams: sorted numbers of the last two words' bigrams, and the first words."""
        out = np.zeros(len(numbers), np.int64)
        for p, some, at in self.by_place(numbers):
            start, words = self.array(f"starts-{p}", np.int64 if self.m.wide else np.uint32), self.array(f"firsts-{p}", np.uint32)
            want, low, end = first[some], start[at].astype(np.int64), start[at + 1].astype(np.int64)
            high, live = end.copy(), np.arange(len(at))
            while len(live := live[low[live] < high[live]]):
                mid = (low[live] + high[live]) >> 1
                less = words[mid] < want[live]
                low[live[less]], high[live[~less]] = mid[less] + 1, mid[~less]
            hit = np.flatnonzero(low < end)
            hit = hit[words[low[hit]] == want[hit]]
            found = np.zeros(len(at), np.int64)
            found[hit] = self.counts(f"triples-{p}", low[hit])
            out[some] = found
        return out

    def by_id(self, name: str, dtype, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids."""
        out, step = np.zeros(len(ids), dtype), self.m.id_step
        cut = np.searchsorted(ids, np.arange(self.m.parts + 1) * step)
        for p in np.flatnonzero(np.diff(cut)):
            out[cut[p] : cut[p + 1]] = self.array(f"{name}-{p}", dtype)[ids[cut[p] : cut[p + 1]] - p * step]
        return out


def _pair_part(keys: np.ndarray, m: Model) -> np.ndarray:
    first = keys >> U32
    mixed = np.where(np.isin(first, m.hot), _text.mix(keys), _text.mix(first + np.uint64(1)))
    return (mixed % np.uint64(m.parts)).astype(np.int64)


def _write_counts(path: str, counts: np.ndarray) -> None:
    """One byte a count; those of 255 and more stand apart."""
    more = np.flatnonzero(counts >= 255)
    write_array(path, np.minimum(counts, 255).astype(np.uint8))
    write_array(f"{path}-at", more)
    write_array(f"{path}-more", counts[more].astype(np.int64))


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _sequences(reader: _Reader, h: np.ndarray, first: np.ndarray):
    """(before, token ids, counts) of all tokens; before the first token of a text stands the number of words."""
    unique, back = np.unique(h, return_inverse=True)
    ids, counts = reader.words(unique)
    token = ids[back]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = reader.m.n_words
    return before, token, counts[back]


def _left(m: Model, total, twice, more, times):
    """Weight left by the trigrams of a bigram: it occurs ``total`` times, ``twice`` of them are seen twice, ``more``
    of them more often, ``times`` together, and all others once."""
    d = m.top_discounts
    return (d[0] * (total - 2 * twice - times) + d[1] * twice + d[2] * more) / total


def _two_before(before: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The word before ``before``; before the first and second token of a text stands ``start``."""
    out = np.empty_like(before)
    out[1:] = before[:-1]
    out[first[:-1]] = start
    return out


def _key_runs(places: list[int], words: int) -> list[int]:
    """The first parts of runs of parts whose bigrams, numbered from the run's first, make 64-bit keys with any word."""
    begins = [0]
    for p in range(1, len(places) - 1):
        if (places[p + 1] - places[begins[-1]]) * words > KEYS:
            begins.append(p)
    if any((places[b] - places[a]) * words > KEYS for a, b in zip(begins, [*begins[1:], -1], strict=True)):
        raise ValueError("a part has more bigrams than make 64-bit keys with any word")
    return begins


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count a model on all texts of ``docs`` and store it in the shared folder. Null texts are empty: an end alone.

    order: 2 or 3, the longest n-grams. Before a text stand order - 1 starts.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    folder = shared_dir(docs.sparkSession)
    texts = docs.select(_names.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 << max(3, math.ceil(math.log2(max(1, size / PART_BYTES))) + order - 2)
    m = Model(folder, parts, order=order)
    blob = "part int, keys binary, counts binary"

    def count_words(batches):
        sums = Sums()
        bits = parts.bit_length() - 1
        send = lambda: (lambda k, c: blobs(k, c, (k >> np.uint64(64 - bits)).astype(np.int64)))(*sums.take())
        for batch in _text.pieces(batches, "text"):
            _, _, h, first = _text.words(*_text.utf8(batch.column(0)))
            if sums.add(_with_end(h, first)[0]):
                yield send()
        if sums.runs:
            yield send()

    def store_words(key, table):
        keys, counts = merged(table)
        p = key[0].as_py()
        write_array(f"{folder}/model/words-{p}", keys)
        write_array(f"{folder}/model/counts-{p}", counts)
        return pa.table({"part": [p], "n": [len(keys)], "tokens": [int(counts.sum())]})

    words = texts.mapInArrow(count_words, blob).repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(store_words, "part long, n long, tokens long")
    found = {r.part: r for r in stage(words, folder, "words").collect()}
    m.words = np.cumsum([0, *(found[p].n if p in found else 0 for p in range(parts))]).tolist()
    m.tokens = sum(r.tokens for r in found.values())

    def hot_words(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                if p in found:
                    some = np.flatnonzero(map_array(f"{folder}/model/counts-{p}", np.int64) * (parts * 8) > m.tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(some + m.words[p])], names=["word"])

    # words with more than an eighth of a part's share: of these there are fewer than 8 * parts
    hot = [r.word for r in docs.sparkSession.range(0, parts, 1, min(parts, 64)).mapInArrow(hot_words, "word long").collect()]
    m.hot = np.array(sorted([*hot, m.n_words]), np.uint64)
    if m.n_words >= 1 << 32:
        raise ValueError("more than 2**32 words: a bigram is no longer one 64-bit key")

    def count_pairs(batches):
        sums, reader = Sums(), _Reader(m)
        send = lambda: (lambda k, c: blobs(k, c, _pair_part(k, m)))(*sums.take())
        for batch in _text.pieces(batches, "text"):
            _, _, h, first = _text.words(*_text.utf8(batch.column(0)))
            before, token, _ = _sequences(reader, *_with_end(h, first))
            if sums.add(before.astype(np.uint64) << U32 | token.astype(np.uint64)):
                yield send()
        if sums.runs:
            yield send()

    def sums_of(p, keys, counts, repeats=(), more=()):
        """Rows of what a part's bigrams add to the sums of their words, and of its repeated trigrams."""
        u, at = np.unique(keys >> U32, return_index=True)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]) if len(u) else np.zeros((4, 0), np.int64)
        w, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        out = []
        for i in range(parts):
            a, b = np.searchsorted(u, [i * m.id_step, (i + 1) * m.id_step])
            c, d = np.searchsorted(w, [i * m.id_step, (i + 1) * m.id_step])
            if b > a or d > c:
                out.append((i, pack(u[a:b].astype(np.uint32)), pack(np.ascontiguousarray(stats[:, a:b]).ravel()), pack(w[c:d].astype(np.uint32)), pack(n[c:d].astype(np.uint32)), []))
        out += [(-2 - i, pack(k), pack(np.ascontiguousarray(v).ravel()), b"", b"", []) for i, k, v in repeats]
        out.append((-1, b"", b"", b"", b"", [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), *more]))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("u", "stats", "w", "n"), 1)}, "seen": pa.array([r[5] for r in out], pa.list_(pa.int64()))})

    sums_schema = "part int, u binary, stats binary, w binary, n binary, seen array<long>"

    def store_pairs(key, table):
        keys, counts = merged(table)
        p = key[0].as_py()
        write_array(f"{folder}/model/pairs-{p}", keys)
        _write_counts(f"{folder}/model/times-{p}", counts)
        if order == 2:
            return sums_of(p, keys, counts)
        return pa.table({"part": [p], "n": [len(keys)], "texts": [int(counts[keys >> U32 == np.uint64(m.n_words)].sum())]})

    # every part has its arrays, also one in which no bigram falls
    empty = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), *[F.lit(b"").alias(c) for c in ("keys", "counts")])
    pairs = texts.mapInArrow(count_pairs, blob).union(empty).repartitionById(parts, F.col("part")).groupBy("part")
    if order == 3:
        found = {r.part: r for r in stage(pairs.applyInArrow(store_pairs, "part long, n long, texts long"), folder, "pairs").collect()}
        m.places = np.cumsum([0, *(found[p].n for p in range(parts))]).tolist()
        m.texts = sum(r.texts for r in found.values())
        v = m.n_words + 1
        begins = _key_runs(m.places, v)
        run_at = np.array([m.places[b] for b in begins])

    def count_triples(batches):
        # few trigrams repeat within a task: holding more of them would hardly send fewer
        held, reader = [Sums(FLUSH // 4 // len(begins)) for _ in begins], _Reader(m)
        send = lambda r: (lambda k, c: blobs(k, c, np.searchsorted(m.places, (k // np.uint64(v)).astype(np.int64) + run_at[r], side="right") - 1))(*held[r].take())
        for batch in _text.pieces(batches, "text", _text.BATCH_BYTES // 4):
            _, _, h, first = _text.words(*_text.utf8(batch.column(0)))
            h, first = _with_end(h, first)
            before, token, _ = _sequences(reader, h, first)
            keys, back = np.unique(before.astype(np.uint64) << U32 | token.astype(np.uint64), return_inverse=True)
            number = reader.pairs(keys)[1][back]
            run = np.searchsorted(run_at, number, side="right") - 1
            keys = (number - run_at[run]).astype(np.uint64) * np.uint64(v) + _two_before(before, first, m.n_words).astype(np.uint64)
            for r in np.unique(run).tolist():
                if held[r].add(keys[run == r]):
                    yield send(r)
        for r, sums in enumerate(held):
            if sums.runs:
                yield send(r)

    def store_triples(key, table):
        keys, counts = merged(table)
        p = key[0].as_py()
        at, u = (keys // np.uint64(v)).astype(np.int64) + run_at[np.searchsorted(begins, p, side="right") - 1] - m.places[p], (keys % np.uint64(v)).astype(np.uint32)
        have = map_array(f"{folder}/model/pairs-{p}", np.uint64)
        before = np.bincount(at, minlength=len(have))
        write_array(f"{folder}/model/starts-{p}", np.cumsum(np.r_[0, before]).astype(np.int64 if m.wide else np.uint32))
        write_array(f"{folder}/model/firsts-{p}", u)
        _write_counts(f"{folder}/model/triples-{p}", counts)
        some = np.flatnonzero(counts >= 2)
        c = counts[some]
        of, k = np.unique(u[some].astype(np.uint64) << U32 | have[at[some]] >> U32, return_inverse=True)
        what = np.stack([np.bincount(k, weights=x, minlength=len(of)).astype(np.int64) for x in (c == 2, c >= 3, c * (c >= 3))])
        start = of == (np.uint64(m.n_words) << U32 | np.uint64(m.n_words))
        more = [*(int((counts == x).sum()) for x in (1, 2, 3, 4)), *what[:, start].sum(1).tolist()]
        of, what = of[~start], what[:, ~start]
        part = _pair_part(of, m)
        repeats = [(int(i), of[part == i], what[:, part == i]) for i in np.unique(part)]
        return sums_of(p, have, before, repeats, more)

    counted = pairs.applyInArrow(store_pairs, sums_schema) if order == 2 else texts.mapInArrow(count_triples, blob).union(empty).repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(store_triples, sums_schema)
    sums = stage(counted, folder, "sums")
    seen = sums.filter("part = -1").agg(*[F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)) for i in range(5 if order == 2 else 12)]).first()
    m.pairs, m.discounts = seen[0], _discounts(seen[1:5])

    def store_repeats(key, table):
        p = -2 - key[0].as_py()
        of = np.concatenate([unpack(x.as_py(), np.uint64) for x in table.column("u")])
        what = np.concatenate([unpack(x.as_py(), np.int64).reshape(3, -1) for x in table.column("stats")], axis=1)
        of, k = np.unique(of, return_inverse=True)
        twice, more, times = (np.bincount(k, weights=x, minlength=len(of)) for x in what)
        at = np.searchsorted(map_array(f"{folder}/model/pairs-{p}", np.uint64), of)
        total = _Reader(m).counts(f"times-{p}", at)
        write_array(f"{folder}/model/repeats-{p}", at)
        write_array(f"{folder}/model/top_left-{p}", _left(m, total, twice, more, times))
        return pa.table({"n": [len(of)]})

    if order == 3:
        m.top_discounts = _discounts(seen[5:9])
        if m.texts:
            m.start_left = float(_left(m, m.texts, *seen[9:]))
        none = empty.select((-2 - F.col("part")).alias("part"), "keys", "counts")
        sums.filter("part < -1").select("part", "u", "stats").union(none).groupBy("part").applyInArrow(store_repeats, "n long").agg(F.sum("n")).collect()

    def store_ids(key, table):
        p = key[0].as_py()
        size = m.id_step
        stats, n = np.zeros((4, size), np.int64), np.zeros(size, np.int64)
        for r in table.to_pylist():
            u = unpack(r["u"], np.uint32).astype(np.int64) - p * size
            stats[:, u] += unpack(r["stats"], np.int64).reshape(4, -1)
            w = unpack(r["w"], np.uint32).astype(np.int64) - p * size
            n[w] += unpack(r["n"], np.uint32)
        total = stats[0].astype(np.float64)
        left = (np.array(m.discounts) @ stats[1:]) / np.maximum(total, 1)
        write_array(f"{folder}/model/total-{p}", total)
        write_array(f"{folder}/model/left-{p}", left)
        write_array(f"{folder}/model/before-{p}", n)
        return pa.table({"seen": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]], pa.list_(pa.int64()))})

    # every range of ids has its arrays, also one in which no bigram falls
    ranges = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), *[F.lit(b"").alias(c) for c in ("u", "stats", "w", "n")])
    found = sums.filter("part >= 0").select("part", "u", "stats", "w", "n").union(ranges).groupBy("part").applyInArrow(store_ids, "seen array<long>").collect()
    seen = np.sum([r.seen for r in found], axis=0)
    m.lower_discounts = _discounts(seen[:4])
    if m.pairs:
        m.lower_left = float(np.array(m.lower_discounts) @ [seen[0], seen[1], seen[4]]) / m.pairs
    drop(docs.sparkSession, folder, "sums")
    return m


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and one end. n_known: tokens seen in training.
    base_score: the log10 probability by add-one counts; score: by the model; perplexity: 10 ** (-score / n_tokens).
    Null and empty texts are an end alone. Words that training had not share one unknown word; after one of them the
    lower orders alone count. Untrained, every word is as likely. Columns may have any
    names; those named as the results are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    rows, names = _names.packed(docs, new, text=_names.col(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, reader = shared.value, None
        for batch in _text.pieces(batches, "text", _text.BATCH_BYTES // (1 if m.order == 2 else 4)):
            reader = reader or _Reader(m)
            _, _, h, first = _text.words(*_text.utf8(batch.column(1)))
            h, first = _with_end(h, first)
            row = _text.rows_of(first)
            before, token, counts = _sequences(reader, h, first)
            base = np.log10((counts + 1) / (m.tokens + m.n_words + 1))
            ids, back = np.unique(token, return_inverse=True)
            known = ids >= 0
            n = np.zeros(len(ids), np.int64)
            n[known] = reader.by_id("before", np.int64, ids[known])
            low = (m.lower_left / (m.n_words + 1) + np.where(n > 0, n - _discount(n, m.lower_discounts), 0) / max(m.pairs, 1))[back]
            ctx, back = np.unique(before, return_inverse=True)
            known = ctx >= 0
            total, left = np.zeros(len(ctx)), np.ones(len(ctx))
            if m.pairs:
                total[known] = reader.by_id("total", np.float64, ctx[known])
                left[known] = reader.by_id("left", np.float64, ctx[known])
            left[total == 0] = 1.0
            total, left = total[back], left[back]
            p = left * low
            both = np.flatnonzero((token >= 0) & (before >= 0) & (total > 0))
            keys, back = np.unique(before[both].astype(np.uint64) << U32 | token[both].astype(np.uint64), return_inverse=True)
            times, number = reader.pairs(keys)
            if m.order == 2:
                c = times[back]
                p[both] += (c - _discount(c, m.discounts)) / total[both]
            else:
                c, top_left, pair = np.zeros(len(keys), np.int64), np.ones(len(keys)), np.full(len(p), -1)
                by = np.argsort(number, kind="stable")
                rank, ranked = np.empty_like(by), number[by]
                rank[by] = np.arange(len(by))
                by = by[ranked >= 0]
                c[by], top_left[by] = reader.befores(number[by]), reader.lefts(number[by])
                pair[both] = back
                p[both] += (c[back] - _discount(c[back], m.discounts)) / total[both]
                # the bigram that a trigram begins with is that of the token before
                of = np.r_[-1, pair[:-1]]
                top, weight = np.r_[times, 0][of], np.r_[top_left, 1.0][of]
                top[first[:-1]], weight[first[:-1]] = m.texts, m.start_left
                seen = np.flatnonzero(top > 0)
                p[seen] *= weight[seen]
                seen = seen[pair[seen] >= 0]
                seen = seen[number[pair[seen]] >= 0]
                keys, back = np.unique(rank[pair[seen]].astype(np.uint64) << U32 | _two_before(before, first, m.n_words)[seen].astype(np.uint64), return_inverse=True)
                c = reader.triples(ranked[(keys >> U32).astype(np.int64)], keys.astype(np.uint32))[back]
                p[seen] += (c - _discount(c, m.top_discounts)) / top[seen]
            size = np.diff(first)
            s = np.bincount(row, weights=np.log10(p), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.bincount(row[counts > 0], minlength=batch.num_rows)), pa.array(np.full(batch.num_rows, m.tokens)), pa.array(np.bincount(row, weights=base, minlength=batch.num_rows)), pa.array(s), pa.array(10.0 ** np.minimum(-s / size, 300))], names=["row", *new])

    results = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return _names.unpacked(rows.mapInArrow(run, _names.with_fields(rows, ["row"], results)), names, *new)
