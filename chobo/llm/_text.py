"""Words of many UTF-8 texts at once, as 64-bit hashes in NumPy arrays.

All separators used here are ASCII, so words can be cut in the bytes. A hash is a polynomial over the bytes of the
word (A-Z counted as a-z where asked), mixed at the end, and taken for a whole Arrow batch with prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SEGMENT = 1 << 20
BATCH_BYTES = 4 << 20


def classes(separators) -> np.ndarray:
    """Per byte: does it separate words?"""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


SPACES = classes([*range(0x09, 0x0E), 0x20])
"""Words are runs of [^\\x20\\x09-\\x0D]."""
NOT_ALNUM = classes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
"""Once A-Z are lower case, words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""


WORDS_AND_MARKS = np.where(SPACES, 0, np.where(NOT_ALNUM, 2, 1)).astype(np.uint8)
"""Words and runs of punctuation, apart."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row begins (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, whatever the batch size: memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _segments(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that cut no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:
            starts = offsets[np.searchsorted(offsets, end, "right") - 1]
            if starts > at:
                end = int(starts)
            else:
                back = np.flatnonzero(separators[data[at:end]])
                if len(back):
                    end = at + int(back[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, end, "right")])
                    while end < stop and not separators[data[end]]:
                        block = np.flatnonzero(separators[data[end : min(end + SEGMENT, stop)]])
                        if len(block):
                            end += int(block[0])
                            break
                        end = min(end + SEGMENT, stop)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True, hashes: bool = True, kinds: np.ndarray | None = None):
    """(starts, ends, hashes, first): byte ranges and hashes of all words; first[i]:first[i+1] are those of row i.

    kinds: a kind for each byte, 0 for separators; a word then also ends where the kind changes.
    """
    table = _LOWER if lower else _BYTES
    if kinds is not None:
        separators = kinds == 0
    starts, ends, values = [], [], []
    for at, end in _segments(data, offsets, separators):
        part = data[at:end]
        inside = ~separators[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        before[cut] = False
        turn = kinds[part[1:]] != kinds[part[:-1]] if kinds is not None else None
        if turn is not None:
            before[1:] &= ~turn
        s = np.flatnonzero(inside & ~before)
        if not len(s):
            continue
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        if turn is not None:
            after[:-1] &= ~turn
        e = np.flatnonzero(inside & ~after) + 1
        starts.append(s + at)
        ends.append(e + at)
        if hashes:
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(table[part] * powers(BASE, len(part)), out=sums[1:])
            values.append(mix((sums[e] - sums[s]) * powers(INVERSE, len(part))[s] + (e - s).astype(U64)))
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, U64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(values) if hashes else None, np.searchsorted(s, offsets)


def grams(hashes: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each n consecutive words, across row boundaries too: use only those that begin n before a row's end."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, U64)
    for j in range(n):
        out = out * U64(base) + hashes[j : j + m]
    return mix(out)


def starts_of(first: np.ndarray, n: int) -> np.ndarray:
    """Mask over all words: does an n-gram of its own row begin there? ``first`` as words() gives it."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    for back in range(1, n):
        cut = first[1:] - back
        ok[cut[cut >= first[:-1]]] = False
    return ok


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of hashed word 1- and 2-grams, sorted by row and bucket.

    Words and runs of punctuation count as words, A-Z as a-z; a word equal to the one before it counts as one fixed word.
    """
    _, _, h, first = words(data, offsets, kinds=WORDS_AND_MARKS)
    h = h.copy()
    if len(h):
        again = np.flatnonzero((h[1:] == h[:-1]) & starts_of(first, 2)[:-1]) + 1
        h[again] = U64(BASE)
    row = rows_of(first)
    pair = np.flatnonzero(starts_of(first, 2)) if len(h) else np.empty(0, np.int64)
    two = grams(h, 2)[pair] if len(pair) else np.empty(0, U64)
    bucket = np.concatenate((mix(h) >> U64(64 - bits), two >> U64(64 - bits))).astype(np.int64)
    key, count = np.unique(np.concatenate((row, row[pair])) << bits | bucket, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal bytes only, and the different words by number."""
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    own = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    if lower:
        own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
    words_ = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(own)])
    coded = words_.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary
