"""Runs: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words of a text with smallest period q (words q apart are equal) that is at least
``max(least, 2 * q)`` words long and that no neighbouring word extends. They are found exactly, scale by scale:

- Periods below 32: a direct scan at each lag. Six to eight equal pairs in a row are a seed.
- Periods from 2**j up to 2**(j+1), for each j from 5 on: hashes of 2**(j-1) consecutive words, of which each window of
  2**j words picks the least. A run is at least two periods long, so a window of it comes again one period later and
  picks the same place in it: two equal picks at a lag within the scale are a seed.
- A gram that repeats within itself lies in a run of a shorter period, which is known by then. Its picks would pair with
  one another over and over, so such runs are represented by their two ends: a longer period that leaves the shorter run
  shifts its first or last gram onto that of another one; one that stays within two touching runs of the same shorter
  period has one of the lags that their phases allow. Any other gram comes again at most eight times within a scale.

A seed, a place and a lag, is extended to both sides by comparing prefix sums of two hashes (modulo 2**64 and modulo
2**31 - 1) in steps of halves, so its cost does not depend on the run's length. Words are compared by number, which
stands for their bytes. Work is linear in a text's words for each scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._text import BASE, INVERSE, U64, mix, powers

LEAST = 12
LAGS = 32
"""Periods below this are found by scans at every lag; the least scale begins here."""
PRIME, PRIME_BASE = (1 << 31) - 1, 1_220_703_125


class _Prefix:
    """Prefix sums of two hashes over an array of word numbers; texts are parted by numbers that occur once."""

    def __init__(self, w: np.ndarray) -> None:
        n = self.n = len(w)
        value = mix(w.astype(U64) + U64(BASE))
        self.wide = np.zeros(n + 1, U64)
        np.cumsum(value * powers(BASE, n), out=self.wide[1:])
        self.prime_powers = np.ones(n + 1, np.int64)
        have = 1
        while have <= n:
            step = int(pow(PRIME_BASE, have, PRIME))
            more = self.prime_powers[:have][: n + 1 - have]
            self.prime_powers[have : have + len(more)] = more * step % PRIME
            have += len(more)
        self.small = np.zeros(n + 1, np.int64)
        np.cumsum((value >> U64(33)).astype(np.int64) % PRIME * self.prime_powers[:n] % PRIME, out=self.small[1:])

    def grams(self, k: int, upto: int) -> np.ndarray:
        """A hash of the k words from each place before ``upto``, where so many follow."""
        m = max(0, upto - k + 1)
        return mix((self.wide[k : k + m] - self.wide[:m]) * powers(INVERSE, m))

    def equal(self, i: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the ``size`` words from i on those from i + lag on?"""
        a = (self.wide[i + size] - self.wide[i]) * powers(BASE, self.n)[lag] == self.wide[i + lag + size] - self.wide[i + lag]
        at = np.flatnonzero(a)
        i, lag, size = i[at], lag[at], size[at]
        left = (self.small[i + size] - self.small[i]) % PRIME * self.prime_powers[lag] % PRIME
        a[at] = left == (self.small[i + lag + size] - self.small[i + lag]) % PRIME
        return a

    def stretch(self, i: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest start, end around i such that words ``lag`` apart within them are equal."""
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        step = 1 << max(self.n, 1).bit_length()
        while step:
            for size, whole in ((right, False), (left, True)):
                more = size + step
                fits = np.flatnonzero(i - more >= 0 if whole else i + lag + more <= self.n)
                begin = i[fits] - more[fits] if whole else i[fits]
                good = fits[self.equal(begin, lag[fits], more[fits])]
                size[good] += step
            step >>= 1
        return i - left, i + lag + right


def _short_seeds(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    places, lags = [], []
    for q in range(1, min(LAGS, len(w))):
        same = w[q:] == w[:-q]
        need, have = max(q, least - q, 1), 1
        while have < need and have < 8:
            more = min(have, need - have, 8 - have)
            same = same[:-more] & same[more:] if len(same) > more else same[:0]
            have += more
        at = np.flatnonzero(same)
        at = at[np.r_[True, np.diff(at) > 1]] if len(at) else at
        places.append(at)
        lags.append(np.full(len(at), q))
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(lags or [np.empty(0, np.int64)])


def _picks(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window of so many, the first where it is there twice."""
    bits = U64(max(len(hashes), 1).bit_length())
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U64)
    have = 1
    while have < window and len(low):
        more = min(have, window - have)
        low = np.minimum(low[:-more], low[more:]) if len(low) > more else low[:0]
        have += more
    at = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def _pairs(at: np.ndarray, hashes: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of all pairs of places with equal hashes whose lag is within lo, hi."""
    order = np.lexsort((at, hashes[at]))
    at = at[order]
    h = hashes[at]
    places, lags, t = [], [], 1
    live = np.arange(len(at))
    while True:
        live = live[live + t < len(at)]
        gap = at[live + t] - at[live]
        near = (h[live + t] == h[live]) & (gap < hi)
        live = live[near]
        if not len(live):
            break
        far = gap[near] >= lo
        places.append(at[live[far]])
        lags.append(gap[near][far])
        t += 1
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(lags or [np.empty(0, np.int64)])


def _long_seeds(prefix: _Prefix, j: int, upto: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of periods from 2**j up to 2**(j+1); known: start, end, period of all runs of shorter periods."""
    lo, hi, k = 1 << j, 2 << j, 1 << j - 1
    hashes = prefix.grams(k, upto)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k) & (known[:, 1] <= upto)]
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, inner[:, 0], 1)
    np.add.at(covered, inner[:, 1] - k + 1, -1)
    at = _picks(hashes, lo - k + 1)
    found = [_pairs(at[np.cumsum(covered)[at] == 0], hashes, lo, hi), _pairs(np.unique(inner[:, 0]), hashes, lo, hi), _pairs(np.unique(inner[:, 1] - k), hashes, lo, hi)]
    inner = inner[np.lexsort((inner[:, 0], inner[:, 2]))]
    touch = np.flatnonzero((inner[1:, 2] == inner[:-1, 2]) & (inner[1:, 0] <= inner[:-1, 1])) if len(inner) > 1 else []
    for x in touch:
        (a, b, p), (c, d, _) = inner[x], inner[x + 1]
        last = b - k
        first = np.flatnonzero(hashes[c : min(c + p, d - k + 1)] == hashes[last])
        if len(first):
            lag = np.arange(c + first[0] - last, min(hi, b - a + p, d - c + p), p)
            lag = lag[(lag >= lo) & (last + lag + k <= d)]
            found.append((np.full(len(lag), last), lag))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _longest_at(prefix: _Prefix, places: np.ndarray, lags: np.ndarray, least: int) -> np.ndarray:
    """start, end, period of the runs around these seeds; a stretch found at several lags has the least as its period."""
    start, end = prefix.stretch(places, lags)
    good = end - start >= np.maximum(least, 2 * lags)
    runs = np.stack([start[good], end[good], lags[good]], axis=1).astype(np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs


def runs_of(w: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, end, period of all runs of an array of word numbers, by start and period.

    sizes: words of each text, from the longest to the shortest; each text is followed by one number of its own.
    """
    prefix = _Prefix(w)
    runs = _longest_at(prefix, *_short_seeds(w, least), least)
    j = LAGS.bit_length() - 1
    while True:
        upto = int((sizes[sizes >= 2 << j] + 1).sum())
        if not upto:
            break
        runs = np.concatenate([runs, _longest_at(prefix, *_long_seeds(prefix, j, upto, runs), least)])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs
        j += 1
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _batch(text: pa.Array, least: int) -> list[pa.Array]:
    """n_words, runs, collapsed of a batch of texts."""
    data, offsets = _text.utf8(text)
    s, e, _, first = _text.words(data, offsets, lower=False, hashes=False)
    numbers, _ = _text.named(data, s, e)
    n = np.diff(first)
    # texts from the longest to the shortest, each with a number of its own behind it
    order = np.argsort(-n, kind="stable")
    begin = np.r_[0, np.cumsum(n[order] + 1)]
    shift = np.empty(len(n), np.int64)
    shift[order] = begin[:-1]
    row = _text.rows_of(first)
    place = shift[row] + np.arange(len(row)) - first[row]
    w = np.empty(int(begin[-1]), np.int64)
    w[begin[1:] - 1] = -1 - np.arange(len(n))
    w[place] = numbers
    runs = runs_of(w, n[order], least)
    of = np.searchsorted(begin, runs[:, 0], "right") - 1
    gone = np.zeros(len(w) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone)[place] == 0
    # back to the order of the rows
    back = np.lexsort((runs[:, 2], runs[:, 0], order[of]))
    runs, of = runs[back], of[back]
    found = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    # of each text the kept words, and behind all but the last of them one byte, made a space
    s, e, row = s[kept], e[kept], row[kept]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.empty(0, bool)
    inside = np.zeros(len(data) + 2, np.int8)
    np.add.at(inside, s, 1)
    np.add.at(inside, e + ~last, -1)
    out = data.copy()
    out[e[~last]] = 0x20
    out = out[np.cumsum(inside[: len(data)], dtype=np.int8).view(bool)]
    size = np.bincount(row, weights=e - s + ~last, minlength=len(n)).astype(np.int64)
    joined = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
    return [pa.array(n), _lists(np.bincount(order[of], minlength=len(n)), found), joined.cast(pa.string())]


def periodic_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words (long), runs (array of start, length, period, by start and then period) and
    collapsed: the words that no run holds behind its first period, joined by one blank.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared as they are; periods are smallest ones and lengths at
    least ``max(least, 2 * period)``, least being 12 or more. Null texts have no words, no runs and a null ``collapsed``;
    empty texts an empty one. Rows are judged each for itself, so repeated rows and ids give equal results. Columns may
    have any names; those named as the results are replaced. Nothing is shuffled. A task holds one text, or a few
    megabytes of short ones, and some two hundred bytes for each of their words.
    """
    if least < 12:
        raise ValueError("least must be at least 12: shorter seeds are not looked for")
    rows, names = _names.packed(docs, ["n_words", "runs", "collapsed"], text=_names.col(text_col).cast("string"))
    schema = _names.with_fields(rows, ["row"], "n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")

    def run(batches):
        for b in _text.pieces(batches, "text"):
            text = b.column("text")
            n, runs, joined = _batch(text, least)
            joined = pc.if_else(text.is_valid(), joined, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("row"), n, runs, joined], names=["row", "n_words", "runs", "collapsed"])

    return _names.unpacked(rows.mapInArrow(run, schema), names, "n_words", "runs", "collapsed")


def looped(text: Column, key: Column) -> Column:
    """Of a tenth of the rows, by the checksum of their id, the text with its end made to repeat; the others' own text.

    h = crc32 of the decimal id, g = h div 10; where h mod 10 is 0, of n words the i-th from a = g mod n on becomes word
    a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8). A null id is no such row.
    """
    h = F.crc32(key.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def turned(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        end = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), end), " "))

    made = F.get(F.transform(F.array(words), turned), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def longest() -> Column:
    """Of ``runs`` the one of greatest length; of equal ones the first, then that of least period."""
    return F.reduce("runs", F.expr("cast(null as struct<start bigint, length bigint, period bigint>)"), lambda a, r: F.when(a.isNull() | (r.length > a.length), r).otherwise(a))
