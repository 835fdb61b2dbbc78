"""Removal of byte strings that repeat across documents, by suffix order.

1. A window of LENGTH bytes has a minimizer, the K-byte string in it with the least hash. A window whose minimizer occurs
   in one document alone cannot repeat. They are counted over the whole corpus.
2. Runs of the windows left that share a minimizer are short strings, and all occurrences of a window lie in strings with
   its minimizer. Strings are dealt to parts by it; a task sends equal ones once, with their least id.
3. Strings that share a minimizer with another string of their part form one collection (one that is alone with its
   minimizer, as in exact copies, has its own least id). Its Burrows-Wheeler transform and common prefixes are built
   column by column: every round inserts one more symbol, from the right, of every string, and reads the transform's
   file from end to end to write the next. At the end suffixes that share LENGTH bytes are neighbours, and the least id
   of each such group goes back to its strings.
4. Documents drop the windows for which that id is below their own; overlapping windows are merged.

A minimizer of very many documents would make one part large. Its windows become strings of their own, dealt by their own
hashes, and go through the same construction.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._keys import Sums, blobs, merged, pack, unpack
from chobo.llm._store import Maps, remove, shared_dir, stage, stream, write_array

LENGTH, K = 50, 20
KEPT_BITS = np.uint64(0xFFFFFFFFFFFF0000)
"""Bits of a counted minimizer's hash that are moved; two that fall together let a window through, and lose none."""
MOST_WINDOWS = 64
"""Windows in one cut string, at most: strings stay short however a text repeats itself."""
HOT = 50_000
"""Minimizers of more documents than this are split: their windows are strings of their own."""
HOLD = 1 << 18
"""Strings that a task holds before it sends them on."""
PART_BYTES = 16 << 20
"""Bytes of text for each part, about."""
SEGMENT = 1 << 17
"""Bytes that are hashed at once: their arrays stay in the processor's cache."""
BLOCK = 1 << 17
"""Records of a transform that are in memory at once."""
LOW_BITS = 2
"""Without these low bits a place in a block has 16."""
DONE = 0xFF
"""Marks a suffix that no symbol comes before; no byte of UTF-8."""
BYTES = np.arange(256, dtype=np.uint8)


def _blocks(data: np.ndarray, length: int):
    """(at, end, sums, inverse) of blocks of window starts: sums and powers from which any string's hash follows."""
    at, n = 0, len(data)
    while at + length <= n:
        end = min(at + SEGMENT, n - length + 1)
        part = data[at : end + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_text._BYTES[part] * _text.powers(_text.BASE, len(part)), out=sums[1:])
        yield at, end, sums, _text.powers(_text.INVERSE, len(part) + 1)
        at = end


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int, only: np.ndarray | None = None):
    """(start, windows, key, row, hash) of the runs of windows with one k-byte minimizer; of ``only`` those, if given."""
    width = length - k + 1
    out = []
    for at, end, sums, inverse in _blocks(data, length):
        low = (sums[k:] - sums[:-k]) * inverse[: len(sums) - k]
        have = 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        last = np.searchsorted(offsets, at, "right") - 1
        row = np.repeat(np.arange(last, len(offsets) - 1), np.diff(np.clip(offsets[last:], at, end)))
        good = np.arange(at, end) + length <= offsets[row + 1]
        if only is not None:
            good &= only[at:end]
        i = np.flatnonzero(good)
        if not len(i):
            continue
        row, low = row[i], low[i]
        new = np.r_[True, (low[1:] != low[:-1]) | (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1])]
        begin = np.flatnonzero(new)
        place = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
        begin = np.flatnonzero(place % MOST_WINDOWS == 0)
        s, count = i[begin], np.diff(np.r_[begin, len(i)])
        e = s + count + length - 1
        out.append((s + at, count, _text.mix(low[begin] + np.uint64(1)), row[begin], _text.mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate([x[j] for x in out]) for j in range(5))


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that begin at ``at`` (sorted)."""
    out = np.empty(len(at), np.uint64)
    for begin, end, sums, inverse in _blocks(data, length):
        i, j = np.searchsorted(at, [begin, end])
        w = at[i:j] - begin
        out[i:j] = _text.mix((sums[w + length] - sums[w]) * inverse[w] + np.uint64(length))
    return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    to = np.cumsum(size)
    return data[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - size), size)]


def _distinct(key, h, doc):
    """(one, number): an entry with the least doc for each (key, h), and which of them each entry belongs to."""
    order = np.lexsort((doc, h, key))
    a, b = key[order], h[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(key) else np.empty(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class _Piles:
    """What the passes over a transform know of each symbol: where its suffixes begin, and what was seen of it so far."""

    def __init__(self, before: int, counts: np.ndarray) -> None:
        self.begins = before + np.cumsum(counts) - counts
        self.seen = np.zeros(256, np.int64)
        self.fresh = np.zeros(256, bool)
        self.low = np.full(256, 255, np.uint8)


def _pairs(symbol: np.ndarray, common: np.ndarray, fresh: np.ndarray, piles: _Piles):
    """One block of a transform: the suffixes one symbol longer than fresh ones, and those next after them.

    symbol, common: the block's symbols and common prefixes; fresh: its places whose suffixes were inserted last. Gives
    (first symbol, place in the next transform, common prefix, is it new?), sorted by symbol and place, and for the new
    ones which of ``fresh`` they extend.
    """
    n = len(symbol)
    flag = symbol.astype(np.uint16)
    flag[fresh] |= 256
    order = np.argsort(symbol, kind="stable")
    flag = flag[order]
    own = flag.astype(np.uint8)
    bounds = np.append(np.searchsorted(own, BYTES), n)
    bounds[DONE + 1 :] = bounds[DONE]
    start, count = bounds[:256], np.diff(bounds)
    put = np.flatnonzero(flag[: bounds[DONE]] >= 256)
    after = put + 1
    after = after[after < bounds[own[put].astype(np.int64) + 1]]
    carried = start[(count > 0) & piles.fresh]
    some = np.zeros(n, bool)
    some[put] = some[after] = some[carried] = True
    k = np.flatnonzero(some)
    c = own[k].astype(np.int64)
    place = piles.begins[c] + piles.seen[c] + k - start[c]
    value = np.zeros(len(k), np.uint8)
    opening = k == start[c]
    inner = np.flatnonzero(~opening)
    if len(inner):
        low, high = order[k[inner] - 1] + 1, order[k[inner]] + 1
        # from the last to the first: what lies between one range and the next is then empty
        by = np.argsort((0xFFFF - (low >> LOW_BITS)).astype(np.uint16), kind="stable")
        ends = np.stack((low[by], high[by]), 1).ravel()
        value[inner[by]] = np.minimum.reduceat(np.append(common, np.uint8(255)), ends)[::2] + np.uint8(1)
    for i in np.flatnonzero(opening & (piles.seen[c] > 0)).tolist():
        value[i] = min(int(piles.low[c[i]]), int(common[: order[k[i]] + 1].min())) + 1
    number = np.empty(n, np.int64)
    number[fresh] = np.arange(len(fresh))
    longer = flag[k] >= 256
    source = number[order[k[longer]]]
    here = np.flatnonzero(count[:DONE])
    last = order[bounds[here + 1] - 1]
    piles.low = np.minimum(piles.low, common.min())
    by = np.argsort(last)
    tail = np.minimum.reduceat(np.append(common, np.uint8(255)), np.append(last[by] + 1, n)) if len(by) else np.empty(0, np.uint8)
    piles.low[here[by]] = np.minimum.accumulate(tail[::-1])[::-1][: len(by)]
    piles.fresh[here] = flag[bounds[here + 1] - 1] >= 256
    piles.seen += np.append(count[:DONE], 0)
    return own[k], place, value, longer, source


def suffix_transform(data: np.ndarray, first: np.ndarray, folder: str) -> str:
    """The Burrows-Wheeler transform and common prefixes of the strings data[first[i]:first[i+1]], as a file in ``folder``.

    Strings have fewer than 255 bytes and do not get longer from one to the next. Column-wise construction: a round
    inserts one symbol of each string, from the right; shorter strings begin later, so that all end in the last round.
    A record is the symbol before a suffix (low byte) and the suffix's common prefix with the one before it (high
    byte). The suffix one longer lies after all that begin with smaller symbols and after as many of its own symbol as
    the transform has before it; its common prefix is one more than the least between the two places it came from.
    A round reads the file from end to end, block by block, and writes the next one: memory holds a block and one
    entry for each string.
    """
    m, size = len(first) - 1, np.diff(first)
    rounds = int(size[0]) if m else 0
    begins = np.searchsorted(-size, np.arange(-rounds, 1), "right")  # strings that are in from round r on
    path = [f"{folder}/transform-0", f"{folder}/transform-1"]
    with stream(path[0], "wb") as target:
        target.write(np.full(m, DONE, np.uint16).data)
    counts = np.zeros(256, np.int64)
    total = m
    at, symbol, of = (np.empty(0, kind) for kind in (np.int64, np.uint8, np.int64))
    fix_at, fix = np.empty(0, np.int64), np.empty(0, np.uint8)
    for r in range(rounds + 1):
        old, new = path[r % 2], path[(r + 1) % 2]
        # what the round brings: strings whose empty suffix gets its symbol, and the suffixes found in the last one
        opened = np.arange(begins[r - 1] if r else 0, begins[r]) if r < rounds else np.empty(0, np.int64)
        opened_symbol = data[first[opened + 1] - 1] if len(opened) else np.empty(0, np.uint8)
        counts += np.bincount(symbol, minlength=256) + np.bincount(opened_symbol, minlength=256)
        total += len(at)
        piles = _Piles(m, np.append(counts[:DONE], 0))
        found = []
        with stream(old, "rb") as source, stream(new, "wb") as target:
            for a in range(0, total, BLOCK):
                b = min(a + BLOCK, total)
                i, j = np.searchsorted(at, (a, b))
                x, y = np.searchsorted(fix_at, (a, b))
                block = np.frombuffer(source.read(2 * (b - a - (j - i))), np.uint16)
                if j > i:
                    here, have = at[i:j] - a, block
                    block = np.empty(b - a, np.uint16)
                    keep = np.ones(b - a, bool)
                    keep[here] = False
                    block[keep] = have
                    block[here] = symbol[i:j]
                else:
                    here, block = np.empty(0, np.int64), block.copy()
                if y > x:
                    block[fix_at[x:y] - a] = (block[fix_at[x:y] - a] & np.uint16(0xFF)) | (fix[x:y].astype(np.uint16) << np.uint16(8))
                u, v = (np.searchsorted(opened, (a, b)) if len(opened) else (0, 0))
                if v > u:
                    block[opened[u:v] - a] = opened_symbol[u:v]
                target.write(block.data)
                if r == rounds:
                    continue
                fresh = np.concatenate((opened[u:v] - a, here))
                whose = np.concatenate((opened[u:v], of[i:j]))
                pair = block.view(np.uint8)
                *some, extends = _pairs(np.ascontiguousarray(pair[0::2]), np.ascontiguousarray(pair[1::2]), fresh, piles)
                found.append((*some, whose[extends]))
        if r == rounds or not found:
            continue
        # entries of a block come by symbol and place: those of all blocks are in order once they are by symbol
        begin, fix_at, fix, new_one, of = (np.concatenate([f[q] for f in found]) for q in range(5))
        by = np.argsort(begin[new_one], kind="stable")
        at, of = fix_at[new_one][by], of[by]
        by = np.argsort(begin, kind="stable")
        fix_at, fix = fix_at[by], fix[by]
        left = first[of + 1] - first[of] - (r + 1 - (rounds - size[of])) - 1
        symbol = np.where(left >= 0, data[np.maximum(first[of] + left, 0)], np.uint8(DONE)).astype(np.uint8)
    remove(path[rounds % 2])
    return path[(rounds + 1) % 2]


def _blocks_of(path: str):
    """(place of the first record, records) of each block of a transform."""
    at = 0
    with stream(path, "rb") as source:
        while raw := source.read(2 * BLOCK):
            records = np.frombuffer(raw, np.uint16)
            yield at, records
            at += len(records)


def read_back(path: str, size: np.ndarray):
    """(length, places) for suffixes of each length from 0 on: where those of the first strings are in the transform.

    A suffix's place follows from that of the suffix one shorter, by as many of its symbol as come before it.
    """
    m, total, counts = len(size), 0, np.zeros(256, np.int64)
    for _, records in _blocks_of(path):
        counts += np.bincount(records.astype(np.uint8), minlength=256)
        total += len(records)
    piles = _Piles(m, np.append(counts[:DONE], 0))
    longer = np.zeros(total, np.int32 if total < 1 << 31 else np.int64)
    for a, records in _blocks_of(path):
        symbol = records.astype(np.uint8)
        order = np.argsort(symbol, kind="stable")
        own = symbol[order]
        bounds = np.append(np.searchsorted(own, BYTES), len(own))
        longer[a + order] = (piles.begins + piles.seen - bounds[:256])[own] + np.arange(len(own))
        piles.seen += np.diff(bounds)
    place = np.arange(m)
    for n in range(int(size[0]) + 1 if m else 0):
        yield n, place
        place = longer[place[: int(np.searchsorted(-size, -n - 1, "right"))]].astype(np.int64)


def _groups(path: str, length: int, total: int) -> np.ndarray:
    """For each place of the transform the number of its group: suffixes that share ``length`` bytes."""
    out = np.empty(total, np.int32 if total < 1 << 31 else np.int64)
    last = -1
    for a, records in _blocks_of(path):
        own = out[a : a + len(records)]
        np.cumsum(records >> np.uint16(8) < length, out=own)
        own += last
        last = int(own[-1])
    return out


def _least_ids(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int, folder: str) -> np.ndarray:
    """For each window of each string, string by string: the least doc of any string that holds the window."""
    if not len(size):
        return np.empty(0, np.int64)
    by = np.argsort(-size, kind="stable")
    at = np.cumsum(size) - size
    data, window, doc, size = _gather(data, at[by], size[by]), (np.cumsum(size - length + 1) - (size - length + 1))[by], doc[by], size[by]
    path = suffix_transform(data, np.r_[0, np.cumsum(size)], f"{folder}/{uuid.uuid4().hex}")
    group = _groups(path, length, len(data) + len(size))
    out = np.empty(int((size - length + 1).sum()), group.dtype)
    whose = np.empty(len(out), np.int32 if len(size) < 1 << 31 else np.int64)
    for n, place in read_back(path, size):
        if n >= length:
            at = window[: len(place)] + size[: len(place)] - n
            out[at], whose[at] = group[place], np.arange(len(place))
    remove(path)
    # groups of whole windows only: most places are suffixes too short for one
    held = np.zeros(int(group[-1]) + 1, bool)
    held[out] = True
    np.cumsum(held, out=group[: len(held)])
    out = group[out] - 1
    low = np.full(int(out.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, out, doc[whose])
    return low[out]


def _least_of_strings(key: np.ndarray, data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int, folder: str) -> np.ndarray:
    """_least_ids() of different strings that are in the order of their keys.

    All occurrences of a window lie in strings with its minimizer. So windows of a string that no other shares its key
    with occur in texts with this very string alone, and its least id is theirs; only the others need suffix order.
    Strings of one window have keys of their own and are ordered all the same.
    """
    differs = key[1:] != key[:-1]
    alone = np.append(True, differs)[: len(key)] & np.append(differs, True)[: len(key)] & (size > length)
    n = size - length + 1
    least = np.repeat(doc, n)
    rest = np.flatnonzero(~alone)
    if len(rest):
        least[np.repeat(~alone, n)] = _least_ids(_gather(data, (np.cumsum(size) - size)[rest], size[rest]), size[rest], doc[rest], length, folder)
    return least


def repeated_ranges(docs: DataFrame, folder: str, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """id, t, a, b: byte ranges a:b of the text that are windows of a document with a smaller id. docs: id, t, text.

    Strings are told apart by their minimizer's hash of 64 bits and another of 48, and windows within them by their bytes.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, math.ceil(math.log2(max(1, total / PART_BYTES))))
    parts = 1 << bits

    def count(batches):
        sums = Sums()
        send = lambda: (lambda q, c: blobs(q, c, (q >> np.uint64(64 - bits)).astype(np.int64)))(*sums.take())
        for batch in _text.pieces(batches, "text"):
            _, _, key, row, _ = _runs(*_text.utf8(batch.column(2)), length, k)
            key &= KEPT_BITS
            if len(key):
                order = np.argsort(key, kind="stable")  # rows ascend
                key, row = key[order], row[order]
                if sums.add(key[np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]]):
                    yield send()
        if sums.runs:
            yield send()

    def store(part, table):
        keys, counts = merged(table)
        p = part[0].as_py()
        write_array(f"{folder}/shared/keys-{p}", keys[counts > 1])
        write_array(f"{folder}/shared/hot-{p}", keys[counts > hot])
        return pa.table({"part": pa.array([p], pa.int32()), "hot": [int((counts > hot).sum())]})

    counted = docs.mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(store, "part int, hot long")
    stored = {r.part: r.hot for r in stage(counted, folder, "counted").collect()}

    def lookup():
        maps = Maps()

        def known(name, keys):
            unique, back = np.unique(keys, return_inverse=True)
            found = np.zeros(len(unique), bool)
            part = (unique >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                if p not in stored or name == "hot" and not stored[p]:
                    continue
                have, i = maps.get(f"{folder}/shared/{name}-{p}", np.uint64), order[cut[p] : cut[p + 1]]
                if len(have):
                    found[i] = have[np.minimum(np.searchsorted(have, unique[i]), len(have) - 1)] == unique[i]
            return found[back]

        return known

    def strings(known, data, offsets):
        """(start, windows, key, row, hash) of the runs of windows that may repeat, and of the single windows of hot minimizers."""
        runs = _runs(data, offsets, length, k)
        key = runs[2] & KEPT_BITS
        good = known("keys", key)
        if not any(stored.values()):
            return tuple(x[good] for x in runs)
        wide = good & known("hot", key)
        start, count, row = (x[wide] for x in (runs[0], runs[1], runs[3]))
        w = _gather(np.arange(len(data)), start, count)
        h = _window_hashes(data, w, length)
        single = (w, np.ones(len(w), np.int64), _text.mix(h + np.uint64(1)), np.repeat(row, count), h)
        return tuple(np.concatenate((x[good & ~wide], y)) for x, y in zip(runs, single, strict=True))

    columns = ["key", "h", "doc", "size", "data", "number", "row", "place", "id", "t"]

    def gather(batches):
        """What a task has of each part: its strings once each, and where its texts have them."""
        known = lookup()
        squeeze = zstandard.ZstdCompressor(level=1)

        def send(held):
            key, h, row, place, size, ids, ts, data = (np.concatenate([x[j] for x in held]) for j in range(8))
            start = np.cumsum(size) - size
            part = (key & np.uint64(parts - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = []
            for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                one, number = _distinct(key[i], h[i], ids[row[i]])
                one = i[one]
                own, back = np.unique(row[i], return_inverse=True)
                arrays = {"key": key[one], "h": h[one] & KEPT_BITS, "doc": ids[row[one]], "size": size[one].astype(np.uint8), "data": _gather(data, start[one], size[one]), "number": number.astype(np.uint32), "row": back.astype(np.uint32), "place": place[i].astype(np.uint32), "id": ids[own], "t": ts[own]}
                rows.append((int(part[i[0]]), *(squeeze.compress(pack(np.ascontiguousarray(arrays[c]))) for c in columns)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in range(1, len(columns) + 1))], names=["part", *columns])

        held, n_held, row_base = [], 0, 0
        for batch in _text.pieces(batches, "text"):
            data, offsets = _text.utf8(batch.column(2))
            start, count, key, row, h = strings(known, data, offsets)
            if not len(start):
                continue
            size = count + length - 1
            held.append((key, h, row + row_base, start - offsets[row], size, batch.column(0).to_numpy(), batch.column(1).to_numpy(), _gather(data, start, size)))
            row_base += batch.num_rows
            n_held += len(start)
            if n_held > HOLD:
                yield send(held)
                held, n_held, row_base = [], 0, 0
        if held:
            yield send(held)

    def reader(table):
        loosen = zstandard.ZstdDecompressor()
        return lambda c, kind: [unpack(loosen.decompress(x.as_py()), kind) for x in table.column(c)]

    def found(batches):
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32))], names=["id", "t", "a", "b"]) for a, b, c, d in batches], pa.schema([("id", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def places(get):
        """(number of the string among the blob's, id, t, place) of each blob."""
        for own, row, place, ids, ts in zip(get("number", np.uint32), get("row", np.uint32), get("place", np.uint32), get("id", np.int64), get("t", np.int64), strict=True):
            yield own.astype(np.int64), ids[row], ts[row], place.astype(np.int64)

    def answer(part, table):
        """Ranges of the texts that go, from the suffix order of all strings of the part."""
        get = reader(table)
        keys = get("key", np.uint64)
        key, doc, size = np.concatenate(keys), np.concatenate(get("doc", np.int64)), np.concatenate(get("size", np.uint8)).astype(np.int64)
        data = np.concatenate(get("data", np.uint8))
        first = np.cumsum(size) - size
        one, number = _distinct(key, np.concatenate(get("h", np.uint64)), doc)
        data, size, doc = _gather(data, first[one], size[one]), size[one], doc[one]
        least = _least_of_strings(key[one], data, size, doc, length, f"{folder}/scratch")
        n = size - length + 1
        string = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (least[1:] != least[:-1])])
        end = np.r_[begin[1:], len(string)]
        a, b, low = offset[begin], offset[end - 1] + length, least[begin]
        # runs of windows with one least id: those of string s are run_at[s]:run_at[s+1]
        run_at = np.searchsorted(string[begin], np.arange(len(n) + 1))
        out, base = [], 0
        for blob, (own, ids, ts, place) in zip(keys, places(get), strict=True):
            s = number[base + own]
            base += len(blob)
            runs = run_at[s + 1] - run_at[s]
            which = np.repeat(np.arange(len(s)), runs)
            r = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(run_at[s], runs)
            hit = low[r] < ids[which]
            which, r = which[hit], r[hit]
            out.append((ids[which], ts[which], place[which] + a[r], place[which] + b[r]))
        return found(out)

    sent = docs.mapInArrow(gather, "part int, " + ", ".join(f"{c} binary" for c in columns))
    # each part is a task of its own, however small
    return stage(sent.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(answer, "id long, t long, a int, b int"), folder, "ranges")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) for each row of ``docs``.

    Texts are UTF-8 bytes, null is empty. Each byte goes that is covered by a string of ``length`` bytes that also
    starts in a document with a smaller id, judged on the input. n_spans: maximal runs that go. Rows that share an id
    do not remove each other's bytes; rows without an id neither lose bytes nor remove any. kept is binary since a cut
    may fall within a character. Other columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    text = _names.col(text_col)
    rows = docs.select(_names.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    ranges = repeated_ranges(rows.filter("id is not null and text is not null"), folder, length, k, hot)
    # a set: rows that repeat id and text have the same ranges
    ranges = ranges.groupBy("id", "t").agg(F.collect_set(F.struct("a", "b")).alias("r")).select("id", "t", "r.a", "r.b")
    joined = rows.join(ranges, ["id", "t"], "left").select("id", "text", "a", "b")

    def run(batches):
        for batch in _text.pieces(batches, "text"):
            data, offsets = _text.utf8(batch.column(1))
            have = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            removed, spans, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                gone = n = 0
                if have[i]:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, batch.column(2)[i].values.to_numpy(), 1)
                    np.add.at(edge, batch.column(3)[i].values.to_numpy(), -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone, n = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    own = own[~out]
                own = own.tobytes()
                removed.append(gone)
                spans.append(n)
                sha.append(hashlib.sha256(own).hexdigest())
                if keep_bytes:
                    kept.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if keep_bytes else [])], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])])

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
