"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

1. Every text becomes its set of hashed word shingles, MinHash samples, band keys and an odd sketch: the samples
   hashed into a parity bitmap, so that the XOR of two bitmaps has few bits set when most samples agree.
2. Copies of one word sequence collapse into a class, numbered in the order of the classes' smallest ids; only classes
   are compared.
3. In each band bucket a class is paired with the bucket's first class, never with all. Sketches drop pairs whose
   estimate is far below the threshold; the best pair of each class is confirmed on full sets.
4. Links so far give components. Pairs that cross components follow, then, for buckets that still hold more than one
   component, all crossing pairs, compared in blocks by sketch and by a parity bitmap of the full sets, which leaves
   those near the threshold. So no bucket is cut short, and one that is a single component costs its size, not its
   square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text
from chobo.llm._store import drop, shared_dir, stage
from chobo.llm.components import connected_components

BITS, SET_BITS = 256, 2048
SLACK = 0.40
"""A pair whose estimated similarity is under the threshold by more than this is not confirmed: some six deviations."""


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 31, n, np.uint32) << 1 | 1).astype(np.uint32), r.integers(0, 1 << 32, n, np.uint32)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all n-word shingles row by row; a shorter row is one shingle, a row without words none."""
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    keep = _text.starts_of(first, n)
    keep[first[short]] = True
    out = np.zeros(len(hashes), np.uint64)
    full = _text.grams(hashes, n)
    out[: len(full)] = full
    for i in short:
        out[first[i]] = _text.mix(np.array([int(_text.mix(hashes[first[i] : first[i + 1]] * _text.powers(0xA24BAED4963EE407, n)[: counts[i]]).sum(dtype=np.uint64)) ^ int(counts[i])], np.uint64))[0]
    kept = np.flatnonzero(keep)
    return out[kept], np.searchsorted(kept, first)


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's word sequence."""
    out = np.zeros((2, len(first) - 1), np.uint64)
    rows = np.flatnonzero(np.diff(first))
    if len(rows):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        for k, base in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            p = _text.powers(base, int(place.max()) + 1)
            out[k, rows] = _text.mix(np.add.reduceat(_text.mix(hashes ^ np.uint64(base)) * p[place], first[:-1][rows]))
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """id, t, f1, f2 (of the word sequence), n_shingles, bands array<long>, s0..s3 (the odd sketch) of docs (id, t, text)."""
    k = bands * rows

    def run(batches):
        a, b = _multipliers(k, seed)
        sample_salt = (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for batch in _text.pieces(batches, "text"):
            data, offsets = _text.utf8(batch.column(2))
            _, _, h, first = _text.words(data, offsets)
            sh, at = shingles(h, first, words)
            n = batch.num_rows
            some = np.flatnonzero(np.diff(at))
            low = np.full((k, n), 0xFFFFFFFF, np.uint32)
            x = (sh >> np.uint64(32)).astype(np.uint32)
            if len(some):
                cut = at[:-1][some]
                for i in range(k):
                    low[i, some] = np.minimum.reduceat(x * a[i] + b[i], cut)
            low = np.ascontiguousarray(low.T).astype(np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            for j in range(rows):
                keys = keys * np.uint64(0xD6E8FEB86659FD93) + low[:, j::rows]
            keys = _text.mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
            bit = (_text.mix(low ^ sample_salt) % np.uint64(BITS)).astype(np.int64) + np.arange(n)[:, None] * BITS
            odd = (np.bincount(bit.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
            sketch = np.packbits(odd, axis=1).view(np.int64)
            sizes = np.array([len(np.unique(sh[at[i] : at[i + 1]])) for i in range(n)], np.int64)
            f = _fingerprints(h, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f[0]), pa.array(f[1]), pa.array(sizes), lists, *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(BITS // 64))], names=["id", "t", "f1", "f2", "n_shingles", "bands", *(f"s{j}" for j in range(BITS // 64))])

    schema = "id long, t long, f1 long, f2 long, n_shingles long, bands array<long>, " + ", ".join(f"s{j} long" for j in range(BITS // 64))
    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, set, odd: the sorted distinct shingle hashes of each document (id, text), and their parity bitmap, as binary."""

    def run(batches):
        for batch in _text.pieces(batches, "text"):
            data, offsets = _text.utf8(batch.column(1))
            _, _, h, first = _text.words(data, offsets)
            sh, at = shingles(h, first, words)
            sets = [np.unique(sh[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            odd = [np.packbits((np.bincount((x >> np.uint64(7)).astype(np.int64) % SET_BITS, minlength=SET_BITS) & 1).astype(np.uint8)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(odd, pa.binary())], names=["id", "set", "odd"])

    return docs.mapInArrow(run, "id long, set binary, odd binary")


def bits_allowed(similarity: float, samples: int) -> int:
    """XOR bits that two sketches of sets this similar have on average."""
    return math.ceil(BITS * (1 - math.exp(-4 * samples * (1 - similarity) / BITS)) / 2)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    # a row holds two whole sets: many small batches, whatever the session's batch size
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return with_b.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    c = comps.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    d = comps.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(c, "a", "left").join(d, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _near_enough(bits: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of these sizes together, whose parity bitmaps differ in so many bits, be similar enough?

    The symmetric difference of similar sets is at most a share of their sizes; its parity has a known mean and
    variance, and only pairs six deviations above go.
    """
    most = sizes * (100 - percent) / (100 + percent)
    e2, e4 = np.exp(-2 * most / SET_BITS), np.exp(-4 * most / SET_BITS)
    return bits <= SET_BITS * (1 - e2) / 2 + 6 * np.sqrt(np.maximum(SET_BITS * (1 - e4) / 4 - most * e4, 0)) + 2


def _block_pairs(members: DataFrame, most_bits: int, percent: int, block: int) -> DataFrame:
    """(a, b), a > b: pairs of one bucket, of different components, that may be similar enough; each pair once.

    members: key, id, component, main (in the bucket's largest component), n, n_rest, s0..s3, bands (31 bits of each
    key), odd, size. Rows outside the largest component meet all rows of the bucket, block by block; a task holds two
    blocks, however large the bucket. A pair that shares several buckets comes from the one of their first common band.
    """
    n_a, n_b = F.ceil(F.col("n_rest") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    sketch = [f"s{j}" for j in range(BITS // 64)]
    kept = ["id", "component", *sketch, "bands", "odd", "size"]
    left = members.filter("not main").select("key", F.pmod(F.xxhash64("id"), n_a).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), n_b - 1)).alias("y"), F.lit(True).alias("q"), *kept)
    right = members.select("key", F.explode(F.sequence(F.lit(0), n_a - 1)).alias("x"), F.pmod(F.xxhash64("id", F.lit(7)), n_b).cast("int").alias("y"), F.lit(False).alias("q"), *kept)

    def run(key, table):
        own = key[0].as_py() & 0x7FFFFFFF
        q = table.column("q").to_numpy(zero_copy_only=False)
        ids, comp, size = (table.column(c).to_numpy() for c in ("id", "component", "size"))
        s = np.stack([table.column(c).to_numpy() for c in sketch], 1).view(np.uint64)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        odd = np.frombuffer(b"".join(x.as_py() for x in table.column("odd")), np.uint64).reshape(len(ids), -1)
        rows, others = np.flatnonzero(q), np.flatnonzero(~q)
        a, b = [], []
        for i in range(0, len(rows), 64):
            r = rows[i : i + 64]
            bits = np.zeros((len(r), len(others)), np.int32)
            for j in range(len(sketch)):
                bits += np.bitwise_count(s[r, j][:, None] ^ s[others, j][None, :])
            u, v = np.nonzero((bits <= most_bits) & (comp[r][:, None] != comp[others][None, :]))
            for k in range(0, len(u), 20_000):
                x, y = r[u[k : k + 20_000]], others[v[k : k + 20_000]]
                good = _near_enough(np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64), size[x] + size[y], percent)
                x, y = x[good], y[good]
                good = bands[x, (bands[x] == bands[y]).argmax(1)] == own
                a.append(ids[x[good]])
                b.append(ids[y[good]])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return left.union(right).groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _components(docs: DataFrame, words: int, percent: int, bands: int, rows: int, seed: int, block: int) -> DataFrame:
    """id, t, n_shingles, root_id, root_t of docs (id, t, text): the least id of the component, and the hash of its text."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    sketch = [f"s{j}" for j in range(BITS // 64)]
    most = bits_allowed(max(0.0, percent / 100 - SLACK), bands * rows)
    signed = stage(signatures(docs, words, bands, rows, seed), folder, "signed")
    some = signed.filter("n_shingles > 0 and id is not null")
    # numbers follow the order of the ids, so the least number of a component is that of its least id
    classes = some.groupBy("f1", "f2").agg(F.min(F.struct("id", "t")).alias("rep")).select("f1", "f2", "rep.id", "rep.t")
    classes = classes.repartitionByRange("id", "t", "f1", "f2").sortWithinPartitions("id", "t", "f1", "f2").withColumn("c", F.monotonically_increasing_id())
    classes = stage(classes, folder, "classes")
    one = ["id", "t", "f1", "f2"]
    reps = some.join(classes, one).dropDuplicates(one)

    banded = reps.select(F.col("c").alias("id"), F.explode("bands").alias("key"))
    firsts = banded.groupBy("key").agg(F.min("id").alias("p"), F.count("*").alias("n")).filter("n > 1")
    shared = stage(banded.join(firsts, "key"), folder, "shared")
    sketches = lambda name: reps.select(F.col("c").alias(name), F.array(*sketch).alias(f"s_{name}"))
    bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = shared.filter("id > p").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct().join(sketches("a"), "a").join(sketches("b"), "b")
    pairs = stage(pairs.select("a", "b", bits.alias("bits")).filter(F.col("bits") <= most), folder, "pairs")

    wanted = classes.join(shared.select(F.col("id").alias("c")).distinct(), "c", "left_semi").select("id", "t", "c")
    texts = docs.join(wanted, ["id", "t"]).dropDuplicates(["id", "t"]).select(F.col("c").alias("id"), "text")
    sets = stage(shingle_sets(texts, words), folder, "sets")

    best = pairs.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
    links = stage(_confirm(best, sets, percent), folder, "links-1")
    comps = connected_components(links, folder, "cc1")
    rest = _crossing(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    links = links.union(stage(_confirm(rest, sets, percent), folder, "links-2"))
    comps = connected_components(links, folder, "cc2")

    # A bucket of two classes has had its pair; one that is a single component needs no more.
    sized = shared.select("key", "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_comp = sized.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_keys = by_comp.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("component", F.struct("c", "component")).alias("largest"), F.max("c").alias("most")).filter("n > 2 and most < n")
    profiles = sets.select("id", "odd", (F.octet_length("set") / 8).cast("long").alias("size"))
    profiles = profiles.join(reps.select(F.col("c").alias("id"), *sketch, F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")), "id")
    members = sized.join(open_keys, "key").select("key", "id", "component", (F.col("component") == F.col("largest")).alias("main"), "n", (F.col("n") - F.col("most")).alias("n_rest")).join(profiles, "id")
    rest = _block_pairs(members, most, percent, block).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    links = stage(links.union(_confirm(rest, sets, percent)), folder, "links-3")
    comps = connected_components(links, folder, "cc3")
    for name in ("shared", "pairs", "sets", "links-1", "links-2"):
        drop(spark, folder, name)

    found = classes.join(comps.withColumnRenamed("id", "c"), "c", "left").select("f1", "f2", F.coalesce("component", "c").alias("component"))
    roots = found.join(classes.select(F.col("c").alias("component"), F.col("id").alias("root_id"), F.col("t").alias("root_t")), "component").drop("component")
    # the groups of copies may be very large: this join splits them, a window could not
    return signed.select("id", "t", "f1", "f2", "n_shingles").join(roots, ["f1", "f2"], "left").select("id", "t", "n_shingles", *(F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col(f"root_{x}")).otherwise(F.col(x)).alias(f"root_{x}") for x in ("id", "t")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [_names.col(id_col).cast("long").alias("id"), F.xxhash64(_names.col(text_col)).alias("t")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 40, rows: int = 4, seed: int = 20, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept, one row for each row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``words``-word shingles (A-Z
    lower-cased, words parted by white space; a shorter text is one shingle). component_id is the smallest id that
    links reach, kept marks that document. Null, empty and blank texts have an empty set, are linked with nothing and
    kept. Repeated rows get equal answers; rows that share an id but not a text are documents of their own, each with
    its own links. Ids are longs; a null id counts as a document of its own, unlinked. Other columns of ``docs`` are
    ignored. At similarity 0.75 a pair of classes shares no band with probability (1 - 0.75**rows)**bands: 2.5e-7; its
    sketches hold it back with probability 1.3e-8, and a crossing pair found only in the blocks may also be held back
    by the bitmap of the full sets, six deviations wide.
    """
    out = _components(docs.select(*_keyed(docs, id_col, text_col), _names.col(text_col).alias("text")), words, percent, bands, rows, seed, block)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("root_id").alias("component_id"), F.coalesce(F.col("id") == F.col("root_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 40, rows: int = 4, seed: int = 20, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component stays, of its least id and, of that, one text.

    Components are those of ``near_duplicates``. Texts without words, and rows without an id, all stay. Of rows that
    repeat the id and the text that stays, one stays. Columns may have any names.
    """
    keys = _keyed(docs, id_col, text_col)
    folder = shared_dir(docs.sparkSession)
    found = _components(docs.select(*keys, _names.col(text_col).alias("text")), words, percent, bands, rows, seed, block)
    # an id and a text that go with all their rows, or, where ``again``, with all but one
    marked = found.filter("n_shingles > 0 and id is not null").groupBy("id", "t").agg(F.count("*").alias("n"), F.bool_and((F.col("id") == F.col("root_id")) & (F.col("t") == F.col("root_t"))).alias("root"))
    marked = stage(marked.filter("not root or n > 1").select("id", "t", "root"), folder, "marked")
    packed, names = _names.packed(docs, [], **{k: c for k, c in zip(("id", "t"), keys, strict=True)})
    out = packed.join(marked.select("id", "t"), ["id", "t"], "left_anti")
    again = marked.filter("root")
    if not again.isEmpty():
        out = out.unionByName(packed.join(again.select("id", "t"), ["id", "t"], "left_semi").dropDuplicates(["id", "t"]))
    return _names.unpacked(out, names)
