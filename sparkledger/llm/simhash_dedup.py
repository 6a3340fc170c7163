"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint of 64 bits per block sums the bits of the hashes of all word shingles. For a radius r
every bit position gets a vector of F2^(r+1); the masks <vector, v> for the 2^(r+1)-1 vectors v <> 0
are such that any r positions are all left out by some mask, so two fingerprints within the radius
agree under that mask and meet in its table: no pair is missed.

Links within the radius (`similar_fingerprints`) never enumerate pairs of a bucket: a bucket of two
is checked directly; fingerprints of larger buckets are exploded to the 65 values that differ in at
most one bit, and those that share a value (exactly those within distance 2) are tied in a star
to its smallest holder. Radius 2 is therefore exact and linear in the number of fingerprints.

Near-duplicate documents (`near_dedup`) take candidates from the same tables over several
independent fingerprints, here of the distinct words: an edited word changes one word but five
shingles, so that texts with scattered edits have word fingerprints only a few bits apart. A passage that
is appended, cut off or replaced changes words as much as shingles; such pairs, and all others that meet in
no bucket, come from an exact prefix join on rare shingles (`_completed`). The sets of shingles of the
candidates are then compared exactly (`near_components`).

Defined results: a null, empty or blank text has fingerprint zero and links like any other;
fewer words than a shingle: the whole sequence is one shingle; repeated rows are each returned with
the same component; a null doc_id stays null and does not name a component; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import components, cut, drop, mix, read, released, small

GRAM, RADIUS, SEED = 3, 2, 42
#: For whole documents: five-word shingles, Jaccard similarity, and blocks of fingerprints.
NEAR_GRAM, NEAR_RADIUS, NEAR_BLOCKS, NEAR_SIMILARITY = 5, 3, 2, 0.8
#: Partners of a text that are compared with it in one task, members of a bucket in one block, and rows of a frequent bucket in one task.
GROUP, BLOCK, DEALT = 256, 2048, 1 << 20
#: Exact complement: one text in so many counted for the order of shingles, shingles whose counts are kept, and rows of a batch.
SAMPLE, OFTEN, SLICE = 32, 200_000, 10_000
#: Bytes of rows that a task compares at a time, or one block of a bucket against another.
HELD = 32 << 20
#: Documents whose parities may be broadcast.
SMALL_MARKS = 100_000
_M = (1 << 64) - 1


def shingle_hashes(data: bytes, gram: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < gram else list(map(b" ".join, zip(*(words[i:] for i in range(gram)))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(runs))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of h, in slices so that memory stays small."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(gram: int, blocks: int, sets: bool):
    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).cast(pa.binary()):
                h = shingle_hashes(t.as_py() or b"", gram)
                if sets:
                    h = np.unique(h)
                out.append([majority(h if k == 0 else mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & _M))) for k in range(blocks)])
            flat = np.array(out, dtype=np.uint64).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * blocks, pa.array(flat))], ["doc_id", "fps"])

    return run


def fingerprints(docs: DataFrame, gram: int = GRAM, blocks: int = 1, sets: bool = False) -> DataFrame:
    """doc_id and fps, an array of one 64-bit fingerprint for each block."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(_fingerprints(gram, blocks, sets)), "doc_id long, fps array<long>")


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits; any `radius` positions are all left out of one of them."""
    dim = radius + 1
    rng = np.random.default_rng(seed)
    # each non-zero vector as often as any other, so that the masks are of nearly equal weight
    vectors = np.resize(rng.permutation(np.arange(1, 1 << dim)), 64)
    return [sum(1 << i for i, m in enumerate(vectors) if bin(int(m) & v).count("1") & 1) for v in range(1, 1 << dim)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(fps: DataFrame, masks: list[int], columns: list) -> DataFrame:
    """A row for each table: its number, the masked fingerprint and the given columns."""
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks))
    return fps.select(*columns, F.posexplode(keys).alias("tab", "key"))


def similar_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all pairs within the radius of 2 or less."""
    if radius > 2:
        raise ValueError("exact links need a radius of 2 or less; see near_dedup for more")
    rows = _tables(fps, covering_masks(radius), ["fp"])
    buckets = cut(rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where("n = 2").select("a", "b")
    crowded = rows.join(buckets.where("n > 2").select("tab", "key"), ["tab", "key"], "left_semi").select("fp").distinct()
    if radius == 2:
        near = F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64))))
        seen = crowded.select("fp", F.explode(near).alias("value"))
        low = seen.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "low")
        stars = seen.join(low, "value").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    else:
        flips = F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64))))
        stars = crowded.select(F.col("fp").alias("a"), flips.alias("b")).where("a < b").join(crowded.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b") if radius else crowded.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).union(stars)


def simhash_components(docs: DataFrame, gram: int = GRAM, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links within the radius."""
    fp = cut(fingerprints(docs, gram).select("doc_id", F.col("fps")[0].alias("fp")))
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(similar_fingerprints(first.select("fp"), radius))
    named = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return fp.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _pair_sets(gram: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", gram)).view(np.int64) for t in b.column(1).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["rid", "hs"])

    return run


def _packed(batches):
    """Texts (rid, text, groups) compressed, since they are sent to each of their groups."""
    for b in batches:
        texts = [zlib.compress(t.as_py() or b"", 1) for t in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), b.column(2)], ["rid", "packed", "groups"])


def _jaccard(gram: int, similarity: float):
    """Pairs (a, b) of a group's head a and its other members whose shingle sets reach the similarity.

    Rows are (a, part, rid, packed), sorted by group with its head first; a task holds one head and one batch.
    """

    def run(batches):
        at = head = None
        for b in batches:
            left, right = [], []
            for a, part, rid, packed in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                own = np.unique(shingle_hashes(zlib.decompress(packed.as_py()), gram))
                if (a, part) != at:
                    at, head = (a, part), own
                    continue
                common = len(np.intersect1d(head, own, assume_unique=True))
                if common >= similarity * (len(head) + len(own) - common):
                    left.append(a)
                    right.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _compared(texts: DataFrame, close: DataFrame, gram: int, similarity: float) -> DataFrame:
    """Those pairs (a, b), already cut, whose shingle sets reach the similarity.

    The texts of a and of all its b meet in one task; the b of a crowded a are dealt over several.
    """
    sizes = cut(close.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("n")))
    dealt = close.join(small(sizes), "a").select("a", F.pmod(F.xxhash64("b"), "n").alias("part"), "b")
    group = F.struct("a", "part")
    groups = cut(dealt.select(F.col("a").alias("rid"), group.alias("g")).union(dealt.select(F.col("b").alias("rid"), group.alias("g"))).groupBy("rid").agg(F.collect_set("g").alias("groups")))
    sent = texts.select("rid", "text").join(small(groups), "rid").mapInArrow(released(_packed), "rid long, packed binary, groups array<struct<a: long, part: long>>")
    rows = sent.select(F.explode("groups").alias("g"), "rid", "packed").select("g.a", "g.part", "rid", "packed")
    sorted_ = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("rid") != F.col("a"))
    out = cut(sorted_.mapInArrow(released(_jaccard(gram, similarity)), "a long, b long"))
    drop(sizes, groups)
    return out


def _linked(texts: DataFrame, pairs: DataFrame, edges: DataFrame | None, gram: int, similarity: float) -> DataFrame:
    """The edges and those of the pairs, already cut, that reach the similarity."""
    got = _compared(texts, pairs, gram, similarity)
    if edges is None:
        return got
    out = cut(edges.union(got))
    drop(edges, got)
    return out


def _covered(texts: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs (a, b) of texts whose distinct words have a fingerprint within the radius of the smallest rid of one of its buckets.

    Texts of equal fingerprint are one row for the tables, whose smallest rid they are paired with.
    """
    prints = fingerprints(texts.select(F.col("rid").alias("doc_id"), "text"), 1, blocks, sets=True)
    prints = cut(prints.select(F.col("doc_id").alias("rid"), F.posexplode("fps").alias("block", "fp")))
    first = cut(prints.groupBy("block", "fp").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("n")))
    copies = prints.join(small(cut(first.where("n > 1"))), ["block", "fp"]).where("rid <> a").select("a", F.col("rid").alias("b"))
    keys = F.array(*(F.when(F.col("block") == k, F.array(*(F.xxhash64(F.lit(k), F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(covering_masks(radius, k + 1))))) for k in range(blocks)))
    rows = first.select(F.explode(F.flatten(F.filter(keys, lambda x: x.isNotNull()))).alias("bucket"), "a", "fp")
    # a crowded bucket is never gathered: its head comes from map-side minima, and only members of shared buckets are joined to one
    least = rows.groupBy("bucket").agg(F.min("a").alias("head"), F.min_by("fp", "a").alias("head_fp"), F.count(F.lit(1)).alias("n"))
    heads = cut(least.where("n > 1").select("bucket", "head", "head_fp"))
    near = rows.join(small(heads), "bucket").where("a <> head").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))) <= radius)
    out = cut(near.select(F.col("head").alias("a"), F.col("a").alias("b")).union(copies).distinct())
    drop(prints, first, heads)
    return out


def _often(texts: DataFrame, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of frequent shingles of a sample of texts. They only order and deal the shingles: any order gives the same pairs."""
    every = max(1, min(SAMPLE, texts.count() // 4096))
    part = texts.where(F.pmod(F.xxhash64("rid", F.lit(SEED)), F.lit(every)) == 0).select("rid", "text").mapInArrow(released(_pair_sets(gram)), "rid long, hs array<long>")
    rows = part.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(OFTEN).toArrow()
    h, n = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order] * every


def _prefixes(gram: int, similarity: float, often: np.ndarray, counts: np.ndarray):
    """For each set its first shingles in one order of all shingles, rare ones first: sets that reach the similarity share one of these.

    Rows are (bucket, salt, rid, at); at holds the size and the place. Buckets known to be frequent are dealt over salts.
    """

    def run(batches):
        for b in batches:
            keys, salts, places, sizes = [], [], [], []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                h = np.unique(shingle_hashes(t.as_py() or b"", gram))
                n = len(h)
                seen = np.zeros(n, np.int64)
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    seen = np.where(often[at] == h, counts[at], 0)
                    order = np.lexsort((h, seen))
                    h, seen = h[order], seen[order]
                k = _prefix(n, similarity)
                keys.append((h[:k] if n else np.zeros(1, np.uint64)).view(np.int64))
                # a frequent bucket has so many parts; 0 is that of all others
                parts = -(-seen[:k] // DEALT) if n else np.zeros(1, np.int64)
                salts.append(np.where(parts > 1, 1 + rid % np.maximum(parts, 1), 0).astype(np.int32))
                places.append(np.arange(k))
                sizes.append(n)
            each = list(map(len, keys))
            none = [np.zeros(0, np.int64)]
            at = np.repeat(np.array(sizes, np.int64), each) << 32 | np.concatenate([*none, *places])
            whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate([*none, *keys])), pa.array(np.concatenate([np.zeros(0, np.int32), *salts])), pa.array(np.repeat(b.column(0).to_numpy(), each)), pa.array(at)], ["bucket", "salt", "rid", "at"])
            yield from (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE))

    return run


def _prefix(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-6)) + 1


def _need(sizes, similarity: float):
    """The shingles that sets of these sizes (their sum) share at the least if they reach the similarity."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-6)


def _can(na, pa_, nb, pb, similarity: float):
    """Whether two sets of these sizes can reach the similarity if they share members at these places."""
    return (np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) >= _need(na + nb, similarity)) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-6)


def _possible(low: Column, high: Column, similarity: float) -> Column:
    """As `_can`, for two rows of a bucket, the smaller set first."""
    na, nb = F.shiftright(low, 32), F.shiftright(high, 32)
    pa_, pb = low.bitwiseAND(F.lit(0xFFFFFFFF)), high.bitwiseAND(F.lit(0xFFFFFFFF))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (na + nb) - 1e-6)
    return (F.least(pa_, pb) + F.least(na - pa_, nb - pb) >= need) & (na >= F.lit(similarity) * nb - 1e-6)


def parity(h: np.ndarray) -> bytes:
    """At least 2 len(h) bits, a power of two, each the parity of the members of h that fall on it: two sets differ in no more bits than members.

    The two halves, one xor the other, are the parities for half the bits.
    """
    m = 1 << max(6, int(2 * len(h) - 1).bit_length()) if len(h) else 64
    ones = np.bincount((mix(h) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def _parities(gram: int):
    def run(batches):
        for b in batches:
            bits = [parity(np.unique(shingle_hashes(t.as_py() or b"", gram))) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["rid", "bits"])

    return run


class _Apart:
    """Number of parity bits in which the rows of a task differ."""

    def __init__(self, bits: pa.ChunkedArray):
        cells = bits.to_pylist()
        self.words = np.array([len(c) // 8 for c in cells], np.int64)
        self.at = np.zeros(len(cells), np.int64)
        self.of = {}
        for n in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == n)
            self.at[own] = np.arange(len(own))
            self.of[n] = np.frombuffer(b"".join(cells[i] for i in own), np.uint64).reshape(len(own), n)

    def _rows(self, i: np.ndarray, n: int, to: int) -> np.ndarray:
        rows = self.of[n][self.at[i]]
        while rows.shape[1] > to:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        kind = self.words[i] << 32 | self.words[j]
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            n, m = k >> 32, k & 0xFFFFFFFF
            out[own] = np.bitwise_count(self._rows(i[own], n, min(n, m)) ^ self._rows(j[own], m, min(n, m))).sum(1, dtype=np.int64)
        return out


def _whole_groups(batches):
    """Tables of whole groups (the first three columns) of sorted batches, of about HELD bytes or one group."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n < HELD:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([c.to_numpy().astype(np.int64) for c in table.columns[:3]])
        other = np.flatnonzero((keys != keys[:, -1:]).any(0))
        if len(other):
            ends = int(other[-1]) + 1
            yield table.slice(0, ends)
            held, n = table.slice(ends).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)


def _met(similarity: float):
    """The pairs (a, b) of different components of a group that places, sizes and parities do not rule out; no pair that reaches the similarity is lost.

    Rows are (bucket, x, y, side, rid, at, component, bits). Groups with x = y hold one block of a bucket,
    others two blocks, whose rows are compared across. Rows are sorted by group, and a task holds some groups at a time.
    """

    def run(batches):
        for table in _whole_groups(batches):
            yield from of(table)

    def of(table):
        bucket, x, y, side, rid, at, comp = (c.to_numpy() for c in table.columns[:-1])
        size, place, apart = at >> 32, at & 0xFFFFFFFF, _Apart(table.column(7))
        order = np.lexsort((size, y, x, bucket))
        bucket, x, y = bucket[order], x[order], y[order]
        start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))

        def couples():
            """Positions of the members of pairs, some pairs at a time."""
            n = np.diff(np.append(start, len(bucket)))
            two = start[n == 2]
            yield order[two], order[two + 1]
            for s, e in zip(start[n > 2], (start + n)[n > 2]):
                own = order[s:e]
                sizes = size[own]
                tops = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
                for k in range(len(own) - 1):
                    if tops[k] > k + 1:
                        yield np.full(tops[k] - k - 1, own[k]), own[k + 1 : tops[k]]

        def filtered():
            parts, n = [], 0
            for i, j in couples():
                hit = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == x_of[i]) & (x_of[i] == y_of[i])) & _can(size[i], place[i], size[j], place[j], similarity)
                if hit.any():
                    parts.append((i[hit], j[hit]))
                    n += int(hit.sum())
                if n > 1 << 15:
                    yield map(np.concatenate, zip(*parts))
                    parts, n = [], 0
            if parts:
                yield map(np.concatenate, zip(*parts))

        x_of, y_of = (table.column(c).to_numpy() for c in ("x", "y"))
        seen = np.zeros((0, 2), np.int64)
        for i, j in filtered():
            both = size[i] + size[j]
            hit = apart(i, j) <= both - 2 * _need(both, similarity)
            found = np.stack((np.minimum(rid[i], rid[j])[hit], np.maximum(rid[i], rid[j])[hit]), axis=1)
            seen = np.unique(np.concatenate((seen, found)), axis=0)
            if len(seen) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], ["a", "b"])
                seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], ["a", "b"])

    return run


def _named(live: DataFrame, tied: DataFrame) -> DataFrame:
    return live.join(small(tied.withColumnRenamed("node", "rid")), "rid", "left").select("bucket", "rid", "at", F.coalesce("component", "rid").alias("component"))


def _head_pairs(texts: DataFrame, live: DataFrame, tied: DataFrame, gram: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket's head, the text whose prefix has the largest share in common with others, and its members of another component.

    Only a help to tie large groups at little cost: such a pair must share enough of the buckets of which one of them is the head.
    """
    size = F.shiftright("at", 32)
    shares = cut(live.groupBy("rid", size.alias("size")).agg(F.count(F.lit(1)).alias("n")).select("rid", (F.col("n") / (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-6) + 1)).alias("share")))
    named = _named(live, tied)
    best = F.min(F.struct((-F.col("share")).alias("share"), "rid", "at", "component")).alias("h")
    heads = cut(named.join(small(shares), "rid").groupBy("bucket").agg(best, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "h.rid", "h.at", "h.component").toDF("bucket", "a", "a_at", "a_component"))
    met = named.join(small(heads), "bucket").where("component <> a_component")
    na, nb = F.shiftright("a_at", 32), F.shiftright("at", 32)
    both, most = na + nb, F.greatest(na, nb)
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * both - 1e-6) - F.ceil(F.lit(similarity) * most - 1e-6) + 1)
    fits = F.least(na, nb) >= F.lit(similarity) * most - 1e-6
    pairs = met.where(fits).select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"), need.alias("need"))
    out = cut(pairs.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("a", "b"))
    drop(shares, heads)
    return out


def _other_pairs(texts: DataFrame, live: DataFrame, tied: DataFrame, gram: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of different components in a bucket that may reach the similarity; a crowded bucket is compared block by block."""
    named = _named(live, tied)
    mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    mixed = cut(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("rid"), "blocks").cast("int")
    rows = cut(named.join(small(mixed), "bucket").withColumn("own", own))
    some = cut(rows.select("rid").distinct())
    marks = cut(texts.select("rid", "text").join(small(some), "rid", "left_semi").mapInArrow(released(_parities(gram)), "rid long, bits binary"))
    rows_of = rows.join(small(marks, SMALL_MARKS), "rid").select("bucket", "rid", "at", "component", "own", "bits", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows_of = rows_of.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own").alias("side"), "rid", "at", "component", "bits")
    dealt = rows_of.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    out = cut(dealt.mapInArrow(released(_met(similarity)), "a long, b long").distinct())
    drop(mixed, rows, some, marks)
    return out


def _completed(texts: DataFrame, edges: DataFrame, gram: int, similarity: float) -> DataFrame:
    """Components of all pairs that reach the similarity, of which the edges are some.

    Every pair that reaches the similarity shares a shingle of its prefixes. Members of such a bucket
    are compared with its head unless tied already; then all pairs not tied yet are, however many.
    """
    often, counts = _often(texts, gram)
    rows = texts.select("rid", "text").mapInArrow(released(_prefixes(gram, similarity, often, counts)), "bucket long, salt int, rid long, at long")
    w = Window.partitionBy("bucket", "salt")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "low": F.min("at").over(w), "high": F.max("at").over(w)})
    live = cut(rows.where((F.col("salt") > 0) | (F.col("n") > 2) | (F.col("n") == 2) & _possible(F.col("low"), F.col("high"), similarity)).select("bucket", "rid", "at"))
    tied, tested = components(edges), None
    for find in (_head_pairs, _other_pairs):
        pairs = find(texts, live, tied, gram, similarity)
        if tested is not None:
            fresh = cut(pairs.join(tested, ["a", "b"], "left_anti"))
            drop(pairs, tested)
            pairs = fresh
        tested = pairs
        if not pairs.isEmpty():
            edges = _linked(texts, pairs, edges, gram, similarity)
            old, tied = tied, components(edges)
            drop(old)
    drop(live, tested, edges)
    return tied


def near_components(texts: DataFrame, gram: int, radius: int, blocks: int, similarity: float) -> DataFrame:
    """texts: rid (long, one row for each), text. Components (node, component) of texts whose shingle sets reach the similarity.

    Every member of a bucket of fingerprints is compared with the bucket's smallest rid, which ties most
    members of large groups; pairs that are not tied by then are compared by `_completed`, without a cap.
    """
    pairs = _covered(texts, radius, blocks)
    edges = _linked(texts, pairs, None, gram, similarity)
    drop(pairs)
    return _completed(texts, edges, gram, similarity)


def _names(text: Column) -> list[Column]:
    """The 64-bit name of a text, and another hash that tells texts of one name apart."""
    return [F.xxhash64(text).alias("rid"), F.xxhash64(text, F.lit(1)).alias("check")]


def _told_apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """rows (rid, check, ...): different texts that share a name, which `clash` lists, get a name made of both hashes."""
    if clash is None:
        return rows
    met = rows.join(small(clash.select(F.col("rid").alias("clashing"))), F.col("rid") == F.col("clashing"), "left")
    return met.withColumn("rid", F.when(F.col("clashing").isNull(), F.col("rid")).otherwise(F.xxhash64("rid", "check"))).drop("clashing")


def near_dedup(docs: DataFrame, gram: int = NEAR_GRAM, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which each group of near-duplicates keeps one.

    The one that stays has the smallest doc_id (null last; then the smallest hash of its text).
    Exact copies are folded by two 64-bit hashes first; the row kept among repeated rows is any of them.
    Different texts of one 64-bit hash are told apart by the other before anything is compared.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["rid", "check", "id"]
    ids = [*_names(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id")]
    copies = cut(docs.select(*ids).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    clash = cut(copies.groupBy("rid").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("rid"))
    clash = None if clash.isEmpty() else clash
    copies = copies if clash is None else cut(_told_apart(copies, clash))
    least = cut(copies.groupBy("rid", "check").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("ids")).where("ids > 1"))
    more = cut(copies.join(least, ["rid", "check"]).where("id > least").select(*key))
    again = cut(copies.where("n > 1").select(*key))
    texts = _told_apart(docs.select(*ids, text.alias("text")), clash).join(small(more), key, "left_anti")
    if not again.isEmpty():
        texts = texts.join(small(again), key, "left_anti").union(texts.join(small(again), key, "left_semi").groupBy(*key).agg(F.first("text").alias("text")))
    comp = near_components(texts.select("rid", "text"), gram, radius, blocks, similarity)
    named = copies.groupBy("rid").agg(F.min("id").alias("id")).join(small(comp.withColumnRenamed("node", "rid")), "rid")
    first = named.groupBy("component").agg(F.min(F.struct("id", "rid")).alias("k")).select("component", F.col("k.rid").alias("kept"))
    lost = cut(named.join(first, "component").where("rid <> kept").select("rid"))
    gone = cut(copies.join(small(lost), "rid", "left_semi").select(*key).union(more))
    drop(copies, least, more, comp, lost)
    tagged = _told_apart(docs.select(F.struct("*").alias("row"), *ids), clash).join(small(gone), key, "left_anti")
    if again.isEmpty():
        return tagged.select("row.*")
    return tagged.join(small(again), key, "left_anti").select("row.*").union(tagged.join(small(again), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row.*"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
