"""Substring dedup with compressed FM-indexes over content shards.

Every window of `window` words belongs to one anchor, its smallest `gram`-word hash, so equal windows
have equal anchors. Windows under one anchor that stand side by side form a segment, also in text
that repeats itself; a segment has LONGEST windows at most. Anchors are counted with map-side combining; a segment whose
anchor stands nowhere else cannot hold a repeated window, the others meet by anchor
in shards. A shard indexes its distinct segments (wavelet matrix over the Burrows-Wheeler
transform, suffix counts weighted by the copies of a segment), and the windows of the same segments are streamed
through backward search, which starts from the suffix interval of a window's last words (32 for windows of 35), kept
from the sort, and whose matching statistics tell which windows occur again. An anchor with
more than `shard_rows` segments is dealt over several shards by a hash of the segment; the windows that are single in such a
shard then meet once more by anchor and their own digest, so nothing is capped and no shard is unbounded.

Inside an index segments and words are compared as they are; hashes of words (XXH64) only choose the anchors. Windows of dealt anchors that
are single in their shard meet by a 128-bit BLAKE2 digest of their words, rows by two 64-bit hashes.

Defined results: null or empty text has 0 words, nothing removed and the digest of the empty
string; fewer words than a window: nothing removed; repeated rows are copies of each other, so
their windows are removed from each of them; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut, drop, mix, read, run_hashes, small, word_hashes

WINDOW, GRAM, SHARD_ROWS, INDEX_WORDS, LONGEST, QUERIES = 35, 8, 4096, 1_200_000, 512, 1 << 16


class FMIndex:
    """FM-index of sequences of integers from 1; each sequence ends in a separator of its own.

    Suffixes are sorted by their first `depth` symbols or more, which is enough for patterns of that length.
    For each position the suffix interval of the `known` symbols that begin there is kept from the sort, so
    that a search starts with an interval of so many symbols (a table of k-mers).
    """

    def __init__(self, text: np.ndarray, offsets: np.ndarray, weights: np.ndarray, depth: int):
        """text: symbols, 0 at each separator; offsets: start of each sequence; weights: copies of each."""
        n, k = len(text), len(offsets)
        self.text, self.n = text, n
        self.known = 1 << (depth.bit_length() - 1)
        seps = np.flatnonzero(text == 0)
        first = text + (k - 1)
        first[seps] = np.arange(k)
        sa, self.lo, self.hi = self._sort(first, self.known, depth)
        bwt = text[sa - 1]
        sigma = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        which = np.repeat(np.arange(k), np.diff(np.append(offsets, n)))
        self.weight = np.concatenate(([0], np.cumsum(weights[which[sa]])))
        self.levels = max(1, (sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))[:-1])
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))
        symbols = np.arange(sigma)
        self.base = self._down(symbols, np.zeros(sigma, np.int64))

    @staticmethod
    def _sort(first: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling of what is not in order yet, and the interval of each position's first `known` symbols.

        A suffix's rank is the place where the run of its equals begins.
        """
        n, h = len(first), 1
        sa = np.argsort(first)
        open_, key = np.arange(n), first[sa]
        rank, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo = hi = None
        while True:
            if len(open_):
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                size = np.diff(np.append(start, len(key)))
                i = sa[open_]
                rank[i] = np.repeat(open_[start], size)
                end[i] = np.repeat(open_[start] + size, size)
                open_ = open_[np.repeat(size, size) > 1]
            if h == known:
                lo, hi = rank.copy(), end.copy()
            if h >= depth:
                return sa, lo, hi
            i = sa[open_]
            key = rank[i] * (n + 1) + np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
            order = np.argsort(key)
            sa[open_], key = i[order], key[order]
            h *= 2

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            inside = self.bits[k][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones[k][at] + np.bitwise_count(inside)
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one symbol is put before each pattern."""
        both = self._down(np.concatenate((c, c)), np.concatenate((lo, hi)))
        shift = self.before[c] - self.base[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def reach(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics: for each query the smallest j >= start such that text[j:end] occurs at least twice, or end if its last `known` symbols do not."""
        j = end - self.known
        lo, hi = self.lo[j], self.hi[j]
        act = np.flatnonzero(self.weight[hi] - self.weight[lo] >= 2)
        out = end.copy()
        out[act] = j[act]
        lo, hi = lo[act], hi[act]
        while True:
            more = out[act] > start[act]
            act, lo, hi = act[more], lo[more], hi[more]
            if not act.size:
                return out
            lo, hi = self.step(self.text[out[act] - 1], lo, hi)
            again = self.weight[hi] - self.weight[lo] >= 2
            act, lo, hi = act[again], lo[again], hi[again]
            out[act] -= 1

    def repeated(self, start: np.ndarray, window: int) -> np.ndarray:
        """Whether the windows that begin at these positions occur at least twice."""
        return np.concatenate([np.zeros(0, bool)] + [self.reach(p, p + window) == p for p in np.split(start, range(QUERIES, len(start), QUERIES))])


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a document's word hashes: anchor hash, first window and number of windows of each segment, and whether its anchor stands in it twice."""
    wins = len(h) - window + 1
    g, span = run_hashes(h, gram), window - gram + 1
    best, width = np.arange(len(g)), 1
    while width < span:
        hop = min(width, span - width)
        a, b = best[: len(best) - hop], best[hop:]
        best, width = np.where(g[b] < g[a], b, a), width + hop
    best = best[:wins]
    value = g[best]
    change = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    inside = np.arange(wins) - np.repeat(change, np.diff(np.append(change, wins)))
    begin = np.flatnonzero(inside % LONGEST == 0)
    n = np.diff(np.append(begin, wins))
    # a run cut at LONGEST windows has its anchor twice, for no anchor stays in so many windows
    return value[begin], begin, n, best[begin] != best[begin + n - 1]


def _emit_anchors(window: int, gram: int):
    def run(batches):
        for b in batches:
            out = []
            for key, key2, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())):
                words = t.as_py().split()
                if len(words) >= window:
                    a, *rest = _anchors(word_hashes(words), window, gram)
                    out.append((np.full(len(a), key), np.full(len(a), key2), a.view(np.int64), *rest))
            if out:
                k, k2, a, f, n, twice = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), pa.array(a), pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(twice)], ["key", "key2", "anchor", "first", "n", "twice"])

    return run


def _emit_segments(window: int):
    def run(batches):
        for b in batches:
            texts = b.column(3).cast(pa.binary())
            rows = {x: [] for x in ("anchor", "part", "key", "key2", "first", "n", "words")}
            for key, key2, t, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b.column(4).to_pylist()):
                words = t.as_py().split()
                for g in segs:
                    f, n = g["first"], g["n"]
                    for name, v in zip(rows, (g["anchor"], g["part"], key, key2, f, n, b" ".join(words[f : f + n + window - 1]))):
                        rows[name].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    return run


def _windows(words: bytes, window: int) -> list[bytes]:
    """Each run of `window` words of words joined by single spaces."""
    edge = [-1, *(m.start() for m in re.finditer(b" ", words)), len(words)]
    return [words[i + 1 : j] for i, j in zip(edge, edge[window:])]


def _search(rows: list[tuple], window: int):
    """Intervals of repeated windows for the segments of one index: key, key2, lo, hi, anchor, hashes, known. Segments and words are compared as they are."""
    anchor, part, key, key2, first, n, words = zip(*rows)
    anchor, part, key, key2, first, n = (np.array(x, np.int64) for x in (anchor, part, key, key2, first, n))
    seen: dict[tuple, int] = {}
    number: dict[bytes, int] = {}
    symbols = []
    inverse = np.empty(len(words), np.int64)
    for i, name in enumerate(zip(anchor.tolist(), part.tolist(), words)):
        inverse[i] = k = seen.setdefault(name, len(symbols))
        if k == len(symbols):
            split = name[2].split(b" ")
            symbols.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in split), np.int64, len(split)))
    count = np.bincount(inverse)
    pick = np.unique(inverse, return_index=True)[1]
    lens = (n + window - 1)[pick]
    start = np.cumsum(lens + 1) - (lens + 1)
    text = np.zeros(int((lens + 1).sum()), np.int64)
    for at, x in zip(start.tolist(), symbols):
        text[at : at + len(x)] = x
    # runs of repeated windows in each distinct segment, then for each of its copies
    wins = n[pick]
    inner = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
    seg = np.repeat(np.arange(len(pick)), wins)
    hit = FMIndex(text, start, count, window).repeated(np.repeat(start, wins) + inner, window)
    opens = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (seg[1:] != seg[:-1]))))
    closes = np.flatnonzero(hit & np.concatenate((~hit[1:] | (seg[1:] != seg[:-1]), [True])))
    runs = np.bincount(seg[opens], minlength=len(pick))
    at = np.cumsum(runs) - runs

    def spread(counts, begins):
        """For each row, the entries of its segment: row number and entry number."""
        c = counts[inverse]
        r = np.repeat(np.arange(len(inverse)), c)
        return r, np.repeat(begins[inverse], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)

    r, i = spread(runs, at)
    lo, hi = first[r] + inner[opens[i]], first[r] + inner[closes[i]]
    own = mix(key[r].view(np.uint64) + mix(lo.view(np.uint64))).view(np.int64)
    out = [(key[r], key2[r], lo, hi, own, own, own, np.ones(len(r), bool))]
    if (part >= 0).any():
        # windows of dealt anchors meet those of other parts by a digest of their words
        dealt = np.flatnonzero(part[pick] >= 0)
        digest = b"".join(hashlib.blake2b(w, digest_size=16).digest() for k in dealt.tolist() for w in _windows(words[pick[k]], window))
        wh = np.zeros((len(seg), 2), np.int64)
        wh[part[pick][seg] >= 0] = np.frombuffer(digest, "<i8").reshape(-1, 2)
        in_split = part[pick][seg] >= 0
        again = np.flatnonzero(hit & in_split)
        met = np.unique(np.column_stack((anchor[pick[seg[again]]], wh[again])), axis=0)
        single = np.flatnonzero(~hit & in_split)  # in one segment without copies, so of one row
        row = pick[seg[single]]
        pos = first[row] + inner[single]
        out.append((key[row], key2[row], pos, pos, anchor[row], wh[single, 0], wh[single, 1], np.zeros(len(row), bool)))
        none = np.full(len(met), -1, np.int64)
        out.append((none, none, none, none, met[:, 0], met[:, 1], met[:, 2], np.ones(len(met), bool)))
    return [np.concatenate(x) for x in zip(*out)]


FOUND = ["key", "key2", "lo", "hi", "anchor", "wh", "wh2", "known"]


def _index_shards(window: int, index_words: int):
    def result(rows):
        return pa.RecordBatch.from_arrays(list(map(pa.array, _search(rows, window))), FOUND)

    def run(batches):
        rows, words, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if words >= index_words and row[:2] != last:
                    yield result(rows)
                    rows, words = [], 0
                rows.append(row)
                words += row[5] + window - 1
                last = row[:2]
        if rows:
            yield result(rows)

    return run


def _apply(window: int):
    def run(batches):
        for b in batches:
            total, removed, digest = [], [], []
            for t, spans in zip(b.column(3).cast(pa.binary()), b.column(4).to_pylist()):
                words = (t.as_py() or b"").split()
                if spans:
                    keep = np.zeros(len(words) + 1, np.int64)
                    at = np.array([(x["lo"], x["hi"] + window) for x in spans])
                    np.add.at(keep, at[:, 0], 1)
                    np.add.at(keep, at[:, 1], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
                else:
                    kept = words
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(b" ".join(kept))
            sha = [hashlib.sha256(x).hexdigest() for x in digest]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(digest, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text for every row of docs (doc_id, text)."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id", F.lit(gram)).alias("key2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = cut(keyed.where("text is not null").select("key", "key2", "text").mapInArrow(_emit_anchors(window, gram), "key long, key2 long, anchor long, first long, n int, twice boolean"))
    met = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("copies"), F.bool_or("twice").alias("twice")).where("copies > 1 or twice").select("anchor", "copies"))
    # a crowded anchor is dealt over parts by a hash of the segment; -1: the only part
    parts = F.ceil(F.col("copies") / shard_rows)
    part = F.when(parts > 1, F.pmod(F.xxhash64("key", "first"), parts)).otherwise(-1).cast("int")
    of_doc = cut(anchors.join(small(met), "anchor").groupBy("key", "key2").agg(F.collect_set(F.struct("first", "n", "anchor", part.alias("part"))).alias("segs")))
    drop(anchors, met)
    # the same columns as in the last join, so that both share one shuffle of the texts
    segments = keyed.join(of_doc.hint("shuffle_hash"), ["key", "key2"]).select("key", "key2", "doc_id", "text", "segs").mapInArrow(_emit_segments(window), "anchor long, part int, key long, key2 long, first long, n int, words binary")
    found = segments.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_index_shards(window, index_words), "key long, key2 long, lo long, hi long, anchor long, wh long, wh2 long, known boolean")
    again = found.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("anchor", "wh", "wh2"))).where("lo >= 0 and (known or met > 1)")
    spans = again.groupBy("key", "key2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return keyed.join(spans.hint("shuffle_hash"), ["key", "key2"], "left").select("key", "key2", "doc_id", "text", "spans").mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
