"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm, longest first, and packed into buckets of `bucket_rows`, each of which knows its longest norm. Anchors are packed into blocks.
A product with an anchor is at most the product of both norms (Cauchy-Schwarz), so a bucket takes part in a search only if an anchor of the
block could reach its bound there: the k-th score known so far or, for a window of scores, the window's lower limit, whichever is more. A block
is sent only to the buckets whose longest norm allows it, by bounds that the START_ROWS longest vectors give; inside a bucket its pages are
taken from the longest norm down, the k-th scores rise, and the search ends at the first page that no bound allows. The scores of
a page are one matrix product.

Two searches run one after the other: an anchor's positives (its k best of the same label), then, with a window for each positive, the
negatives (the k best of another label whose score lies within the window). Buckets answer with k rows for each window, which a last ranking merges.

Defined results: rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; vectors meet only vectors of
their own length; an anchor never meets rows of its own id; equal rows are one anchor, but candidates of their own; different rows of one id are anchors of
their own; a positive score below zero has an empty window; fewer than k: all there are; scores are exact at any size, those beyond a long are ranked and
compared as they are and returned as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mtree import _float, _ordered, inner, usable
from .util import cut, parts, read

K, LOW, HIGH, SCALE, EVERY = 5, 80, 100, 256, 100
BUCKET_ROWS, PAGE_ROWS, BLOCK_ROWS, START_ROWS, SLACK = 8192, 1024, 512, 1024, 1e-9
_LONG, _EXACT = 2**63 - 1, 2.0**53
WINDOW = "array<struct<rank:int,id:long,score:long,wide:string>>"
FOUND = "key long, anchor_id long, window int, positive_id long, positive_score long, vec_id long, score long, wide string"


def _number(score: int, wide: str | None) -> int:
    """A score as it is, from its long and, beyond a long, its sortable text."""
    if wide is None:
        return score
    return int(wide[1:]) if wide[0] == "1" else -int("".join(str(9 - int(c)) for c in wide[1:]))


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


class Search:
    """The k best of each window of a block of anchors.

    windows: for each anchor the positives it has, as (rank, id, score, wide), each of which spans [ceil(low %), high %] of its score; same: search
    the anchor's own label, in one window without limits, instead of others.
    """

    def __init__(self, ids, labels, q, windows, k: int, same: bool, low: int = LOW, high: int = HIGH):
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, q, k, same
        self.norms = _norms(q)
        self.limits: list[list[tuple]] = []  # (lower, upper) of each window
        for w in windows:
            scores = [_number(s, wide) for _, _, s, wide in w]
            self.limits.append([(None, None)] if same else [(-(-low * p // 100), high * p // 100) for p in scores])
        self.best: list[list[list]] = [[[] for _ in w] for w in self.limits]
        self.low: list = [[a for a, _ in w] for w in self.limits]
        self._bounds(range(len(self.limits)))

    def _bounds(self, anchors) -> None:
        if not hasattr(self, "floor"):
            self.floor, self.top = np.empty(len(self.limits), object), np.empty(len(self.limits), object)
            self.bound = np.full(len(self.limits), np.inf)
        for i in anchors:
            low, high = self.low[i], [b for _, b in self.limits[i]]
            self.floor[i] = None if not low or None in low else min(low)
            self.top[i] = None if self.same or not high else max(high)
            self.bound[i] = np.inf if not low else -np.inf if self.floor[i] is None else _float(self.floor[i])

    def needed(self) -> np.ndarray:
        """The least norm of a vector that may matter to each anchor; infinite where nothing does."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            least = np.where(self.bound > 0, self.bound * (1 - SLACK) / (self.norms * (1 + SLACK)), 0.0)
        return np.where(np.isnan(least), 0.0, least)

    def page(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: float) -> bool:
        """Takes a page in; whether any anchor could still gain from vectors of norm `longest` or less."""
        who = np.flatnonzero((self.needed() <= longest) & (self.bound < np.inf))
        if not len(who):
            return False
        scores = inner(x, self.q[who])
        ok = ((labels[:, None] == self.labels[who][None]) == self.same) & (ids[:, None] != self.ids[who][None])
        if scores.dtype == np.int64:
            clamp = lambda values, none: np.array([none if v is None else min(max(v, -_LONG), _LONG) for v in values], np.int64)
            ok &= (scores >= clamp(self.floor[who], -_LONG)[None]) & (scores <= clamp(self.top[who], _LONG)[None])
        changed = []
        for j in np.flatnonzero(ok.any(0)).tolist():
            i, at = int(who[j]), np.flatnonzero(ok[:, j])
            rows = [(-s, v) for s, v in zip(scores[at, j].tolist(), ids[at].tolist())]
            for w, (_, high) in enumerate(self.limits[i]):
                low = self.low[i][w]
                new = [r for r in rows if (low is None or -r[0] >= low) and (high is None or -r[0] <= high)]
                if new:
                    self.best[i][w] = best = sorted(self.best[i][w] + new)[: self.k]
                    if len(best) == self.k and (low is None or -best[-1][0] > low):
                        self.low[i][w] = -best[-1][0]
                        changed.append(i)
        self._bounds(changed)
        return True

    def start(self, rows: tuple) -> None:
        """Bounds from the longest vectors, which their own buckets will give again."""
        ids, labels, x = rows
        for a in range(0, len(ids), PAGE_ROWS):
            self.page(ids[a : a + PAGE_ROWS], labels[a : a + PAGE_ROWS], x[a : a + PAGE_ROWS], np.inf)
        self.best = [[[] for _ in w] for w in self.limits]


def _pack_buckets(rows_each: int):
    """Rows in falling order of norm as buckets: number, dim, longest norm, ids, labels, vectors."""

    def run(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def out():
            x = np.array([r[3] for r in held], np.float64)
            cells = ((task << 40) + made, x.shape[1], float(_norms(x).max()), np.array([r[1] for r in held], np.int64).tobytes(), np.array([r[2] for r in held], np.int64).tobytes(), x.tobytes())
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["bucket", "dim", "longest", "ids", "labels", "vectors"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (row[0] != held[0][0] or len(held) >= rows_each):
                    yield out()
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield out()

    return run


def _start_rows(shared, dim: int):
    return shared.value.get(dim, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim))))


def _pack_blocks(rows_each: int, k: int, same: bool, limits: tuple[int, int], shared):
    """Anchors of one dim as blocks with the least norm that a bucket must have; anchors that nothing can matter to stay out."""

    def run(batches):
        held: list[tuple] = []

        def out():
            x = np.array([r[4] for r in held], np.float64)
            ids, labels = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64)
            windows = [[(w["rank"], w["id"], w["score"], w["wide"]) for w in r[5] or []] for r in held]
            search = Search(ids, labels, x, windows, k, same, *limits)
            search.start(_start_rows(shared, x.shape[1]))
            least = float(search.needed().min())
            cells = (x.shape[1], least, [r[1] for r in held], ids.tobytes(), labels.tobytes(), x.tobytes(), [r[5] or [] for r in held])
            window = pa.list_(pa.struct([("rank", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("wide", pa.string())]))
            kinds = (pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(window))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["dim", "least", "keys", "q_ids", "q_labels", "q_vectors", "windows"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and (row[0] != held[0][0] or len(held) >= rows_each):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return run


def _mine(k: int, same: bool, limits: tuple[int, int], shared):
    def run(batches):
        for b in batches:
            found: tuple[list, ...] = tuple([] for _ in range(8))
            for dim, ids, labels, vectors, keys, q_ids, q_labels, q_vectors, windows in zip(*(c.to_pylist() for c in b.columns)):
                ids, labels, x = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors).reshape(-1, dim)
                own = np.frombuffer(q_ids, np.int64)
                windows = [[(w["rank"], w["id"], w["score"], w["wide"]) for w in r] for r in windows]
                search = Search(own, np.frombuffer(q_labels, np.int64), np.frombuffer(q_vectors).reshape(-1, dim), windows, k, same, *limits)
                search.start(_start_rows(shared, dim))
                norms = _norms(x)
                for a in range(0, len(ids), PAGE_ROWS):
                    if not search.page(ids[a : a + PAGE_ROWS], labels[a : a + PAGE_ROWS], x[a : a + PAGE_ROWS], float(norms[a:].max())):
                        break
                for i, per_window in enumerate(search.best):
                    for w, rows in enumerate(per_window):
                        of = (0, None, None) if same else windows[i][w][:3]
                        for s, v in rows:
                            s = -s
                            wide = None if -_LONG < s < _LONG else _ordered(s)
                            for part, y in zip(found, (keys[i], int(own[i]), *of, v, min(max(s, -_LONG - 1), _LONG), wide)):
                                part.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def buckets(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """vectors: vec_id, label, x, dim, norm. Packed buckets in falling order of norm; vectors of equal norm are dealt by id."""
    n = parts(-(-vectors.count() // bucket_rows))
    order = [F.col("dim"), F.desc("norm"), F.col("vec_id")]
    ranged = vectors.select("dim", "vec_id", "label", "x", "norm").repartitionByRange(n, *order).sortWithinPartitions(*order).select("dim", "vec_id", "label", "x")
    return cut(ranged.mapInArrow(_pack_buckets(bucket_rows), "bucket long, dim int, longest double, ids binary, labels binary, vectors binary"))


def _searched(held: DataFrame, asked: DataFrame, shared, k: int, same: bool, limits: tuple[int, int], block_rows: int) -> DataFrame:
    """held: buckets; asked: dim, key, vec_id, label, x, windows. The k best rows of each window, ranked, with the columns of FOUND and rank."""
    blocks = asked.repartition("dim", F.floor(F.pmod(F.col("key"), F.lit(1 << 20)) / 256)).sortWithinPartitions("dim").mapInArrow(
        _pack_blocks(block_rows, k, same, limits, shared), f"dim int, least double, keys array<long>, q_ids binary, q_labels binary, q_vectors binary, windows array<{WINDOW}>"
    )
    # one number for each bucket
    tops = held.groupBy("dim").agg(F.collect_list(F.struct("longest", "bucket")).alias("tops"))
    sent = cut(blocks).join(tops, "dim").withColumn("bucket", F.explode(F.transform(F.filter("tops", lambda t: t["longest"] >= F.col("least")), lambda t: t["bucket"]))).drop("tops", "dim", "least")
    met = held.join(sent.hint("shuffle_hash"), "bucket").select("dim", "ids", "labels", "vectors", "keys", "q_ids", "q_labels", "q_vectors", "windows")
    local = met.mapInArrow(_mine(k, same, limits, shared), FOUND)
    rank = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), F.desc_nulls_last("wide"), "vec_id"))
    return local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k_positive: int = K, k_negative: int = K, low: int = LOW, high: int = HIGH, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors, anchors: vec_id (long), label (long), x (array<double> of integers), all usable.

    anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's negatives in the window of each of its positives:
    low % to high % of the positive's score.
    """
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    full = vectors.select("vec_id", "label", "x", F.size("x").alias("dim"), norm.alias("norm"))
    held = buckets(full, bucket_rows)
    sample = full.orderBy(F.desc("norm"), "vec_id").limit(START_ROWS).collect()
    start = {d: [r for r in sample if r.dim == d] for d in {r.dim for r in sample}}
    shared = vectors.sparkSession.sparkContext.broadcast({d: (np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), np.array([r.x for r in rows], np.float64).reshape(-1, d)) for d, rows in start.items()})
    asked = cut(anchors.select(F.size("x").alias("dim"), F.xxhash64("vec_id", "label", "x").alias("key"), "vec_id", "label", "x").dropDuplicates(["key"]))
    limits = (low, high)
    positives = cut(_searched(held, asked.withColumn("windows", F.lit(None).cast(WINDOW)), shared, k_positive, True, limits, block_rows))
    windows = positives.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score", "wide"))).cast(WINDOW).alias("windows"))
    mined = _searched(held, asked.join(windows, "key").select("dim", "key", "vec_id", "label", "x", "windows"), shared, k_negative, False, limits, block_rows)
    return mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _scaled(v: Column) -> Column:
    """floor(SCALE * v) as a double; from 2^53 on a double has no fraction."""
    y = F.lit(float(SCALE)) * v
    return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    table = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = cut(table.select("vec_id", label.alias("label"), F.transform("x", _scaled).alias("x")).where(usable(F.col("x"))))
    return hard_negatives(whole, whole.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256.0::DOUBLE * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1]::HUGEINT * p[2]::HUGEINT))::BIGINT AS score
  FROM whole a JOIN whole c ON c.vec_id <> a.vec_id AND len(c.x) = len(a.x) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER mine)::INTEGER AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW mine AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER mine <= 5
"""
