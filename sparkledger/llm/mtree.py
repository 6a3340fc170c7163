"""Exact top-k by inner product: best-first search of M-trees.

Vectors are dealt by a hash of their id into shards of about `shard_rows`; each shard becomes one
M-tree, bulk-loaded into pages. The largest inner products of a query are its nearest vectors once
each vector x gets the extra coordinate sqrt(M^2 - |x|^2) and the query a zero, M the longest vector
of the shard: squared distance = |q|^2 + M^2 - 2 <q, x>. A page keeps its pivot, its covering radius and,
for each entry, the distance to the pivot. A block of queries goes through a tree together: pages are taken in the order of
their lowest bound over the block, a query takes part in a page only if its own bound allows, entries whose stored parent
distance rules them out for all of these are skipped before any computation (|d(q, pivot) - d(entry, pivot)| - radius > kth),
and the rest is one matrix product. Every query arrives with a first bound, its k-th score among `START_ROWS` vectors.
Bounds are relaxed by a relative slack and scores are exact integers, so pruning loses nothing, ties included.

Queries travel in blocks of `query_rows` as packed rows, once to each shard; shards answer with k rows
for each query, which a last ranking merges. Neither side is broadcast or collected, but for the START_ROWS vectors.

Defined results: null or empty vectors and those with null or non-finite components take no part; vectors
meet only vectors of their own length; fewer than k candidates: all of them; equal scores: the smaller
vec_id first; repeated rows are candidates of their own, but a query never meets rows of its own
id; scores are exact, and those beyond a long are ranked as they are and returned as the nearest long; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut, parts, read

K, SCALE, EVERY, SHARD_ROWS, QUERY_ROWS, PAGE = 10, 1024, 100, 8192, 256, 64
SLACK, EXACT, START_ROWS = 1e-9, 2.0**53, 512
_LOW, _HIGH = -(2**63), 2**63 - 1


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The integer inner products of rows of x and of q: int64 where doubles are exact, else Python integers."""
    top = (np.abs(x).max(initial=0) * np.abs(q).max(initial=0)) * x.shape[1]
    if top < EXACT:
        return (x @ q.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(x) @ whole(q).T if x.size and q.size else np.zeros((len(x), len(q)), object)


def _float(n: int) -> float:
    """n as a double; one beyond all doubles gives no bound."""
    try:
        return float(n)
    except OverflowError:
        return -np.inf


class Best:
    """The k best (score, vec_id) of each query of a block; ties to the smaller id."""

    def __init__(self, own: np.ndarray, k: int, floor: list):
        self.own, self.k, self.floor = own, k, floor
        self.rows: list[list[tuple]] = [[] for _ in own]
        self.kth = np.array([-np.inf if f is None else _float(f) for f in floor])

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray):
        """scores, allowed: entries by queries `who`."""
        good = allowed & (ids[:, None] != self.own[who][None])
        if scores.dtype == np.int64:  # exact as doubles; one that equals the bound may win by its id
            good &= scores >= self.kth[who][None]
        for j in np.flatnonzero(good.any(0)).tolist():
            i, at = int(who[j]), np.flatnonzero(good[:, j])
            new = [(-s, v) for s, v in zip(scores[at, j].tolist(), ids[at].tolist())]
            self.rows[i] = sorted(self.rows[i] + new)[: self.k]
            if len(self.rows[i]) == self.k:
                self.kth[i] = max(self.kth[i], _float(-self.rows[i][-1][0]))


class MTree:
    """A bulk-loaded M-tree over rows of x (integers as float64), its pages grouped under pivots in two levels."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        # distances are those of scaled vectors (by a power of two), so that no square overflows
        self.ids, self.x, self.scale = ids, x, 2.0 ** -np.frexp(np.abs(x).max(initial=1.0))[1]
        y = x * self.scale
        norm = (y * y).sum(1)
        self.longest = float(norm.max()) if len(x) else 0.0
        full = np.concatenate((y, np.sqrt(np.maximum(self.longest - norm, 0))[:, None]), axis=1)
        #: Inner products and distances computed, for all queries.
        self.computed = 0
        self.leaves = []  # (pivot, radius, rows, distances of the rows to the pivot)
        self._split(full, np.arange(len(x)), page)
        pivots = np.array([full[p] for p, *_ in self.leaves])
        self.inner = []  # (pivot, radius, leaf numbers, their distances to the pivot)
        self._group(pivots, np.arange(len(pivots)), max(8, int(len(pivots) ** 0.5)))
        self.pivots = pivots
        self.radii = np.array([r for _, r, *_ in self.leaves])
        self.roots = np.array([pivots[p] for p, *_ in self.inner])
        self.root_radii = np.array([r for _, r, *_ in self.inner])

    @staticmethod
    def _halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of equal size about two far pivots."""
        far = rows[np.argmax(((x[rows] - x[rows[0]]) ** 2).sum(1))]
        other = rows[np.argmax(((x[rows] - x[far]) ** 2).sum(1))]
        side = np.argsort(x[rows] @ (x[other] - x[far]), kind="stable")
        half = len(rows) // 2
        return rows[side[:half]], rows[side[half:]]

    @staticmethod
    def _medoid(x: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
        p = int(rows[np.argmin(((x[rows] - x[rows].mean(0)) ** 2).sum(1))])
        return p, np.sqrt(((x[rows] - x[p]) ** 2).sum(1))

    def _split(self, x, rows, page):
        todo = [rows] if len(rows) else []
        while todo:
            r = todo.pop()
            if len(r) > page:
                todo += self._halves(x, r)
                continue
            p, d = self._medoid(x, r)
            self.leaves.append((p, float(d.max()), r, d))

    def _group(self, x, rows, page):
        todo = [rows] if len(rows) else []
        radii = np.array([leaf[1] for leaf in self.leaves])
        while todo:
            r = todo.pop()
            if len(r) > page:
                todo += self._halves(x, r)
                continue
            p, d = self._medoid(x, r)
            self.inner.append((p, float((d + radii[r]).max()), r, d))

    @staticmethod
    def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """From each row of q to each row of p, which has one coordinate more."""
        square = (q * q).sum(1)[:, None] - 2 * q @ p[:, :-1].T + (p * p).sum(1)[None]
        return np.sqrt(np.maximum(square, 0))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: list | None = None) -> list[list[tuple[int, int]]]:
        """For each query, a row of a matrix with its id in `own`, the k best (score, vec_id); floor: scores that its k-th best is known to reach, or None."""
        best = Best(own, k, floor or [None] * len(own))
        if not self.inner or not len(own):
            return [[] for _ in own]
        # queries are scaled on their own: order and bounds of one query do not depend on the length of another
        size = 2.0 ** -np.frexp(np.maximum(np.abs(queries).max(1), 1.0))[1].astype(float)
        q = queries * size[:, None]
        qq = (q * q).sum(1)
        eps = 1e-7 * np.sqrt(qq + self.longest + 1e-300) + SLACK

        def reach(who):
            with np.errstate(over="ignore", invalid="ignore"):
                kth = np.where(np.isfinite(best.kth[who]), best.kth[who] * size[who] * self.scale, -np.inf)
            return np.sqrt(np.maximum(qq[who] + self.longest - 2 * kth, 0)) + eps[who]

        every = np.arange(len(own))
        to_root = self._distances(q, self.roots)
        self.computed += to_root.size
        low = to_root - self.root_radii[None]
        for i in np.argsort(low.min(0)).tolist():
            who = every[low[:, i] <= reach(every)]
            if not len(who):
                continue
            _, _, leaves, apart = self.inner[i]
            near = np.abs(to_root[who, i][:, None] - apart[None]) - self.radii[leaves][None] <= reach(who)[:, None]
            leaves, near = leaves[near.any(0)], near[:, near.any(0)]
            d = self._distances(q[who], self.pivots[leaves])
            self.computed += d.size
            least = np.where(near, d - self.radii[leaves][None], np.inf)
            for j in np.argsort(least.min(0)).tolist():
                some = least[:, j] <= reach(who)
                if not some.any():
                    continue
                _, _, rows, inside = self.leaves[leaves[j]]
                asked = who[some]
                allowed = np.abs(d[some, j][None] - inside[:, None]) <= reach(asked)[None]
                use = allowed.any(1)
                if use.any():
                    self.computed += int(use.sum()) * len(asked)
                    best.add(asked, self.ids[rows[use]], inner(self.x[rows[use]], queries[asked]), allowed[use])
        return [[(-s, v) for s, v in rows] for rows in best.rows]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _pack(column: str):
    """Rows of a partition that share `column`, sorted by it, as packed blocks of at most `most` rows."""

    def run(most: int):
        def blocks(batches):
            held: list[tuple] = []

            def out():
                ids = np.array([r[1] for r in held], np.int64)
                x = np.array([r[2] for r in held], np.float64)
                return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], [column, "dim", "ids", "vectors"])

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (row[0] != held[0][0] or len(held) >= most):
                        yield out()
                        held = []
                    held.append(row)
            if held:
                yield out()

        return blocks

    return run


def _search(k: int, shared):
    trees: dict = {}

    def first(q_ids: np.ndarray, q: np.ndarray) -> list:
        """The k-th score of each query among the shared vectors of its length."""
        ids, x = shared.value.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
        best = Best(q_ids, k, [None] * len(q))
        if len(ids):
            best.add(np.arange(len(q)), ids, inner(x, q), np.ones((len(ids), len(q)), bool))
        return [-rows[-1][0] if len(rows) == k else None for rows in best.rows]

    def run(batches):
        for b in batches:
            found = ([], [], [], [])
            for shard, dim, ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in b.columns)):
                key = (shard, hash(ids))
                if key not in trees:
                    trees.clear()
                    trees[key] = MTree(np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim))
                own, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dim)
                for i, rows in zip(own.tolist(), trees[key].search(own, q, k, first(own, q))):
                    for s, v in rows:
                        wide = None if _LOW < s < _HIGH else _ordered(s)
                        for part, y in zip(found, (i, v, min(max(s, _LOW), _HIGH), wide)):
                            part.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["query_id", "vec_id", "score", "wide"])

    return run


def _ordered(n: int) -> str:
    """A text of 701 digits that sorts as the integer does."""
    digits = str(abs(n)).zfill(700)
    return "1" + digits if n >= 0 else "0" + "".join(str(9 - int(c)) for c in digits)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, start_rows: int = START_ROWS) -> DataFrame:
    """vectors, queries: vec_id (long), x (array<double> of integers). query_id, rank, vec_id and score of each query's k best."""
    shards = parts(-(-vectors.count() // shard_rows))
    dim = F.size("x")
    kind = "shard string, dim int, ids binary, vectors binary"
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(start_rows).collect()
    start = {n: [r for r in sample if len(r.x) == n] for n in {len(r.x) for r in sample}}
    shared = vectors.sparkSession.sparkContext.broadcast({n: (np.array([r.vec_id for r in rows], np.int64), np.array([r.x for r in rows], np.float64).reshape(-1, n)) for n, rows in start.items()})
    dealt = vectors.select(F.concat_ws(":", dim, F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards))).alias("shard"), "vec_id", "x")
    packed = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_pack("shard")(4 * shard_rows), kind)
    asked = queries.select(dim.cast("string").alias("shard"), "vec_id", "x").repartition("shard", F.floor(F.col("vec_id") / (EVERY * query_rows))).sortWithinPartitions("shard").mapInArrow(_pack("shard")(query_rows), kind)
    asked = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.concat_ws(":", "shard", i))).alias("shard"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    local = packed.join(asked.hint("shuffle_hash"), "shard").select("shard", "dim", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(_search(k, shared), "query_id long, vec_id long, score long, wide string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("wide"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    table = table.where(usable(F.col("x")) & F.col("vec_id").isNotNull())
    whole = cut(table.select("vec_id", F.transform("x", _thousandths).alias("x")).where(usable(F.col("x"))))
    return top_k(whole, whole.where(F.col("vec_id") % EVERY == 0))


def _thousandths(v: Column) -> Column:
    """floor(SCALE * v) as a double; from 2^53 on a double has no fraction. Beyond all doubles it is infinite, and the vector takes no part."""
    y = F.lit(float(SCALE)) * v
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(1024.0::DOUBLE * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, least(greatest(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1]::HUGEINT * p[2]::HUGEINT)), -9223372036854775808::HUGEINT), 9223372036854775807::HUGEINT)::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
