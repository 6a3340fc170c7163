"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

There are as many lists as the square root of the number of vectors, up to MOST_LISTS. Coarse centroids and the codebooks of the residuals are
fitted on FIT_EACH vectors for each list (FIT_ROWS at least, so MOST_LISTS * FIT_EACH at most), the
first by a hash of the id; every vector is indexed: it goes to the list of its nearest centroid with
one code for each part of its residual. How many lists a query visits, those of its nearest centroids, is measured on the
sample: so many that COVERED of the true neighbours of some of its vectors lie in them. A table of distances from a query's residual
to all codes gives every entry's asymmetric distance; the `rerank` best of a block are measured on the original vectors, and the k nearest of
all blocks are the answer. A query that found fewer than k visits all lists.

Lists are stored in blocks of at most `block_rows`, so a list that holds a third of all vectors is many
blocks; a block is one packed row and meets packed queries by (list, block). Only centroids and
codebooks, of bounded size, are sent to every task. Vectors of each length have an index of their own.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors
meet only vectors of their own length; fewer than k candidates: all of them; equal distances: the smaller vec_id first;
repeated rows are candidates of their own, a query never meets rows of its own id; a distance beyond all doubles
is infinite; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mtree import EVERY, usable
from .util import cut, read, small

K, FIT_ROWS, FIT_EACH, MOST_LISTS, PARTS, CODES, RERANK, BLOCK_ROWS, QUERY_ROWS = 10, 8192, 32, 2048, 16, 64, 160, 2048, 128
#: Share of true neighbours that the lists visited must hold in the sample, and vectors of it that are asked.
COVERED, ASKED = 0.985, 256
#: Scaled components are cut here for the index (never for distances), so that no square overflows.
TOP = 1e140


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty cell takes the point that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = nearest(x, c)
        of = d.argmin(1)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        far = np.argsort(-d[np.arange(len(x)), of])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[far[: len(c)]][np.arange(len(c)) % len(far)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


class Quantiser:
    """Coarse centroids, one codebook for each part of the residuals, and the number of lists to visit. All of it on scaled vectors."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES, k: int = K):
        self.dim = sample.shape[1]
        self.parts = np.array_split(np.arange(self.dim), min(parts, self.dim))
        self.scale = 2.0 ** -np.frexp(max(float(np.median(np.abs(sample).max(1))), 1e-300))[1]
        sample = self.scaled(sample)
        self.coarse = kmeans(sample, max(1, min(lists, len(sample) // 8)))
        residual = sample - self.coarse[nearest(sample, self.coarse).argmin(1)]
        self.books = [kmeans(residual[:, p], codes) for p in self.parts]
        self.probes = self._probes(sample, k)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x * self.scale, -TOP, TOP)

    def order(self, q: np.ndarray) -> np.ndarray:
        """The lists in the order of their centroids' distance, for each row of q, scaled."""
        return np.argsort(nearest(q, self.coarse), axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, k: int) -> int:
        """Visits that find COVERED of the k nearest neighbours in the sample."""
        asked = np.arange(0, len(sample), max(1, len(sample) // ASKED))
        d = nearest(sample[asked], sample)
        d[np.arange(len(asked)), asked] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.coarse)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        of = nearest(sample, self.coarse).argmin(1)
        place = np.argsort(self.order(sample[asked]), axis=1)
        visits = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
        return int(visits[min(len(visits) - 1, int(np.ceil(COVERED * len(visits))))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.scaled(x)
        of = nearest(x, self.coarse).argmin(1)
        r = x - self.coarse[of]
        return of, np.stack([nearest(r[:, p], b).argmin(1) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, of: int) -> list[np.ndarray]:
        """For each part, the squared distances of each query's residual to the codes."""
        r = self.scaled(q) - self.coarse[of]
        return [nearest(r[:, p], b) for p, b in zip(self.parts, self.books)]


def euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x from q in double precision; where squares overflow or vanish, of scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        diff = x - q
        out = np.sqrt((diff**2).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            top = np.maximum(np.abs(x[odd]).max(1), np.abs(q).max())
            size = 2.0 ** -np.frexp(np.abs(x[odd] / 4 - q / 4).max(1))[1].astype(float)
            part = np.sqrt((((x[odd] / 4 - q / 4) * size[:, None]) ** 2).sum(1)) / size * 4
            out[odd] = np.where(top > 0, part, 0.0)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _assign(shared):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), shared.value.dim)
            of, codes = shared.value.encode(x)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["list", "vec_id", "codes", "x"])

    return run


def _probe(shared, probes: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), shared.value.dim)
            to = shared.value.order(shared.value.scaled(x))[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(to.tolist(), pa.list_(pa.int32()))], ["query_id", "q", "lists"])

    return run


def _packed(most: int, width: int):
    """Sorted rows (list, block, id, bytes...) as packed rows of at most `most`."""

    def run(batches):
        held: list[tuple] = []

        def out():
            columns = list(zip(*held))
            cells = [np.array(columns[2], np.int64).tobytes(), *(b"".join(c) for c in columns[3:])]
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["list", "block", "ids", "a", "b"][: 3 + width])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[:2] != held[0][:2] or len(held) >= most):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return run


def _search(shared, k: int, rerank: int):
    def run(batches):
        for b in batches:
            found = ([], [], [])
            for of, ids, codes, xs, q_ids, qs in zip(*(c.to_pylist() for c in b.columns)):
                m = shared.value
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                x, q = np.frombuffer(xs).reshape(-1, m.dim), np.frombuffer(qs).reshape(-1, m.dim)
                tables = m.tables(q, of)
                far = sum(t[:, codes[:, i]] for i, t in enumerate(tables))
                for j, own in enumerate(q_ids):
                    d = np.where(ids == own, np.inf, far[j])
                    # ties at the edge of the selection all stay
                    edge = np.partition(d, rerank)[rerank] if len(d) > rerank else np.inf
                    pick = np.flatnonzero((d <= edge) & (ids != own))
                    exact = euclidean(x[pick], q[j])
                    for p in np.lexsort((ids[pick], exact))[:k]:
                        for part, y in zip(found, (int(own), int(ids[pick[p]]), float(exact[p]))):
                            part.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def _visited(shared, index: DataFrame, sizes: DataFrame, queries: DataFrame, probes: int, k: int, rerank: int, query_rows: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest of each visited block."""
    asked = queries.select("vec_id", "x").mapInArrow(_probe(shared, probes), "query_id long, q binary, lists array<int>")
    asked = asked.select("query_id", "q", F.explode("lists").alias("list")).join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "q")
    asked = asked.repartition("list", "block", F.floor(F.col("query_id") / (EVERY * query_rows))).sortWithinPartitions("list", "block").mapInArrow(_packed(query_rows, 1), "list int, block int, ids binary, a binary")
    met = index.join(asked.select("list", "block", F.col("ids").alias("q_ids"), F.col("a").alias("qs")).hint("shuffle_hash"), ["list", "block"])
    return met.select("list", "ids", "a", "b", "q_ids", "qs").mapInArrow(_search(shared, k, rerank), "query_id long, vec_id long, score double")


def _ranked(local: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, rerank: int = RERANK, lists: int | None = None, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors, queries: vec_id (long), x (array<double>). query_id, rank, vec_id and score (distance) of the k nearest found; lists and probes are found from the vectors if not given."""
    spark = vectors.sparkSession
    counts = {r.n: r.rows for r in vectors.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    out = None
    for dim, rows in sorted(counts.items()):
        some, ask = (df.where(F.size("x") == dim) for df in (vectors, queries))
        cells = lists or max(1, min(MOST_LISTS, round(rows**0.5)))
        sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(fit_rows, FIT_EACH * cells)).select("x").toArrow()
        fitted = Quantiser(_matrix(sample.column("x").combine_chunks(), dim), cells, k=k)
        shared = spark.sparkContext.broadcast(fitted)
        entries = cut(some.select("vec_id", "x").mapInArrow(_assign(shared), "list int, vec_id long, codes binary, x binary"))
        sizes = small(cut(entries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))))  # one row for each list
        block = F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")).cast("int")
        index = entries.join(sizes, "list").select("list", block.alias("block"), "vec_id", "codes", "x").repartition("list", "block").sortWithinPartitions("list", "block")
        index = index.mapInArrow(_packed(2 * block_rows, 2), "list int, block int, ids binary, a binary, b binary")
        got = cut(_ranked(_visited(shared, index, sizes, ask, probes or fitted.probes, k, rerank, query_rows), k))
        short = cut(ask.select("vec_id").distinct().join(got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id"))
        if (probes or fitted.probes) < len(fitted.coarse) and not short.isEmpty():
            again = _ranked(_visited(shared, index, sizes, ask.join(small(short), "vec_id", "left_semi"), len(fitted.coarse), k, rerank, query_rows), k)
            got = got.join(small(short).withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(again)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out if len(counts) < 2 else _ranked(out.drop("rank"), k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    whole = table.where(F.col("vec_id").isNotNull() & usable(F.col("x")) & F.exists("x", lambda v: v != 0))
    return nearest_neighbours(whole, whole.where(F.col("vec_id") % EVERY == 0))
