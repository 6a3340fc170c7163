"""Helpers shared by the training-data operators: shared storage, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

#: The words of a text, as the contracts define them.
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch where the session names no number: texts are long, and workers hold whole batches.
BATCH_ROWS, _BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch, unless the session has a number of its own."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and everything runs on one machine (tests)."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends here and lost executors cost nothing."""
    at = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by `cut` that nothing reads any more."""
    for df in tables:
        if (at := getattr(df, "_cut_at", None)) is not None:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys that may be broadcast; more are joined by a shuffle.
SMALL_ROWS = 250_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df, already cut, hinted as the broadcast side if it has at most `limit` rows, else as the build side of a shuffled hash join."""
    return F.broadcast(df) if df.count() <= limit else df.hint("shuffle_hash")


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64, or their inverses."""
    name = "inv" if inverse else "pow"
    have = _POW.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), _PINV if inverse else _P, dtype=np.uint64)
        steps[0] = 1
        _POW[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k consecutive entries of h. Equal runs have equal hashes; unequal ones may, so it only deals and orders."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(len(h)), dtype=np.uint64, out=acc[1:])
    return mix((acc[k:] - acc[:-k]) * powers(len(h), True)[: len(h) - k + 1])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps, each cut in the shared folder. A hub's edges are
    aggregated by minimum with map-side combining. The minima are broadcast while the edges are at most
    SMALL_ROWS; beyond that they are cut, so that both sides of the join come from plain shuffles, which AQE may
    split. No group is gathered in one place and nothing but two counters reaches the driver.
    """

    def least(rows: DataFrame, n: int, made: list) -> DataFrame:
        out = rows.groupBy("u").agg(F.min("v").alias("m"))
        if 2 * n <= SMALL_ROWS:
            return F.broadcast(out)
        made.append(cut(out))
        return made[-1]

    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = cur.agg(F.count(F.lit(1)), total).first()
    for _ in range(max_rounds):
        if not was[0]:
            break
        made: list = []
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both, was[0], made).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if 2 * was[0] > SMALL_ROWS:
            made.append(large := cut(large))
        first = least(large, was[0], made)
        star = large.join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(first.select("u", F.col("m").alias("v"))).distinct()
        made.append(cur)
        cur = cut(star)
        drop(*made)
        now = cur.agg(F.count(F.lit(1)), total).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v"), F.col("v")).distinct())
    out._cut_at = cur._cut_at
    return out


def open_fs(uri: str):
    """The file system and the path of a URI, for executors' Python: local, HDFS and object stores."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names) -> list[Column]:
    return [column(n) for n in names]


def beside(df: DataFrame, names: list[str], extra: list[Column], run, added: list[StructField]) -> DataFrame:
    """The columns `names` of df, of any names and types, and those that a batch function adds.

    The function gets batches of the columns and then `extra`, and gives the columns back (also of fewer rows at a time) and then `added`. On the way all
    go by place, since Arrow functions resolve names that hold dots or backticks wrongly.
    """
    kept = df.select(*columns(names))
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept.schema.fields, *added])]
    places = [f.name for f in fields]

    def by_place(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b, places)

    asked = df.select(*(column(n).alias(f"c{i}") for i, n in enumerate(names)), *(c.alias(f"x{i}") for i, c in enumerate(extra)))
    return asked.mapInArrow(by_place, StructType(fields)).toDF(*names, *(f.name for f in added))


def unused(name: str, names: list[str]) -> str:
    """A column name that none of the names equals, whatever their case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(n: int, most: int = 4096) -> int:
    """Partitions for n work items."""
    return max(1, min(n, most))


def released(run):
    """A batch function after which a reused Python worker gives its free memory back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
