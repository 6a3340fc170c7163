"""Readers of text files with line numbers; missing folders give empty relations.

Lines are read by Spark's splittable text source, so a file of any size is many tasks. A line's number is its place in its split, added to the lines
of the splits before it, which a first pass counts and a prefix scan over the splits of a file sums: one narrow row for each split. Both
passes are scans of one listing of the files, which fixes their lengths and splits; a number that does not fit its split raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.variant import ENDED, boxed, unboxed
from ..operators.filters import touched

WHOLE = "value string, file_path string, modified timestamp, source_rank int"
LINES = WHOLE + ", line_no int"
LISTED = "file_path string, modified timestamp, length long, source_rank int"


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Those glob patterns that match something, in any file system Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            out.append(p)
    return out


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in any file system Spark knows; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _folders(spark: SparkSession, pattern: str) -> list:
    """The paths of the folders that match a glob pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [] if found is None else [s.getPath() for s in found if s.isDirectory()]


def _each_base(spark: SparkSession, bases: list[str], pattern: str, recursive: bool, name: str | None, schema: str, load) -> DataFrame:
    """The union of what `load` (of a reader, paths and a condition on _metadata) gives for each base that exists, with source_rank, the position of the base.

    A pattern `/*/<name>` is listed by folders: a path for each file would make Spark look up every file by itself.
    """
    out = None
    for rank, base in enumerate(bases):
        reader, fits, paths = spark.read, F.lit(True), f"{base}{pattern}"
        if pattern.startswith("/*/") and "/" not in pattern[3:] and name is None and not recursive:
            folders = _folders(spark, f"{base}/*")
            if not folders:
                continue
            paths = [f.toString() for f in folders]
            deep = sorted({f.toUri().getPath().count("/") + 2 for f in folders})
            fits = F.size(F.split(F.regexp_replace("_metadata.file_path", "^[^/]*:(//[^/]*)?/", "/"), "/")).isin(deep)
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern[3:])
        elif not existing(spark, [paths]):
            continue
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        if name:
            reader = reader.option("pathGlobFilter", name)
        df = load(reader, paths, fits).withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def whole_files(spark: SparkSession, bases: list[str], pattern: str = "", recursive: bool = False, name: str | None = None) -> DataFrame:
    """value, file_path, modified and source_rank of each file, whole: for small files."""
    load = lambda reader, paths, fits: reader.text(paths, wholetext=True).where(fits).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"))
    return _each_base(spark, bases, pattern, recursive, name, WHOLE, load)


def listed_files(spark: SparkSession, bases: list[str], pattern: str = "", recursive: bool = False, name: str | None = None) -> DataFrame:
    """file_path, modified, length and source_rank of each file; no content is read."""
    load = lambda reader, paths, fits: reader.format("binaryFile").load(paths).where(fits).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length"))
    return _each_base(spark, bases, pattern, recursive, name, LISTED, load)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: value, file_path, modified, block, row (increasing within a split). Adds line_no, counted from 0 over the file, in place of block and row."""
    held = rows.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("row").alias("__first"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("file_path").alias("__path"), F.col("block").alias("__block"), "__n", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # one row for each split of the listing, which the driver holds anyway
    met = rows.join(F.broadcast(held), (F.col("file_path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    place = F.col("row") - F.col("__first")
    number = F.when(place.between(0, F.col("__n") - 1), F.col("__before") + place).otherwise(F.raise_error(F.concat(F.lit("splits changed while reading "), "file_path")))
    return met.select("value", "file_path", "modified", number.cast("int").alias("line_no"))


def file_lines(spark: SparkSession, bases: list[str], pattern: str = "", recursive: bool = False, name: str | None = None, since: Column | None = None) -> DataFrame:
    """value, file_path, modified, line_no and source_rank of each line of the files that were touched since; other files are not opened."""

    def load(reader, paths, fits):
        rows = reader.text(paths, lineSep="\n").where(fits).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"))
        return _numbered(rows.where(touched(F.col("modified"), since)).withColumn("row", F.monotonically_increasing_id()))

    return _each_base(spark, bases, pattern, recursive, name, LINES, load)


def json_lines(rows: DataFrame, since=None) -> DataFrame:
    """file_path, source_rank, line_no and v (a variant) of each line that is a JSON object; rows: lines, or whole files without line_no."""
    rows = rows.where(touched(F.col("modified"), since))
    if "line_no" not in rows.columns:
        rows = rows.select("file_path", "source_rank", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    # columns of generators: filters on fields of a projected column are pushed below it, and each field they name would parse the line again
    boxes = rows.where(F.col("value").rlike(ENDED)).select("file_path", "source_rank", "line_no", F.explode(F.array(boxed(F.col("value")))).alias("box"))
    return boxes.select("file_path", "source_rank", "line_no", F.explode(F.array(unboxed(F.col("box")))).alias("v")).where("v is not null")


def key_values(files: DataFrame) -> DataFrame:
    """Flat `key: value` files: file_path and kv, a map; one matching pair of quotes goes, the last duplicate wins."""
    line = files.select("file_path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.instr("line", ":") > 0)
    k = F.regexp_replace(F.substring_index("line", ":", 1), r"^\s+|\s+$", "")
    v = F.regexp_replace(F.col("line").substr(F.instr("line", ":") + 1, F.length("line")), r"^\s+|\s+$", "")
    v = F.when((F.length(v) >= 2) & v.rlike("(?s)^(\".*\"|'.*')$"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
    last = line.select("file_path", "pos", k.alias("k"), v.alias("v")).where("k <> ''").groupBy("file_path", "k").agg(F.max_by("v", "pos").alias("v"))
    kv = last.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return files.select("file_path").join(kv, "file_path", "left").select("file_path", F.coalesce("kv", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("kv"))
