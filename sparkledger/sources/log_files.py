"""Lines written as log files, one file for each path, in any file system that Arrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log_source import _open_fs

WRITTEN = "path string, lines long"


def _written(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_fs(base)
        at = out = held = None
        lines, done, made = 0, [], set()

        def ended():
            out.close()
            system.move(held, f"{root}/{at}")
            done.append((at, lines))

        for b in batches:
            for path, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != at:
                    if out is not None:
                        ended()
                    folder, _, name = f"{root}/{path}".rpartition("/")
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    at, lines, held = path, 0, f"{folder}/.{name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(held)
                out.write((value or "").encode() + b"\n")
                lines += 1
        if out is not None:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "lines"])

    return run


def write_lines(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Writes rows (path, value, and the columns of `order`) as files below base; path and lines of each file, from one run of the job.

    A task sorts its files' lines, holds one batch, and moves each file into place when it is whole: readers skip the hidden names
    of unfinished ones, and a repeated task writes the same file again. A null path or an empty table writes nothing, a null value is
    an empty line, and lines of equal order come in any order.
    """
    kept = rows.where("path is not null").repartition("path").sortWithinPartitions("path", *order)
    got = kept.select(F.col("path").cast("string"), F.col("value").cast("string")).mapInArrow(_written(base), WRITTEN)
    spark = rows.sparkSession
    at = f"{base.rstrip('/')}-written"
    got.write.parquet(at)
    return spark.read.schema(WRITTEN).parquet(at)
