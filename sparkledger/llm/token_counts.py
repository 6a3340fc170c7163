"""Token counts by a separator scan of flat token files that have no index.

A token file is a run of little-endian unsigned integers in which one id ends each document. The
scan reads fixed blocks of any file in any order, finds the separators of a block with one vector
comparison and reports, for each block, the tokens before its first separator, the lengths between
separators and the tokens after the last one. A prefix scan over the blocks of a file (window
functions over one narrow row for each block) then numbers the documents and adds what earlier
blocks left open, however many blocks a document spans.

Defined results: an empty document has 0 tokens; tokens after the last separator of a file count as
one more document; an empty file has none; null texts are written as empty ones; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut, open_fs, parts, read, scratch

BLOCK_BYTES, EOD = 1 << 22, 50256
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, kept for each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, eod: int = EOD) -> DataFrame:
    """Writes a flat file of two-byte ids for each task; rows (file, path, base, doc_ids, bytes), one for each batch.

    The name of a file is new for each attempt of a task, so an attempt that is lost leaves at most
    a file that no row names. The rows are cut: files are written once.
    """

    def run(batches):
        enc, out, count, size = encoder(tokenizer), None, 0, 0
        name = uuid.uuid4()
        path, number = f"{folder}/{name.hex}.bin", name.int >> 65
        for b in batches:
            if out is None:
                fs, at = open_fs(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(at)
            for t in b.column(1):
                ids = np.array(enc.encode_ordinary(t.as_py() or ""), dtype="<u2")
                out.write(ids.tobytes() + eod.to_bytes(2, "little"))
                size += 2 * len(ids) + 2
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([count]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([size])], ["file", "path", "base", "doc_ids", "bytes"])
            count += b.num_rows
        if out is not None:
            out.close()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file long, path string, base long, doc_ids array<long>, bytes long"))


def _scan(eod: int, dtype: str):
    def run(batches):
        for b in batches:
            rows = []
            for path, begin, size in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    f.seek(begin)
                    tokens = np.frombuffer(f.read(size), dtype=dtype)
                at = np.flatnonzero(tokens == eod)
                if len(at):
                    rows.append((len(at), int(at[0]), int(len(tokens) - at[-1] - 1), np.diff(at) - 1))
                else:
                    rows.append((0, len(tokens), len(tokens), np.zeros(0, np.int64)))
            n, head, tail, inner = zip(*rows)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), *(pa.array(x, k) for x, k in zip((n, head, tail, inner), kinds))], ["file", "block", "final", "n", "head", "tail", "inner"])

    return run


def token_counts(files: DataFrame, eod: int = EOD, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files: distinct file (long), path, bytes. Rows (file, ordinal, n_tokens), one for each document."""
    block_bytes -= block_bytes % np.dtype(dtype).itemsize
    count = F.ceil(F.col("bytes") / block_bytes)
    blocks = files.where("bytes > 0").select("file", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    blocks = blocks.select("file", "block", "path", (F.col("block") * block_bytes).alias("begin"), F.lit(block_bytes).alias("size"), ((F.col("block") + 1) * block_bytes >= F.col("bytes")).alias("final"))
    total = files.agg(F.sum(count)).first()[0] or 0
    seen = blocks.repartition(parts(int(total))).mapInArrow(_scan(eod, dtype), "file long, block long, final boolean, n long, head long, tail long, inner array<long>")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("n") > 0
    seen = seen.withColumn("ordinal", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("part", F.coalesce(F.sum(has.cast("int")).over(w), F.lit(0))).withColumn("open", F.last(F.when(has, F.col("tail")), ignorenulls=True).over(w))
    w = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("carry", F.coalesce("open", F.lit(0)) + F.coalesce(F.sum(F.when(~has, F.col("tail"))).over(w), F.lit(0)))
    none = F.array().cast("array<bigint>")
    rest = F.when(has, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    lengths = F.concat(F.when(has, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(none), F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(none))
    return seen.select("file", "ordinal", F.posexplode(lengths)).select("file", (F.col("ordinal") + F.col("pos")).alias("ordinal"), F.col("col").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, from token files written first and then scanned."""
    written = write_token_files(read(spark, sf_dir, "documents"), scratch(spark, "tokens"))
    counts = token_counts(written.groupBy("file", "path").agg(F.max("bytes").alias("bytes")))
    ids = written.select("file", "base", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("base") + F.col("pos")).alias("ordinal"), "doc_id")
    return counts.join(ids.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
