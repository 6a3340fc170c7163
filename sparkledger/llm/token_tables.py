"""Token ids as Parquet list columns, in document order, made for selective reads.

Documents are dealt by ranges of doc_id, sorted within a range, encoded in Arrow batches and written by Spark's Parquet
writer, one file for each range. A row is (doc_id, part, offset, n_tokens, ids): `part` numbers the files in
ascending order, `offset` counts the ids of the earlier documents of the file. The ids are dictionary encoded, the
columns of integers delta encoded; row groups and pages have set sizes and every page has its place in the page
indexes, so that a reader of the metadata columns opens no page of ids and a reader of a range of documents or of token positions
opens the pages that hold it. `token_index` reads the metadata alone and gives the first position of each file.

Encoding: for byte-level tokenizers with the usual pattern a text falls into pieces before each single space or line end
that stands between two other characters, and before a sentence mark after a letter: the pattern always begins a match there, so
the ids of a text are those of its pieces in order. The distinct pieces of
a batch are found by one dictionary encoding, those not met before are encoded by the library in long runs and told apart by the
bytes of each id. Other tokenizers encode whole texts.

Defined results: a null text is an empty one; an empty text has the end id alone; rows of a null doc_id come first; rows of equal doc_id
are ordered by a hash of their texts, repeated rows are documents of their own; an empty table gives empty files and an empty result; columns
other than doc_id and text are ignored, whatever their names. Strings of special tokens in a text are read as the tokenizer does by itself.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import read, scratch, small

END_ID = 2
#: Bytes of text in a file, files at most, bytes of a row group and of a page, rows of a page.
FILE_BYTES, MOST_FILES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 20_000, 64 << 20, 256 << 10, 1024
#: Pieces that a worker remembers, bytes of a run of pieces that are encoded at once.
KNOWN, RUN_BYTES = 5 << 17, 1 << 16
ROW = "doc_id long, part int, offset long, n_tokens long, ids array<int>"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Marks that are pieces of their own after a letter.
MARKS = ",.;:!?"
_MARK[list(MARKS.encode())] = True
_TOKENIZERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _white_after(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white character may begin at these places; of characters of several bytes the first is asked."""
    return _WHITE[buf[at]] | np.isin(buf[at], (0xC2, 0xE1, 0xE2, 0xE3))


def _white_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white character may end before these places; of characters of several bytes the first and the last are asked."""
    back = lambda k: buf[np.maximum(at - k, 0)]
    last = back(1)
    tail = ((last >= 0x80) & (last <= 0x8A)) | np.isin(last, (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
    return _WHITE[last] | (tail & ((back(2) == 0xC2) | np.isin(back(3), (0xE1, 0xE2, 0xE3))))


def _cuts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places at which pieces begin: each text, a single space or line end between other characters, a sentence mark after an ASCII letter."""
    mark = _MARK[buf]
    mark[1:] &= _LETTER[buf[:-1]]
    at = np.flatnonzero(mark | (buf == 32) | (buf == 10))
    text = np.searchsorted(starts, at, side="right") - 1
    inside = (at > starts[text]) & (mark[at] | (at + 1 < ends[text]))
    at = at[inside]
    blank = ~mark[at]
    white = _white_before(buf, at) | _white_after(buf, np.minimum(at + 1, len(buf) - 1))
    return np.sort(np.concatenate((starts, at[~(blank & white)])), kind="stable")


class Encoder:
    """Ids of a column of texts by the tokenizers library."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        #: Whether texts may be cut into pieces.
        self.by_piece = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c in name for c in MARKS + " \n") for name, t in added.items()):
            self.by_piece = False
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for name, i in vocabulary.items():
            self.width[i] = len(name.encode()) if name in added else len(name)
        self.known = known
        #: The place of each piece; where its ids begin in `ids` and how many they are.
        self.place: dict[bytes, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that may stand side by side, encoded in runs of about RUN_BYTES, and their number for each piece; None if an id reaches over two pieces."""
        cut = np.unique(np.append(np.searchsorted(ends, np.arange(RUN_BYTES, int(ends[-1]), RUN_BYTES)), len(ends) - 1))
        edge = [0, *ends[cut].tolist()]
        try:
            flat = np.concatenate(self._encode([data[i:j].decode() for i, j in zip(edge, edge[1:])]))
        except UnicodeDecodeError:
            return None
        upto = np.cumsum(self.width[flat])
        last = np.searchsorted(upto, ends)
        if last[-1] != len(upto) - 1 or (upto[last] != ends).any():
            return None
        return flat, np.diff(last, prepend=-1)

    def _learn(self, new: pa.Array) -> None:
        """Adds the ids of pieces (large binary), in their order."""
        _, at, data = new.buffers()
        at = np.frombuffer(at, np.int64)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(data, np.uint8)[: int(at[-1])]
        first, end = at[:-1], at[1:]
        joint = ((data[first] == 32) | (data[first] == 10)) & (end - first > 1)
        joint &= ~_white_after(data, np.minimum(first + 1, len(data) - 1)) & ~_white_before(data, end)
        some = np.flatnonzero(joint)
        met = None
        if len(some):
            chosen = new.take(pa.array(some))
            _, c_at, c_data = chosen.buffers()
            c_at = np.frombuffer(c_at, np.int64)[chosen.offset : chosen.offset + len(chosen) + 1]
            met = self._runs(bytes(memoryview(c_data)[int(c_at[0]) : int(c_at[-1])]), c_at[1:] - c_at[0])
        rest = np.flatnonzero(~joint) if met else np.arange(len(new))
        each = self._encode([p.decode("utf-8", "replace") for p in new.take(pa.array(rest)).to_pylist()])
        count = np.zeros(len(new), np.int64)
        begin = np.zeros(len(new), np.int64)
        base = len(self.ids)
        if met:
            count[some] = met[1]
            begin[some] = base + np.cumsum(met[1]) - met[1]
            base += len(met[0])
        count[rest] = [len(x) for x in each]
        begin[rest] = base + np.cumsum(count[rest]) - count[rest]
        self.ids = np.concatenate([self.ids, *([met[0]] if met else []), *each])
        self.begin, self.count = np.concatenate((self.begin, begin)), np.concatenate((self.count, count))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a string column without nulls, and the number of ids of each text."""
        if not self.by_piece:
            each = self._encode(texts.to_pylist())
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        wide = texts.cast(pa.large_binary())
        _, at, data = wide.buffers()
        at = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        base, size = int(at[0]), int(at[-1] - at[0])
        if not size:
            return np.zeros(0, "<u4"), np.zeros(len(wide), np.int64)
        buf, starts, ends = np.frombuffer(data, np.uint8)[base : base + size], at[:-1] - base, at[1:] - base
        some = ends > starts
        cuts = _cuts(buf, starts[some], ends[some])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, size)), pa.py_buffer(buf)]).dictionary_encode()
        which, names = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        place = np.fromiter((self.place.get(p, -1) for p in names), np.int64, len(names))
        new, old = np.flatnonzero(place < 0), (len(self.place), len(self.ids))
        if len(new):
            place[new] = len(self.place) + np.arange(len(new))
            self.place.update(zip((names[i] for i in new.tolist()), place[new].tolist()))
            self._learn(pieces.dictionary.take(pa.array(new)))
        row = place[which]
        of = self.count[row]
        upto = np.cumsum(of)
        flat = self.ids[np.repeat(self.begin[row] - (upto - of), of) + np.arange(int(upto[-1]))]
        if len(self.place) > self.known:  # full: what came first stays, and so do the frequent pieces
            for i in new.tolist():
                del self.place[names[i]]
            self.begin, self.count, self.ids = self.begin[: old[0]], self.count[: old[0]], self.ids[: old[1]]
        until = np.concatenate(([0], upto))
        return flat, until[np.searchsorted(cuts, ends)] - until[np.searchsorted(cuts, starts)]


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, offset = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            flat, n = enc.encode(b.column(1))
            upto = np.cumsum(n + 1)
            out = np.full(int(upto[-1]) if len(upto) else 0, end_id, np.int32)
            inside = np.ones(len(out), bool)
            inside[upto - 1] = False
            out[inside] = flat
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offset + upto - (n + 1), pa.int64()), pa.array(n + 1, pa.int64()), lists], ["doc_id", "part", "offset", "n_tokens", "ids"])
            offset += len(out)

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encodes docs (doc_id, text) and writes them to a new folder in ascending order of doc_id."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, min(MOST_FILES, -(-total // file_bytes)))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order) if files > 1 else rows.coalesce(1).sortWithinPartitions(*order)
    out = placed.mapInArrow(_encode(tokenizer, end_id), ROW).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for name, size in (("parquet.block.size", group_bytes), ("parquet.page.size", page_bytes), ("parquet.page.row.count.limit", page_rows), ("maxRecordsPerFile", 0)):
        out = out.option(name, size)
    for column in ("doc_id", "part", "offset", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{column}", "false")
    out.option("parquet.enable.dictionary#ids.list.element", "true").parquet(folder)


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, base (ids of all earlier files), n_docs, n_tokens, first_id and last_id of each file, from the metadata columns alone."""
    held = spark.read.schema(ROW).parquet(folder).groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.col("offset") + F.col("n_tokens")).alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return held.select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"), "n_docs", "n_tokens", "first_id", "last_id")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; columns that a reader leaves out and rows that it filters by doc_id are not read."""
    base = token_index(spark, folder).select(F.col("part").alias("b_part"), "base")
    rows = spark.read.schema(ROW).parquet(folder)
    return rows.join(small(base), F.col("part") == F.col("b_part")).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def read_positions(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """doc_id, start and the ids whose positions in the whole sequence lie in [begin, end), as if all files were one; documents without any drop.

    The index names the files; within the first and the last one the offsets, which are sorted, prune the pages.
    """
    index = token_index(spark, folder).where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin)).agg(F.min_by(F.struct("part", "base"), "part").alias("low"), F.max_by(F.struct("part", "base"), "part").alias("high")).first()
    rows = read_tokens(spark, folder)
    if index.low is None or end <= begin:
        return rows.where("false").select("doc_id", "start", "ids")
    held = spark.read.schema(ROW).parquet(folder).where(F.col("part").between(index.low.part, index.high.part))
    held = held.where(((F.col("part") > index.low.part) | (F.col("offset") + F.col("n_tokens") > begin - index.low.base)) & ((F.col("part") < index.high.part) | (F.col("offset") < end - index.high.base)))
    base = token_index(spark, folder).select(F.col("part").alias("b_part"), "base")
    out = held.join(small(base), F.col("part") == F.col("b_part")).withColumn("start", F.col("base") + F.col("offset"))
    first = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)).cast("int")
    last = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int")
    return out.select("doc_id", (F.col("start") + first).alias("start"), F.slice("ids", first + 1, last - first).alias("ids"))


def _digests(batches):
    for b in batches:
        lists = b.column(3)
        at = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "n_ids", "ids_crc32"])


def op11_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and their checksum, from token files written first and then read."""
    folder = scratch(spark, "token-tables")
    write_tokens(read(spark, sf_dir, "documents"), folder)
    rows = read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, n_ids long, ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")
