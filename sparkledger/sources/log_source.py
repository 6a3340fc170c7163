"""`log_lines`, a data source of the lines of log files: a batch reader with byte-range partitions and a stream of growing files.

    register(spark)
    spark.read.format("log_lines").option("surface", "codex").option("paths", "/a,/b").load()
    spark.readStream.format("log_lines").option("surface", "claude-code").option("paths", "/logs").load()

Rows: value, file_path, modified, line_no, source_rank, as the scans take them; line_no is the byte at which the line begins, which orders the lines
of a file. Files are found by the surface's layout (`surface`: claude-code, copilot-cli, codex) or by `pattern`, a glob below each path.

Batch: a file is cut into ranges of `splitBytes`; a range holds the lines that begin in it, and the reader reads on to the end of the last one.
A filter `modified >= t` (or >, =) is pushed down: files that it rules out are neither cut nor opened.

Stream: an offset is the bytes taken of each file, always at the end of a line, so an appended line arrives once and a line that is still being written waits for
its end. A file that has become shorter is taken as new. The files and their lengths are listed by the driver for each batch; the tails it reads are a few kilobytes.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "value string, file_path string, modified timestamp, line_no long, source_rank int"
#: How a surface lays out its log files below a base (fixed values).
LAYOUTS = {"claude-code": "*/*.jsonl", "copilot-cli": "*/events.jsonl", "codex": "**.jsonl"}
SPLIT_BYTES, TAIL_BYTES, READ_BYTES, BATCH_LINES = 64 << 20, 1 << 16, 8 << 20, 10_000


def _open_fs(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list(paths: list[str], pattern: str) -> list[tuple[str, datetime, int, int]]:
    """path, modified, length and rank of each file, in order of rank and path. A pattern that begins with ** holds at any depth."""
    from pyarrow import fs

    out = []
    for rank, base in enumerate(paths):
        system, at = _open_fs(base)
        deep = pattern.startswith("**")
        depth = pattern.count("/") + 1
        todo = [(at.rstrip("/"), 0)]
        while todo:
            folder, level = todo.pop()
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.Directory and (deep or level + 1 < depth):
                    todo.append((info.path, level + 1))
                elif info.type == fs.FileType.File:
                    rest = info.path[len(at.rstrip("/")) + 1 :]
                    wanted = fnmatch.fnmatchcase(rest.rpartition("/")[2], pattern[1:]) if deep else rest.count("/") + 1 == depth and all(map(fnmatch.fnmatchcase, rest.split("/"), pattern.split("/")))
                    if wanted:
                        out.append((info.path, info.mtime.astimezone(timezone.utc), info.size, rank))
    return sorted(out, key=lambda x: (x[3], x[0]))


class Range(InputPartition):
    """The lines of a file that begin in [begin, end); `stop` is the end of what may be read."""

    def __init__(self, base: str, path: str, modified: datetime, rank: int, begin: int, end: int, stop: int):
        super().__init__(None)
        self.base, self.path, self.modified, self.rank, self.begin, self.end, self.stop = base, path, modified, rank, begin, end, stop


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """Batches of SCHEMA."""
    system, _ = _open_fs(part.base)
    with system.open_input_file(part.path) as f:
        at = max(part.begin - 1, 0)  # a line begins at `begin` if a line end stands before it
        f.seek(at)
        skip, rest, rows = part.begin > 0, b"", []
        while True:
            chunk = f.read(min(READ_BYTES, part.stop - at - len(rest)))
            data = rest + chunk
            lines = data.split(b"\n")
            last = not chunk
            whole = lines if last else lines[:-1]
            for line in whole:
                if not skip:
                    if at >= part.end:
                        break
                    if line or not last:
                        rows.append((line, at))
                skip = False
                at += len(line) + 1
            for i in range(0, len(rows), BATCH_LINES):
                some = rows[i : i + BATCH_LINES]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x, _ in some], pa.string()), pa.array([part.path] * n), pa.array([part.modified] * n, pa.timestamp("us", "UTC")), pa.array([b for _, b in some], pa.int64()), pa.array([part.rank] * n, pa.int32())], ["value", "file_path", "modified", "line_no", "source_rank"])
            rows = []
            if last or at >= part.end and not skip:
                return
            rest = lines[-1]


class BatchReader(DataSourceReader):
    def __init__(self, paths: list[str], pattern: str, split_bytes: int):
        self.paths, self.pattern, self.split_bytes, self.floor = paths, pattern, split_bytes, None

    def pushFilters(self, filters: list[Filter]):
        """Takes bounds on `modified` as a bound on the files; Spark applies every filter again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("modified",) and f.value is not None:
                low = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.floor = low if self.floor is None else max(self.floor, low)
            yield f

    def partitions(self):
        out = []
        for path, modified, size, rank in _list(self.paths, self.pattern):
            if self.floor is None or modified >= self.floor:
                out += [Range(self.paths[rank], path, modified, rank, b, min(b + self.split_bytes, size), size) for b in range(0, size, self.split_bytes)]
        return out or [Range("", "", datetime.fromtimestamp(0, timezone.utc), 0, 0, 0, -1)]

    def read(self, partition: Range):
        if partition.stop > 0:
            yield from read_range(partition)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], pattern: str, split_bytes: int):
        self.paths, self.pattern, self.split_bytes = paths, pattern, split_bytes
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _line_end(self, rank: int, path: str, size: int, floor: int) -> int:
        """The end of the last whole line of a file, not below floor."""
        system, _ = _open_fs(self.paths[rank])
        with system.open_input_file(path) as f:
            top = size
            while top > floor:
                low = max(floor, top - TAIL_BYTES)
                f.seek(low)
                hit = f.read(top - low).rfind(b"\n")
                if hit >= 0:
                    return low + hit + 1
                top = low
        return floor

    def latestOffset(self) -> dict:
        ends = {}
        for path, _, size, rank in _list(self.paths, self.pattern):
            old_size, old_end = self.known.get(path, (0, 0))
            if size < old_size:
                old_size = old_end = 0
            ends[path] = old_end if size == old_size else self._line_end(rank, path, size, old_end)
            self.known[path] = (size, ends[path])
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, out = json.loads(start["files"]), []
        times = {path: (modified, rank) for path, modified, _, rank in _list(self.paths, self.pattern)}
        for path, stop in json.loads(end["files"]).items():
            begin = before.get(path, 0)
            begin = 0 if begin > stop else begin
            if path in times and stop > begin:
                modified, rank = times[path]
                out += [Range(self.paths[rank], path, modified, rank, b, min(b + self.split_bytes, stop), stop) for b in range(begin, stop, self.split_bytes)]
        return out

    def read(self, partition: Range):
        yield from read_range(partition)


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def _args(self):
        paths = [p.strip() for p in self.options.get("paths", "").split(",") if p.strip()]
        pattern = self.options.get("pattern") or LAYOUTS.get(self.options.get("surface", ""))
        if not paths or not pattern:
            raise ValueError("log_lines needs the options paths and surface (or pattern)")
        return paths, pattern, int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(*self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(*self._args())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with the pushdown of filters on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogLines)
