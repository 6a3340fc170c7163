"""Session state of the third surface as a stream of growing files.

Two stateful operators follow each other. The first is keyed by session file and keeps what its next lines need: the session, turn, branch and folder in
force, the last totals and whether they are a usable baseline. The second is keyed by event id and keeps how often it was met, for the suffixes.
Both answer as the batch windows do on the same lines, however the lines are cut into batches; ids that stand in several files are numbered as they arrive.

What travels is the few fields of session, turn and token count lines. A task sorts those of one file that came in one batch, so the files that
are there at the start are best read in more than one run. A file that is cut short begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.lines import json_lines
from ..sources.surfaces import COUNTERS, codex_ident, codex_parts, codex_usage

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONTEXT = ["id", "client", "version", "branch", "turn", "model", "cwd"]
_STATE = ["line_no", *_CONTEXT, "usable", *COUNTERS]
STATE = ", ".join(["line_no long", *(f"{c} string" for c in _CONTEXT), "usable boolean", *(f"{c} long" for c in COUNTERS)])
_COUNT = ["source_rank", "file_path", "line_no", "time_us", *_CONTEXT, *COUNTERS]
COUNT = ", ".join(["source_rank int", "file_path string", "line_no long", "time_us long", *(f"{c} string" for c in _CONTEXT), *(f"{c} long" for c in COUNTERS)])


class SessionState(StatefulProcessor):
    """The counts of a file's new lines, with the state that the lines before them left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = sorted(rows, key=lambda r: r.line_no)
        old = self.state.get()
        if old is None or held[0].line_no <= old[0]:
            old = (-1, *[None] * len(_CONTEXT), True, *[0] * len(COUNTERS))
        s, out = dict(zip(_STATE, old)), []
        for r in held:
            if r.meta is not None:
                s |= {"id": r.meta["id"], "client": r.meta["client"], "version": r.meta["version"]}
            if r.git is not None:
                s["branch"] = r.git["branch"]
            if r.turn is not None:
                s |= {"turn": r.turn["id"], "model": r.turn["model"]}
            if r.dir is not None:
                s["cwd"] = r.dir["cwd"]
            if not r.is_count or r.time_us is None or s["id"] is None or not r.has_info:
                continue
            use = None if r.last is None else {c: r.last[c] for c in COUNTERS}
            if use is None and r.total is not None and s["usable"]:
                use = {c: max(0, r.total[c] - s[c]) for c in COUNTERS}
            if r.total is not None:
                s |= {c: r.total[c] for c in COUNTERS}
            s["usable"] = s["usable"] if r.total is None and r.last is None else r.total is not None
            model = s["model"] if r.own_model is None else r.own_model
            if use is not None and model is not None:
                found = s | use | {"model": model, "source_rank": r.source_rank, "file_path": r.file_path, "line_no": r.line_no, "time_us": r.time_us}
                out.append(Row(**{c: found[c] for c in _COUNT}))
        s["line_no"] = held[-1].line_no
        self.state.update(tuple(s[c] for c in _STATE))
        return iter(out)

    def close(self) -> None:
        pass


class Occurrences(StatefulProcessor):
    """Numbers the rows of an id over all batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = sorted(rows, key=lambda r: (r.source_rank, r.file_path, r.line_no))
        old = self.met.get()
        first = 1 if old is None else old[0] + 1
        self.met.update((first + len(held) - 1,))
        return iter([Row(**{c: r[c] for c in _COUNT}, ident=key[0], n=first + i) for i, r in enumerate(held)])

    def close(self) -> None:
        pass


def _state_of(counts: DataFrame, *more: str) -> DataFrame:
    """Rows with the columns of COUNT in the form that the batch windows give."""
    parts = {
        "time": F.timestamp_micros("time_us"),
        "meta": F.struct("id", "client", "version"),
        "git": F.struct("branch"),
        "turn": F.struct(F.col("turn").alias("id")),
        "dir": F.struct("cwd"),
        "use": F.struct(*COUNTERS),
    }
    return counts.select("source_rank", "file_path", "line_no", "model", *(c.alias(n) for n, c in parts.items()), *more)


def codex_stream(lines: DataFrame) -> DataFrame:
    """Usage events of a stream of lines, as the log_lines format gives them; the sink appends."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = codex_parts(json_lines(lines))
    rows = rows.select("source_rank", "file_path", F.col("line_no").cast("long").alias("line_no"), F.col("count").alias("is_count"), "meta", "git", "turn", "dir", F.unix_micros("time").alias("time_us"), F.coalesce("has_info", F.lit(False)).alias("has_info"), "own_model", "total", "last")
    counts = rows.groupBy("source_rank", "file_path").transformWithState(SessionState(), COUNT, "Append", "None")
    known = _state_of(counts.withColumn("row", F.struct(*_COUNT)), "row").select("row.*", codex_ident().alias("ident"))
    numbered = known.groupBy("ident").transformWithState(Occurrences(), f"{COUNT}, ident string, n long", "Append", "None")
    ident = F.when(F.col("n") > 1, F.concat("ident", F.lit(":"), F.col("n"))).otherwise(F.col("ident"))
    return codex_usage(_state_of(numbered, "ident", "n"), ident)
