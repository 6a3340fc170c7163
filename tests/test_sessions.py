"""Session state as a stream against the batch windows."""

import random

from sparkledger.sources import log_source
from sparkledger.sources import surfaces as S
from sparkledger.streaming.sessions import codex_stream
from tests_logs import block, meta, tc, turn, write


def session(draw, name):
    """Lines with every kind of state: changed and missing sessions, bare and absent usage, bad times, repeated ids."""
    out, run = [], 0
    for _ in range(60):
        kind = draw.random()
        time = draw.choice(["bad", *[f"2024-05-01T10:0{draw.randrange(10)}:00.000Z"] * 9])
        if kind < 0.06:
            out.append(meta(draw.choice([name, name + "x"]), **draw.choice([{}, {"git": None}])))
        elif kind < 0.2:
            out.append(turn(draw.choice(["t1", "t2"]), draw.choice(["m1", None]), **draw.choice([{}, {"cwd": "/other"}])))
        elif kind < 0.28:
            out.append(draw.choice(["noise", {"type": "response_item", "payload": {"x": 1}}, tc(time)]))
        else:
            n = draw.randrange(1, 50)
            run = 0 if draw.random() < 0.05 else run + n
            out.append(tc(time, draw.choice([None, block(run, run // 3, 1, run // 2)]), draw.choice([None, None, block(n, n // 2)])))
    return out


def rows(df):
    names = [c for c in S.COUNTERS[:1]] + ["external_id", "model", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "occurred_at"]
    return sorted((str(tuple(r)) for r in df.select(*names, "metadata.session_id", "metadata.cwd", "metadata.git_branch").collect()))


def test_session_stream_equals_the_windows(spark, tmp_path):
    log_source.register(spark)
    draw, logs, out = random.Random(7), tmp_path / "logs", tmp_path / "out"
    files = {logs / "d" / f"{n}.jsonl": [meta(n), turn(), *session(draw, n)] if n != "c" else session(draw, n) for n in "abc"}
    for part in (5, 31, 62):  # the files grow between the runs
        for path, lines in files.items():
            write(path, lines[:part])
        stream = spark.readStream.format("log_lines").option("surface", "codex").option("paths", str(logs)).option("splitBytes", 700).load()
        codex_stream(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got, want = rows(spark.read.parquet(str(out))), rows(S.scan_codex(spark, [str(logs)]))
        assert got == want
    assert len(want) > 40 and any(":2'" in r for r in want)
