"""Large, growing and pruned log files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkledger.sources import lines as L
from sparkledger.sources import log_source
from sparkledger.sources import surfaces as S
from tests_logs import assistant, meta, tc, turn, write


def whole_numbers(folder):
    """File, number and text of each line, from files read whole."""
    out = []
    for d, _, names in os.walk(folder):
        for n in names:
            with open(os.path.join(d, n), newline="") as f:
                text = f.read()
            rows = text.split("\n")
            out += [(n, i, x) for i, x in enumerate(rows) if x or i < len(rows) - 1]
    return sorted(out)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_files(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_bytes(("\n".join(f"line {i} " + "x" * (i * 7 % 50) for i in range(200)) + "\n").encode())
    (tmp_path / "p" / "b.jsonl").write_bytes(("\n\n" + "y" * 1000 + "\n\nend \u00e9 \r\nno newline").encode())
    (tmp_path / "p" / "c.jsonl").write_bytes(b"")
    (tmp_path / "p" / "d.jsonl").write_bytes(b"one\n")


def test_split_files_keep_their_line_numbers(spark, tmp_path, small_splits):
    odd_files(tmp_path)
    rows = L.file_lines(spark, [str(tmp_path)], "/*/*.jsonl")
    assert rows.rdd.getNumPartitions() > 20
    got = sorted((os.path.basename(r.file_path), r.line_no, r.value) for r in rows.collect())
    assert got == whole_numbers(tmp_path)


def test_source_splits_and_prunes(spark, tmp_path):
    odd_files(tmp_path)
    log_source.register(spark)
    read = spark.read.format("log_lines").option("surface", "claude-code").option("paths", str(tmp_path))
    want = whole_numbers(tmp_path)
    for split in (29, 300, 1 << 20):
        got = sorted((os.path.basename(r.file_path), r.line_no, r.value) for r in read.option("splitBytes", split).load().collect())
        for (f, byte, x), (g, n, y) in zip(got, want, strict=True):
            assert (f, x) == (g, y)
            with open(tmp_path / "p" / f, "rb") as h:
                assert h.read()[byte:].startswith(x.encode()) and (byte == 0) == (n == 0)
    os.utime(tmp_path / "p" / "a.jsonl", (1000, 1000))
    late = read.load().where(F.col("modified") >= F.lit("2020-01-01").cast("timestamp"))
    assert late.select("file_path").distinct().count() == 2 and late.rdd.getNumPartitions() == 2
    reader = log_source.BatchReader([str(tmp_path)], "*/*.jsonl", 1 << 20)
    from datetime import datetime, timezone

    assert len(list(reader.pushFilters([log_source.GreaterThanOrEqual(("modified",), datetime(2020, 1, 1, tzinfo=timezone.utc))]))) == 1
    assert sorted(os.path.basename(p.path) for p in reader.partitions()) == ["b.jsonl", "d.jsonl"]
    with pytest.raises(Exception, match="paths"):
        spark.read.format("log_lines").load().collect()
    assert spark.read.format("log_lines").option("surface", "codex").option("paths", str(tmp_path / "none")).load().count() == 0


def test_scans_through_the_source(spark, tmp_path):
    log_source.register(spark)
    at = [f"2024-05-01T10:0{i}:00.000Z" for i in range(6)]
    write(tmp_path / "a" / "p" / "x.jsonl", [assistant("r1"), "junk", assistant("r2", time="2024-05-02T00:00:00Z"), {"type": "user"}])
    write(tmp_path / "b" / "s" / "workspace.yaml", ["id: one"])
    write(tmp_path / "b" / "s" / "events.jsonl", [{"type": "session.shutdown", "timestamp": at[0], "data": {"modelMetrics": {m: {"usage": {"inputTokens": 3}} for m in "uv"}}}] * 2)
    use = lambda n: {"input_tokens": n, "output_tokens": 1}
    write(tmp_path / "c" / "d" / "y.jsonl", [meta(), turn(), tc(at[0], use(10)), tc(at[1], use(30)), turn("t2", "m2"), tc(at[2], None, use(5)), tc(at[3], use(90)), tc(at[4], use(95))])
    lines = lambda surface, base: L.json_lines(spark.read.format("log_lines").option("surface", surface).option("paths", f"{tmp_path}/{base}").option("splitBytes", 100).load())
    spaces = L.key_values(L.whole_files(spark, [f"{tmp_path}/b"], "/*/workspace.yaml")).withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/"))
    both = [
        (S.scan_claude_code(spark, [f"{tmp_path}/a"]), S.claude_code_events(lines("claude-code", "a"))),
        (S.scan_copilot_cli(spark, [f"{tmp_path}/b"]), S.copilot_cli_events(lines("copilot-cli", "b"), spaces)),
        (S.scan_codex(spark, [f"{tmp_path}/c"]), S.codex_events(lines("codex", "c"))),
    ]
    for scan, source in both:
        plain = lambda df: sorted(str(r.asDict(True)) for r in df.drop("line_no", "file_path").collect())
        assert plain(scan) == plain(source) and scan.count() > 1


def take(spark, folder, ck, out):
    df = spark.readStream.format("log_lines").option("surface", "codex").option("paths", str(folder)).option("splitBytes", 40).load()
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).trigger(availableNow=True).start().awaitTermination()
    return sorted(r.value for r in spark.read.parquet(str(out)).collect()) if any(p.suffix == ".parquet" for p in out.glob("*")) else []


def test_growing_files_as_a_stream(spark, tmp_path):
    log_source.register(spark)
    logs, ck, out = tmp_path / "logs", tmp_path / "ck", tmp_path / "out"
    write(logs / "d" / "a.jsonl", [f"a{i}" for i in range(30)])
    want = [f"a{i}" for i in range(30)]
    assert take(spark, logs, ck, out) == sorted(want)
    with open(logs / "d" / "a.jsonl", "a") as f:
        f.write("a30\nhalf of a li")
    write(logs / "b.jsonl", ["b0"])
    want += ["a30", "b0"]
    assert take(spark, logs, ck, out) == sorted(want)
    with open(logs / "d" / "a.jsonl", "a") as f:
        f.write("ne\na32\n")
    want += ["half of a line", "a32"]
    assert take(spark, logs, ck, out) == sorted(want)
    assert take(spark, logs, ck, out) == sorted(want)


def test_file_set_reads_no_content(spark, tmp_path):
    for place in ("a/sessions/x.jsonl", "a/archived_sessions/x.jsonl", "a/archived_sessions/y.jsonl", "b/z.jsonl"):
        write(tmp_path / place, [meta(place), turn(), tc("2024-05-01T10:00:00.000Z", {"input_tokens": 1})])
    homes = [f"{tmp_path}/a", f"{tmp_path}/b"]
    files = S.codex_files(spark, homes)
    assert sorted(r.file_path.split("/", 3)[3].removeprefix(str(tmp_path)[1:] + "/") for r in files.select(F.regexp_replace("file_path", "^file:/+", "file:///").alias("file_path")).collect()) == ["a/archived_sessions/y.jsonl", "a/sessions/x.jsonl", "b/z.jsonl"]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "content#" not in plan
    rows = S.codex_lines(spark, homes)
    rows.collect()
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(value" in x]
    assert sorted(r.metadata.session_id for r in S.codex_events(L.json_lines(rows)).collect()) == ["a/archived_sessions/y.jsonl", "a/sessions/x.jsonl", "b/z.jsonl"]


def test_untouched_files_are_not_opened(spark, tmp_path):
    write(tmp_path / "p" / "old.jsonl", [assistant("old")])
    write(tmp_path / "p" / "new.jsonl", [assistant("new")])
    os.utime(tmp_path / "p" / "old.jsonl", (1000, 1000))
    rows = L.file_lines(spark, [str(tmp_path)], "/*/*.jsonl", since=F.lit("2020-01-01").cast("timestamp"))
    assert [json.loads(r.value)["requestId"] for r in rows.collect()] == ["new"]


def test_lines_written_as_files(spark, tmp_path):
    from sparkledger.sources.log_files import write_lines

    rows = [("a/x.jsonl", f"line {i}", i) for i in range(500)] + [("a/y.jsonl", None, 1), ("a/y.jsonl", "é", 2), (None, "lost", 0), ("b/c/z.txt", "same", 7), ("b/c/z.txt", "same", 7)]
    base = f"file://{tmp_path}/out"
    df = spark.createDataFrame(rows, "path string, value string, n int").repartition(7)
    for _ in range(2):  # a second run replaces the files by equal ones
        got = {r.path: r.lines for r in write_lines(df, base, ["n"]).collect()}
        assert got == {"a/x.jsonl": 500, "a/y.jsonl": 2, "b/c/z.txt": 2}
        (tmp_path / "out-written").rename(tmp_path / f"seen-{_}")
    root = tmp_path / "out"
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == ["a/x.jsonl", "a/y.jsonl", "b/c/z.txt"]
    assert (root / "a/x.jsonl").read_text().splitlines() == [f"line {i}" for i in range(500)]
    assert (root / "a/y.jsonl").read_text() == "\né\n"
    assert write_lines(df.limit(0), f"file://{tmp_path}/none", ["n"]).count() == 0


def test_files_are_listed_by_folders(spark, tmp_path, monkeypatch):
    """A path for each folder, not for each file; files at the top, deeper ones and other suffixes are not of the layout."""
    for place in ("top.jsonl", "p/a.jsonl", "p/b.jsonl", "p/c.txt", "p/deep/d.jsonl", "-q r/k=v/e.jsonl", "-q r/f.jsonl", "_s/g.jsonl", "empty/h.txt"):
        write(tmp_path / "l\u00f6gs" / place, [place])
    paths, plain = [], type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, *a, **k: (paths.append(path), plain(self, path, *a, **k))[1])
    rows = L.file_lines(spark, [f"{tmp_path}/l\u00f6gs", f"{tmp_path}/none"], "/*/*.jsonl").collect()
    assert sorted((r.value, r.line_no) for r in rows) == [(x, 0) for x in ("-q r/f.jsonl", "_s/g.jsonl", "p/a.jsonl", "p/b.jsonl")]
    assert len(paths) == 1 and sorted(x.rsplit("/", 1)[1] for x in paths[0]) == ["-q r", "_s", "empty", "p"]


def test_lines_are_parsed_once(spark):
    """Filters on fields of a line do not parse it again; what parses is the same."""
    lines = ['{"type": "session_meta", "payload": {"id": "s"}}', '{"a": 1} x', '{"a": 1}, {"a": 2}', "[1]", " ", None, ' {"payload": {}} \r', "{", "5}", '"}']
    rows = spark.createDataFrame([(v, "f", i) for i, v in enumerate(lines)], "value string, file_path string, line_no int").selectExpr("*", "timestamp '2024-05-01' as modified", "0 as source_rank")
    got = L.json_lines(rows)
    assert sorted(r.line_no for r in got.collect()) == [0, 6]
    for out in (S.codex_events(got), S.claude_code_events(got)):
        assert out._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
