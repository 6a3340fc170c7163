"""Engine operators on small values of our own."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.functions.variant import iso_string, iso_timestamp, number_or_zero, parse_line, string_or_null
from sparkledger.operators import commits as C
from sparkledger.operators import reachability as R
from sparkledger.operators.asof import asof_forward
from sparkledger.operators.filters import parse_state
from sparkledger.operators.usage import batches, suffix_duplicates
from sparkledger.plans.sync import Ledger, rollup, secure_url, wire_events
from sparkledger.sources import surfaces as S
from sparkledger.sources.lines import key_values

from tests_logs import assistant, block, meta, tc, turn, write

T0 = datetime(2024, 5, 1, 10, tzinfo=timezone.utc)


def test_variant_helpers_test_types_and_never_coerce(spark):
    lines = ['{"n": 5, "s": "x"}', '{"n": "5", "s": 1}', '{"n": -2.9, "s": ""}', '{"n": 1e400}', '{"n": 1} x', '{"a":1}{"b":2}', "[1]", "nope", '{"n": 1, "n": 2}', '{"n": 1e30}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").withColumn("v", parse_line(F.col("line")))
    got = {r.i: (r.n, r.p, r.s, r.e) for r in df.where("v is not null").select("i", number_or_zero(F.col("v"), "$.n").alias("n"), number_or_zero(F.col("v"), "$.n", False).alias("p"), string_or_null(F.col("v"), "$.s").alias("s"), string_or_null(F.col("v"), "$.s", False).alias("e")).collect()}
    assert got == {0: (5, 5, "x", "x"), 1: (0, 0, None, None), 2: (-2, 0, "", None), 3: (0, 0, None, None), 8: (2, 2, None, None), 9: (0, 0, None, None)}


def test_iso_dates(spark):
    cases = {"2024-05-01T10:00:00.123456Z": "2024-05-01T10:00:00.123Z", "2024-05-01T10:00Z": "2024-05-01T10:00:00.000Z", "2024-05-01": "2024-05-01T00:00:00.000Z", "2024-05-01T12:00:00+0200": "2024-05-01T10:00:00.000Z", "12:00": None, "nonsense": None, "2024-13-01": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.t for r in df.select("s", iso_string(iso_timestamp(F.col("s"))).alias("t")).collect()} == cases


def test_first_surface_rejects_and_projects(spark, tmp_path):
    rows = [assistant(), assistant("r2", usage={"input_tokens": 1, "cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 5}}), assistant("r3", model="<synthetic>"), assistant(None), {"type": "user"}, "broken {", "", assistant("r4", time="never"), assistant("r5", usage=3)]
    write(tmp_path / "p" / "a.jsonl", rows)
    write(tmp_path / "p" / "a.txt", [assistant("no")])
    write(tmp_path / "stray.jsonl", [assistant("no")])
    got = {r.external_id: r for r in S.scan_claude_code(spark, [str(tmp_path), str(tmp_path / "missing")]).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].input_tokens, got["r1"].cache_creation_tokens, got["r1"].cache_creation_5m_tokens, got["r1"].cache_write_tokens) == (10, 7, 0, None)
    assert (got["r2"].cache_creation_5m_tokens, got["r2"].cache_creation_1h_tokens) == (4, 5)
    since = F.to_timestamp(F.lit("2024-05-01T10:00:00.123Z"))
    assert S.scan_claude_code(spark, [str(tmp_path)], since).count() == 0


def test_second_surface_models_segments_and_suffixes(spark, tmp_path):
    use = lambda n: {"usage": {"inputTokens": n, "outputTokens": 1, "cacheReadTokens": 2, "cacheWriteTokens": 3}}
    shut = lambda time, **m: {"type": "session.shutdown", "data": {"modelMetrics": m}} | ({"timestamp": time} if time else {})
    write(tmp_path / "s1" / "workspace.yaml", ["id: one", "cwd: '/w'", "branch: old", "branch: new", "created_at: 2024-05-01T09:00:00Z"])
    write(tmp_path / "s1" / "events.jsonl", [shut("2024-05-01T10:00:00Z", a=use(1), b=use(2)), shut(None, a=use(3)), shut(None, a=use(4)), {"type": "other"}, shut("2024-05-01T11:00:00Z", a=5)])
    write(tmp_path / "s2" / "events.jsonl", [shut("2024-05-01T10:00:00Z", a=use(9))])
    got = {r.external_id: (r.input_tokens, r.cache_write_tokens, r.metadata.git_branch) for r in S.scan_copilot_cli(spark, [str(tmp_path)]).collect()}
    assert got == {"one:a:2024-05-01T10:00:00.000Z": (1, 3, "new"), "one:b:2024-05-01T10:00:00.000Z": (2, 3, "new"), "one:a:2024-05-01T09:00:00.000Z": (3, 3, "new"), "one:a:2024-05-01T09:00:00.000Z:2": (4, 3, "new")}


AT = [f"2024-05-01T10:0{i}:00.000Z" for i in range(6)]


@pytest.mark.parametrize(
    "lines, expected",
    [
        ([meta(), turn(), tc(AT[0], block(1000, 700, 100, 80), block(1000, 700, 100, 80))], [(200, 700, 100, 80)]),
        ([meta(), tc(AT[0], block(9)), turn(), {"type": "response_item", "payload": {"text": "x"}}, "junk", tc(AT[1]), tc(AT[2], None, block(5))], [(5, 0, 0, 0)]),
        ([meta(), turn(), tc(AT[0], None, block(200, 0, 0, 80)), tc(AT[1], block(1500, 300, 0, 140)), tc(AT[2], block(2000, 400, 0, 180))], [(200, 0, 0, 80), (400, 100, 0, 40)]),
        ([meta(), turn(), tc(AT[0], block(1000, 200, 0, 100)), tc(AT[1], block(1500, 300, 0, 140))], [(800, 200, 0, 100), (400, 100, 0, 40)]),
        ([meta(), turn(), tc(AT[0], block(100)), tc("bad", block(900)), tc(AT[1], block(50))], [(100, 0, 0, 0), (0, 0, 0, 0)]),
        ([tc(AT[0], None, block(1)), turn()], []),
    ],
)
def test_third_surface_state(spark, tmp_path, lines, expected):
    write(tmp_path / "d" / "e" / "s.jsonl", lines)
    got = S.scan_codex(spark, [str(tmp_path)]).orderBy("line_no").collect()
    assert [(r.input_tokens, r.cache_read_tokens, r.cache_write_tokens, r.output_tokens) for r in got] == expected


def test_third_surface_context_and_duplicates(spark, tmp_path):
    lines = [meta(), turn("t1", "m1"), tc(AT[0], None, block(1)), turn("t2", "m2", cwd="/other"), tc(AT[1], None, block(2)), tc(AT[1], None, block(3)), meta("z", git=None), turn("t3", None), tc(AT[2], None, block(4), model="own"), tc(AT[3], None, block(5))]
    write(tmp_path / "s.jsonl", lines)
    got = [(r.external_id, r.model, r.metadata.cwd, r.metadata.git_branch) for r in S.scan_codex(spark, [str(tmp_path)]).orderBy("line_no").collect()]
    assert got == [(f"s:t1:{AT[0]}", "m1", "/w", "b"), (f"s:t2:{AT[1]}", "m2", "/other", "b"), (f"s:t2:{AT[1]}:2", "m2", "/other", "b"), (f"z:t3:{AT[2]}", "own", "/w", "b")]


def test_third_surface_homes(spark, tmp_path, monkeypatch):
    for place in ("a/sessions/x.jsonl", "a/archived_sessions/x.jsonl", "a/archived_sessions/y.jsonl", "b/z.jsonl"):
        write(tmp_path / place, [meta(place), turn(), tc(AT[0], None, block(1))])
    monkeypatch.setenv("CODEX_HOME", f"{tmp_path}/a, {tmp_path}/b")
    assert sorted(r.metadata.session_id for r in S.scan_codex(spark).collect()) == ["a/archived_sessions/y.jsonl", "a/sessions/x.jsonl", "b/z.jsonl"]


def test_account(spark, tmp_path, monkeypatch):
    (tmp_path / ".claude.json").write_text('{"oauthAccount": {"accountUuid": "u", "emailAddress": 3}}')
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", f"{tmp_path}/none,{tmp_path}")
    assert [tuple(r) for r in S.read_account(spark).collect()] == [("u", None, None, None)]
    assert S.claude_project_dirs() == [f"{tmp_path}/none/projects", f"{tmp_path}/projects"]
    assert S.read_account(spark, str(tmp_path / "gone")).count() == 0


@pytest.mark.parametrize("bucket", [None, 3600])
def test_asof_bounds_and_ties(spark, bucket):
    at = lambda h, m=0: T0.replace(hour=h, minute=m)
    e = spark.createDataFrame([("a", at(9, 30)), ("b", at(11)), ("c", at(13)), ("d", at(10)), ("n", None)], "id string, t timestamp").withColumn("repo", F.lit(1))
    c = spark.createDataFrame([("c2", at(12), 0), ("c1", at(10), 1), ("c0", at(10), 2)], "sha string, t timestamp, ord int").withColumn("repo", F.lit(1))
    got = {r.id: r.commit and r.commit.sha for r in asof_forward(e, c, ["repo"], "t", "t", "ord", keep_unmatched=True, bucket_seconds=bucket).collect()}
    assert got == {"a": "c1", "b": "c2", "c": None, "d": "c1", "n": None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=12), st.sampled_from([None, 7]))
def test_asof_equals_brute_force(spark, events, commits, bucket):
    e = spark.createDataFrame([(i, r, T0 + timedelta(seconds=t)) for i, (r, t) in enumerate(events)], "id int, repo int, t timestamp")
    c = spark.createDataFrame([(i, r, T0 + timedelta(seconds=t)) for i, (r, t) in enumerate(commits)], "ord int, repo int, t timestamp")
    want = {}
    for i, (r, t) in enumerate(events):
        later = [(u, k) for k, (q, u) in enumerate(commits) if q == r and u >= t]
        want[i] = min(later)[1] if later else None
    got = {r.id: r.commit and r.commit.ord for r in asof_forward(e, c, ["repo"], "t", "t", "ord", keep_unmatched=True, bucket_seconds=bucket).collect()}
    assert got == want


def test_asof_is_linear_in_a_key(spark):
    import time

    n = 100_000
    e = spark.range(n).select("id", F.lit(1).alias("k"), (F.col("id") * 7 % n).alias("t"))
    c = spark.range(0, n, 10).select(F.col("id").alias("o"), F.lit(1).alias("k"), F.col("id").alias("t"))
    start = time.perf_counter()
    got = asof_forward(e, c, ["k"], "t", "t", "o").agg(F.count("*"), F.sum(F.col("commit.t") - F.col("t"))).first()
    assert tuple(got) == (n - 9, 45 * n // 10 - 45) and time.perf_counter() - start < 60


def test_asof_of_any_names_and_order_types(spark):
    e = spark.createDataFrame([("x", 1, "e1"), (None, 1, "e2"), ("x", 3, "e3")], "k string, t int, o string")
    c = spark.createDataFrame([("x", 2, "b"), ("x", 2, "a"), (None, 1, "z")], "k string, t int, o string")
    got = {r.o: r.commit and r.commit.o for r in asof_forward(e, c, ["k"], "t", "t", "o", keep_unmatched=True).collect()}
    assert got == {"e1": "a", "e2": "z", "e3": None}


def test_commit_log(spark):
    text = "\x1eaaa\x1f2024-05-01T10:00:00+02:00\n\n3\t1\tf\n-\t-\tbin\n12x\t\tg\n\x1ebbb\x1fno date\n1\t1\tf\n\x1eccc\x1f2024-05-02T00:00:00Z\n"
    got = [(r.sha, r.lines_added, r.lines_deleted, r.files_changed) for r in C.parse_commit_log(spark.createDataFrame([("r", text)], "repo string, value string"), ["repo"]).orderBy("ord").collect()]
    assert got == [("aaa", 15, 1, 3), ("ccc", 0, 0, 0)]


def test_recent_branches_and_equivalents(spark):
    lines = "\n".join(["s1\x1f2024-05-01T00:00:00Z", "broken", "s2\x1f2024-04-30T00:00:00Z", "s3\x1f2020-01-01T00:00:00Z"])
    assert [r.sha for r in C.parse_recent(spark.createDataFrame([("r", lines)], "repo string, value string"), ["repo"], F.lit(T0)).orderBy("ord").collect()] == ["s1", "s2"]
    assert sorted(r.branch for r in C.real_branches(spark.createDataFrame([(" f ",), ("(HEAD detached at x)",), ("origin",), ("origin/HEAD",), ("",), ("origin/f",)], "branch string")).collect()) == ["f", "origin/f"]
    assert [r.sha for r in C.patch_equivalents(spark.createDataFrame([("r", "- a\n+ b\n- a\n")], "repo string, value string"), ["repo"]).collect()] == ["a"]


def test_repo_size(spark):
    files = spark.createDataFrame([("r", 4, bytearray(b"a\nb\n")), ("r", 3, bytearray(b"a\x00b")), ("r", 1 << 21, bytearray(b"big")), ("s", 0, bytearray(b"")), ("t", 4, bytearray(b"\xe9\n\xff\xfe"))], "repo string, length long, content binary")
    assert sorted(map(tuple, C.repo_size(files, ["repo"]).collect())) == [("r", 3, 3), ("s", 1, 1), ("t", 2, 1)]


def test_fates(spark):
    now = T0
    old, fresh, edge, past = now - timedelta(days=40), now - timedelta(days=2), now - timedelta(days=14), now - timedelta(days=14, milliseconds=1)
    cases = {  # sha: ancestor, cherry, branches
        "anc": (1, 0, ["f", "main"]), "anc0": (1, 0, []), "cherry": (0, 1, ["old"]), "fresh": (0, 0, ["f"]), "dormant": (0, 0, ["origin/old", "old"]), "bare": (0, 0, []), "mixed": (0, 0, ["old", "f"]),
        "unknown": (0, 0, ["null"]), "edge": (0, 0, ["edge"]), "past": (0, 0, ["past"]), "remote": (0, 0, ["origin/old"]), "onlydef": (0, 0, ["origin/main"]),
    }
    tips = {"main": old, "origin/main": fresh, "f": fresh, "old": old, "origin/old": old, "null": None, "edge": edge, "past": past}
    df = spark.createDataFrame
    got = C.fates(df([("r", "main", now), ("q", None, now)], "repo_root string, default_branch string, now timestamp"), df([("r", s) for s in cases] + [("q", "x")], "repo_root string, sha string"), df([("r", s) for s, c in cases.items() if c[0]], "repo_root string, sha string"), df([("r", s) for s, c in cases.items() if c[1]], "repo_root string, sha string"), df([("r", s, b, i) for s, c in cases.items() for i, b in enumerate(c[2])], "repo_root string, sha string, branch string, pos int"), df([("r", b, t) for b, t in tips.items()], "repo_root string, branch string, tip timestamp"))
    assert {r.sha: (r.branch, r.fate) for r in got.collect()} == {
        "anc": ("main", "shipped"), "anc0": (None, "shipped"), "cherry": ("old", "shipped"), "fresh": ("f", "in_flight"), "dormant": ("old", "unshipped"), "bare": (None, "unshipped"), "mixed": ("old", "in_flight"),
        "unknown": ("null", "unshipped"), "edge": ("edge", "in_flight"), "past": ("past", "unshipped"), "remote": ("old", "unshipped"), "onlydef": ("main", "in_flight"),
    }
    assert C.fate_tally(got).first().line == "3 shipped, 4 in flight, 5 unshipped"


def test_key_values(spark):
    got = key_values(spark.createDataFrame([("f", "a: 1\n a : 'x: y' \nnone\n: z\nb: \"q\"\r\nc: '\n"), ("g", "")], "file_path string, value string")).collect()
    assert {r.file_path: r.kv for r in got} == {"f": {"a": "x: y", "b": "q", "c": "'"}, "g": {}}


def test_facts_from_texts(spark):
    df, day = spark.createDataFrame, lambda d: (T0 - timedelta(days=d)).strftime("%Y-%m-%dT%H:%M:%SZ")
    repos = df([("r", "origin/trunk", ["trunk", "f"], "f"), ("q", None, ["own"], "own"), ("z", None, ["x"], None)], "repo_root string, head string, heads array<string>, current string")
    recent = df([("r", f"a\x1f{day(1)}\nb\x1f{day(2)}\nc\x1f{day(3)}\nd\x1f{day(99)}"), ("q", f"k\x1f{day(1)}"), ("z", f"k\x1f{day(1)}")], "repo_root string, value string")
    containing = df([("r", "a", "trunk\norigin\n  origin/trunk"), ("r", "b", "(HEAD detached)\nf"), ("r", "c", "origin/old\n"), ("q", "k", "own")], "repo_root string, sha string, value string")
    tips = df([("r", "f", day(2)), ("r", "origin/old", day(40)), ("r", "trunk", None), ("q", "own", day(1))], "repo_root string, branch string, value string")
    cherries = df([("r", "origin/old", "- c\n+ b"), ("r", "trunk", "- b")], "repo_root string, branch string, value string")
    ancestors = df([("r", "a", 0), ("r", "b", 1)], "repo_root string, sha string, code int")
    got = C.fates(**C.gather_facts(repos, recent, containing, tips, cherries, ancestors, F.lit(T0)))
    assert sorted(map(tuple, got.collect())) == [("q", "k", "own", "in_flight"), ("r", "a", "trunk", "shipped"), ("r", "b", "f", "in_flight"), ("r", "c", "old", "shipped")]


def test_reachable_and_roots(spark):
    g = spark.createDataFrame([("r", "a", []), ("r", "b", ["a"]), ("r", "c", ["a", None]), ("r", "m", ["b", "c", "gone"]), ("q", "a", None)], "repo_root string, sha string, parents array<string>")
    refs = spark.createDataFrame([("r", "main", "b"), ("r", "top", "m"), ("r", "none", "zz"), ("q", "main", "a")], "repo_root string, ref string, sha string")
    got = sorted((r.repo_root, r.ref, r.sha) for r in R.reachable(g, refs).collect())
    assert got == [("q", "main", "a")] + [("r", "main", x) for x in "ab"] + [("r", "top", x) for x in "abcm"]
    cwd = spark.createDataFrame([("/s/a/b",), ("/s/ab",), ("/s/a/",), ("/s",), ("x/y",), (None,), ("",)], "cwd string")
    roots = spark.createDataFrame([("/s/a",), ("/s/a/b/",), ("x",)], "repo_root string")
    assert {r.cwd: r.repo_root for r in C.repo_of_cwd(cwd, roots).collect()} == {"/s/a/b": "/s/a/b", "/s/ab": None, "/s/a/": "/s/a", "/s": None, "x/y": "x"}


def test_state_and_urls():
    assert parse_state('{"lastSyncAt": 3, "surfaces": {"a": "x", "b": 1}}') == {"lastSyncAt": None, "surfaces": {"a": "x"}}
    assert parse_state("broken") == {"lastSyncAt": None, "surfaces": {}}
    assert secure_url("http://127.0.0.1:3") and secure_url("https://h.example")
    for bad in ("http://h.example", "ftp://localhost", "nothing"):
        with pytest.raises(ValueError):
            secure_url(bad)


def test_batches_and_suffixes(spark):
    df = batches(spark.range(5).withColumn("k", F.lit(1)), 2, ["k"], ["id"])
    assert [r.batch_id for r in df.orderBy("id").collect()] == [0, 0, 1, 1, 2]
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("k"), (F.col("id") % 37).alias("file"), F.lit(None).cast("string").alias("z"))
    whole = batches(rows, 7, ["k"], ["file", "id"])
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r[c] for c in whole.columns) for r in batches(rows, 7, ["k"], ["file", "id"], ["file", "z"]).collect())
    got = suffix_duplicates(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "i string, o int"), "i", ["o"])
    assert sorted((r.o, r.i) for r in got.collect()) == [(1, "a"), (2, "a:2"), (3, "b"), (4, "a:3")]


def test_sync_is_incremental_and_idempotent(spark, tmp_path):
    logs, book = tmp_path / "logs", Ledger(spark, str(tmp_path / "book"))
    write(logs / "p" / "a.jsonl", [assistant("r1"), assistant("r1"), assistant("r2")])
    bases = {"claude-code": [str(logs)]}
    assert book.sync(bases=bases, now=T0)["claude-code"] == 2
    write(logs / "p" / "b.jsonl", [assistant("late", time="2024-05-01T09:00:00Z"), assistant("r3", time="2024-05-01T10:00:01Z")])
    assert book.sync(bases=bases, now=T0 + timedelta(hours=1))["claude-code"] == 1
    assert book.sync(full=True, bases=bases, now=T0 + timedelta(hours=1))["claude-code"] == 1
    assert book.skipped == {"claude-code": 4, "copilot-cli": 0, "codex": 0}
    assert spark.read.parquet(str(tmp_path / "book" / "wire" / "events")).agg(F.sum("n_events")).first()[0] == 4
    assert sorted(r.external_id for r in book.events().collect()) == ["late", "r1", "r2", "r3"]
    body = wire_events(book.events().where("batch_id = 0"), spark.createDataFrame([("u", None, None, None)], S.schemas.ACCOUNT)).first()
    assert json.loads(body.body)["account"] == {"accountUuid": "u"} or json.loads(body.body)["account"] == {"account_uuid": "u"}
    assert rollup(book.events(), ["model"]).where("model is null").first().tokens == 4 * 18
    book.exclude("secret")
    cwd = spark.createDataFrame([("/w", "/src/app")], "cwd string, repo_root string")
    log = spark.createDataFrame([("/src/app", "c1", T0 + timedelta(minutes=30), 1, 1, 1, 0)], "repo_root string, sha string, committed_at timestamp, lines_added long, lines_deleted long, files_changed long, ord int")
    assert {r.external_id: (r.commit_sha, r.branch) for r in book.attribute(book.events(), cwd, log).collect()} == {i: ("c1", "b") for i in ("late", "r1", "r2", "r3")}
    files = spark.createDataFrame([("/src/app", 4, bytearray(b"a\nb\n"))], "repo_root string, length long, content binary")
    book.attribute(book.events(), cwd, log, files)
    wired = json.loads(spark.read.parquet(str(tmp_path / "book" / "wire" / "attributions")).first().body)
    assert wired["repos"] == [{"name": "app", "totalLoc": 3, "fileCount": 1}] and len(wired["attributions"]) == 4 and wired["attributions"][0]["branch"] == "b"
    df = spark.createDataFrame
    facts = {"repos": df([("/src/app", "main", T0)], "repo_root string, default_branch string, now timestamp"), "shas": df([("/src/app", "c1")], "repo_root string, sha string"), "ancestors": df([], "repo_root string, sha string"), "cherries": df([], "repo_root string, sha string"), "contains": df([], "repo_root string, sha string, branch string, pos int"), "tips": df([], "repo_root string, branch string, tip timestamp")}
    assert book.classify(facts).first().fate == "unshipped"
    assert json.loads(spark.read.parquet(str(tmp_path / "book" / "wire" / "fates")).first().body) == {"repos": [], "attributions": [], "fates": [{"repoName": "app", "commitSha": "c1", "branch": None, "fate": "unshipped"}]}
    book.exclude("app")
    assert book.attribute(book.events(), cwd, log).count() == 0


def test_stream_drops_repeats(spark, tmp_path):
    from sparkledger.streaming.ingest import event_stream, once, run_available

    write(tmp_path / "in" / "a.json", [{"external_id": "x", "occurred_at": "2024-05-01T10:00:00Z", "model": "m", "tokens": 1}] * 2 + [{"external_id": "y", "occurred_at": "2024-05-01T10:00:00Z", "model": "m", "tokens": 2}])
    out = once(event_stream(spark, str(tmp_path / "in"), "external_id string, occurred_at timestamp, model string, tokens long"))
    run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.external_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
