"""Reachability, containment and equal patches against walks in plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import commits as C
from sparkledger.operators import reachability as R

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def walk(graph, tip):
    seen, todo = set(), [tip] if tip in graph else []
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [p for p in graph[x] if p in graph]
    return seen


def table(spark, graphs):
    rows = [(r, s, list(ps)) for r, g in graphs.items() for s, ps in g.items()]
    return spark.createDataFrame(rows, "repo_root string, sha string, parents array<string>")


def random_graph(seed, n, merges):
    r = random.Random(seed)
    return {f"c{i}": [f"c{r.randrange(max(0, i - 12), i)}" for _ in range(1 + (r.random() < merges))] if i else [] for i in range(n)}


def zigzag(n):
    """Each step goes on by the second parent; the first is a stub."""
    return {f"z{i}": [f"stub{i}", f"z{i - 1}"] if i else [] for i in range(n)} | {f"stub{i}": [] for i in range(1, n)}


@pytest.mark.parametrize("graph", [random_graph(1, 300, 0.5), random_graph(2, 200, 0.95), zigzag(12), {"a": ["a", "b"], "b": None or [], "c": ["b", "b", "gone"]}], ids=["half", "merges", "zigzag", "odd"])
def test_reachable_equals_walks(spark, graph):
    r = random.Random(5)
    tips = r.sample(sorted(graph), min(6, len(graph))) + ["unknown"]
    refs = spark.createDataFrame([("r", f"t{i}", t) for i, t in enumerate(tips)], "repo_root string, ref string, sha string")
    got = sorted((x.ref, x.sha) for x in R.reachable(table(spark, {"r": graph}), refs).collect())
    assert got == sorted((f"t{i}", s) for i, t in enumerate(tips) for s in walk(graph, t))


def test_long_chain(spark):
    """A hundred thousand commits in a line, a branch in its middle that is merged at its end: rounds grow with the logarithm."""
    n = 100_000
    line = spark.range(n).select(F.lit("r").alias("repo_root"), F.col("id").cast("string").alias("sha"), F.when(F.col("id") == 0, F.array().cast("array<string>")).when(F.col("id") == n - 1, F.array((F.col("id") - 1).cast("string"), F.lit("s9"))).otherwise(F.array((F.col("id") - 1).cast("string"))).alias("parents"))
    side = spark.range(10).select(F.lit("r"), F.format_string("s%d", "id"), F.array(F.when(F.col("id") == 0, F.lit("50000")).otherwise(F.format_string("s%d", F.col("id") - 1))))
    refs = spark.createDataFrame([("r", "main", str(n - 1)), ("r", "old", "70000"), ("r", "side", "s4")], "repo_root string, ref string, sha string")
    got = {x.ref: x["count"] for x in R.reachable(line.union(side), refs).groupBy("ref").count().collect()}
    assert got == {"main": n + 10, "old": 70001, "side": 50006}


def test_ancestors_and_cycles(spark):
    graph = random_graph(3, 120, 0.4)
    r = random.Random(6)
    pairs = [(r.choice(sorted(graph)), r.choice(sorted(graph))) for _ in range(60)] + [("c5", "c5"), ("gone", "c5"), ("c5", "gone")]
    df = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_root string, sha string, other string")
    got = {(x.sha, x.other) for x in R.ancestors(table(spark, {"r": graph}), df).collect()}
    assert got == {(a, b) for a, b in pairs if b in graph and a in walk(graph, b)}
    with pytest.raises(ValueError):
        R.line_index(table(spark, {"r": {"a": ["b"], "b": ["a"]}}))


def test_nothing(spark):
    none = spark.createDataFrame([], "repo_root string, sha string, parents array<string>")
    assert R.reachable(none, spark.createDataFrame([], "repo_root string, ref string, sha string")).count() == 0
    odd = spark.createDataFrame([(None, "a", []), ("r", None, ["a"]), ("r", "a", [None, "b"]), ("r", "b", None), ("r", "b", None)], "repo_root string, sha string, parents array<string>")
    got = R.reachable(odd, spark.createDataFrame([("r", "m", "a"), (None, "m", "a"), ("r", None, "a")], "repo_root string, ref string, sha string")).collect()
    assert sorted(map(tuple, got)) == [("r", "m", "a"), ("r", "m", "b")]


def test_patch_ids(spark):
    def diff(files, at, spaces, index):
        return "".join(f"diff --git a/{f} b/{f}\nindex {index}..ff 100644\n--- a/{f}\n+++ b/{f}\n@@ -{at},3 +{at},4 @@ def x\n keep\n+{spaces}{line}\n" for f, line in files)

    cases = {
        "one": diff([("a", "x = 1"), ("b", "y")], 3, "  ", "1a"), "same": diff([("b", "y"), ("a", "x  =  1")], 90, "\t", "9c"), "other": diff([("a", "x = 2"), ("b", "y")], 3, "  ", "1a"),
        "file": diff([("c", "x = 1"), ("b", "y")], 3, "  ", "1a"), "empty": "", "mode": "diff --git a/a b/a\nold mode 1\nnew mode 2\n",
    }
    rows = spark.createDataFrame([*cases.items(), ("null", None)], "sha string, diff string").select("sha", R.patch_id(F.col("diff")).alias("id")).collect()
    got = {r.sha: r.id for r in rows}
    assert got["one"] == got["same"] and len({got[x] for x in ("one", "other", "file")}) == 3 and got["empty"] is got["mode"] is got["null"] is None


def test_fates_from_the_graph(spark):
    day = lambda d: NOW - timedelta(days=d)
    # main: m0..m3; f (fresh) from m1; old (dormant) from m1, o2 brought into main as m3; squash merge; detached has no ref
    commits = {"m0": ([], 80), "m1": (["m0"], 70), "m2": (["m1"], 60), "m3": (["m2"], 50), "f1": (["m1"], 5), "f2": (["f1", "m2"], 2), "o1": (["m1"], 45), "o2": (["o1"], 44), "lost": (["m3"], 1), "past": ([], 200)}
    patches = {"m3": "P", "o2": "P", "f2": "P", "o1": "Q", "m0": "Q"}
    refs = [("r", "main", "m3"), ("r", "f", "f2"), ("r", "origin/f", "f1"), ("r", "origin/old", "o2"), ("r", "origin", "m3"), ("q", "own", "m0"), ("z", "x", "m0")]
    df = spark.createDataFrame
    rows = [("r", s, ps, day(d)) for s, (ps, d) in commits.items()] + [("q", "m0", [], day(1)), ("z", "m0", [], day(1))]
    table_ = df(rows, "repo_root string, sha string, parents array<string>, committed_at timestamp")
    repos = df([("r", "origin/main", "f"), ("q", None, "own"), ("z", None, None)], "repo_root string, head string, current string")
    facts = R.graph_facts(table_, df(refs, "repo_root string, ref string, sha string"), repos, F.lit(NOW), df([("r", s, p) for s, p in patches.items()], "repo_root string, sha string, patch string"))
    assert sorted((x.sha, x.branch) for x in facts["contains"].where("repo_root = 'r' and sha like 'f%'").collect()) == [("f1", "f"), ("f1", "origin/f"), ("f2", "f")]
    got = {(x.repo_root, x.sha): (x.branch, x.fate) for x in C.fates(**facts).collect()}
    assert got == {
        **{("r", s): ("main", "shipped") for s in ("m0", "m1", "m2", "m3")},
        ("r", "f1"): ("f", "in_flight"), ("r", "f2"): ("f", "in_flight"), ("r", "o1"): ("old", "unshipped"), ("r", "o2"): ("old", "shipped"), ("q", "m0"): ("own", "shipped"),
    }


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """Files of 150000 commits are far smaller than Spark's limit for broadcasts, their rows are not."""
    plans, plain = [], R.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(R, "cut", seen)
    n = 150_000
    line = spark.range(n).select(F.lit("r").alias("repo_root"), F.col("id").cast("string").alias("sha"), F.array(F.when(F.col("id") > 0, (F.col("id") - 1).cast("string"))).alias("parents"))
    index = R.line_index(line)
    assert len(plans) > 3 and not [p for p in plans if "BroadcastExchange" in p]
    small = R.reach(index, spark.createDataFrame([("r", "m", "9")], "repo_root string, ref string, sha string"))
    assert "BroadcastHashJoin" in R.containing(index, small, index.nodes)._jdf.queryExecution().executedPlan().toString()


def test_contracted_forests(spark, monkeypatch):
    """Lines of small forests, contracted to five commits: heights, whole lines, and rings."""
    monkeypatch.setattr(R, "DOUBLED", 5, raising=False)
    graphs = {"r": random_graph(7, 250, 0.3) | {f"x{i}": [f"x{i - 1}"] if i else [] for i in range(80)}, "q": random_graph(8, 60, 0.6)}
    want = {}
    for r, g in graphs.items():
        for x in g:
            n = 0
            while x is not None:  # each commit pushes the heights of its first parents up
                want[r, x] = max(want.get((r, x), 0), n)
                x, n = (g[x] or [None])[0], n + 1
    rows = R.line_index(table(spark, graphs)).nodes.collect()
    assert {(x.repo_root, x.sha): x.pos for x in rows} == want and len(rows) == len(want)
    lines = {}
    for x in sorted(rows, key=lambda x: x.pos):
        lines.setdefault(x.line, []).append(x)
    for line in lines.values():
        assert [x.pos for x in line] == list(range(len(line)))
        assert all(graphs[a.repo_root][a.sha][0] == b.sha and a.repo_root == b.repo_root for a, b in zip(line, line[1:]))
    with pytest.raises(ValueError):
        R.line_index(table(spark, {"r": {f"a{i}": [f"a{(i + 1) % 40}"] for i in range(40)}}))


def test_rows_written_grow_with_the_commits(spark, monkeypatch):
    """A chain is labelled with a bounded number of rows for each commit, not one for each doubling of its length."""
    written, plain, n = [], R.cut, 8192

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "cut", counted)
    monkeypatch.setattr(R, "DOUBLED", 200, raising=False)
    R.line_index(spark.range(n).select(F.lit("r").alias("repo_root"), F.col("id").cast("string").alias("sha"), F.array(F.when(F.col("id") > 0, (F.col("id") - 1).cast("string"))).alias("parents")))
    assert sum(written) < 12 * n


def test_fates_number_the_orders_once(spark, tmp_path, monkeypatch):
    """The commits of graph_fates are made of the orders in one written table; equal patches are sought for the commits that get a fate."""
    from sparkledger import queries as Q

    spark.range(3000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 1500).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    plans, asked, plain, equal = [], [], R.cut, R.equivalents

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(R, "cut", seen)
    monkeypatch.setattr(Q, "cut", seen, raising=False)
    monkeypatch.setattr(R, "equivalents", lambda *a: (asked.append(a[4:]), equal(*a))[1])
    out = Q.graph_fates(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len([p for p in plans if "o_orderkey" in p]) == 1 and len(asked[0]) == 1
    rows = out.collect()
    assert len({(x.repo_root, x.sha) for x in rows}) == len(rows) > 0 and {x.fate for x in rows} == {"shipped", "in_flight", "unshipped"}
