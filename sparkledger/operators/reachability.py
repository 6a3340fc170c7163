"""Ancestors in commit graphs, by joins over edges.

A commit's first known parent makes the graph a forest, and the forest falls into lines: each commit goes on, towards the newer
side, to the child from which the longest run of first parents comes. A line is named by the number of its newest commit, and a commit's label is (line, pos), pos
counted from there. Labels come from contracting the forest round by round and from pointer doubling of what is left (see `_labels`), over numbers given to the commits. What a ref reaches is then one number for each line, the smallest pos reached, because with a commit all later ones of its line are reached: a
semi-naive search over lines, whose frontier holds only the stretches that were new in the last round, joined with the edges that leave them. The rounds are as many as the
ways leave lines, not as the history is long. Every round is cut in the shared folder; no repository and no line is gathered in one task, and only counters
reach the driver.

With these numbers most questions need no walk: a ref contains a commit if its number for the commit's line is at most the commit's pos.

Defined results: rows with a null repository, sha or ref take no part; parents that are null or unknown are none; repeated rows of a commit count
once, with all their parents; a commit that is its own first-parent ancestor raises ValueError; empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop, sized
from .commits import RECENT_CAP, RECENT_DAYS, default_branch, real_branches, recent_cap

NODE = ["repo_root", "sha"]


def _cut(df: DataFrame) -> DataFrame:
    return sized(cut(df))


#: Forests of at most so many commits go straight to pointer doubling.
DOUBLED = 200_000


class Lines(NamedTuple):
    """The index of a set of graphs: nodes (repo_root, sha, line, pos) and the edges that leave lines (line, src, to_line, to_pos). A line is a number, of one repository."""

    nodes: DataFrame
    edges: DataFrame


def line_index(commits: DataFrame) -> Lines:
    """commits: repo_root, sha, parents (array)."""
    placed = F.transform("parents", lambda p, i: F.struct(i.alias("place"), p.alias("parent")))
    known = commits.where("repo_root is not null and sha is not null").groupBy(*NODE).agg(F.flatten(F.collect_set(placed)).alias("parents"))
    known = _cut(known.withColumn("id", F.monotonically_increasing_id()))
    asked = known.select("repo_root", "sha", F.col("id").alias("child"), F.explode_outer("parents").alias("p")).select("repo_root", "child", "p.place", F.when(F.col("p.parent") != F.col("sha"), F.col("p.parent")).alias("sha"))
    edges = _cut(asked.join(known.select(*NODE, F.col("id").alias("parent")), NODE, "left").select("child", "place", "parent"))
    first = edges.groupBy("child").agg(F.min_by("parent", F.when(F.col("parent").isNotNull(), F.col("place"))).alias("up"))
    state = _cut(first.select(F.col("child").alias("id"), "up", F.lit(1).cast("long").alias("far"), F.lit(False).alias("leaf"), F.lit(None).cast(BEST).alias("best")))
    label = _labels(state)
    nodes = _cut(known.join(label, "id").select(*NODE, "line", "pos"))
    source = label.select(F.col("id").alias("child"), "line", F.col("pos").alias("src"))
    target = label.select(F.col("id").alias("parent"), F.col("line").alias("to_line"), F.col("pos").alias("to_pos"))
    across = edges.where("parent is not null").join(source, "child").join(target, "parent").where("line <> to_line")
    across = _cut(across.groupBy("line", "src", "to_line").agg(F.min("to_pos").alias("to_pos")))
    drop(known, edges, label)
    return Lines(nodes, across)


#: The longest run of first parents that ends at a commit, as far as it is known: its length and its newest commit.
BEST = "struct<pos:long,line:long>"


def _onward(best: Column, far: Column) -> Column:
    """What a commit's best run is for the commit `far` first parents above."""
    return F.when(best.isNotNull(), F.struct((best["pos"] + far).alias("pos"), best["line"].alias("line")))


def _labels(state: DataFrame) -> DataFrame:
    """id, line and pos of each row of a forest (id, up, far, leaf, best), which is dropped.

    A round takes out all leaves known as such, and of the commits with one child those whose hash exceeds their child's and their parent's, a third of
    a chain; the child then hangs on the parent. Rounds shrink by a factor, so what all of them shuffle together grows with the number of commits alone. Pointer doubling
    labels what is left, and the rounds, last first, label what they took out.
    """
    own = F.struct(F.lit(0).cast("long").alias("pos"), F.col("id").alias("line"))
    final = lambda best: (F.col("id"), best["line"].alias("line"), best["pos"].alias("pos"))
    taken, left, seed = [], state.count(), 0
    while left > DOUBLED:
        seed += 1
        rank = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: E731, B023
        leaf = F.col("leaf")
        kids = state.where("up is not null").repartition("up").groupBy("up").agg(
            F.count_if(~leaf).alias("kids"), F.min(F.when(~leaf, F.col("id"))).alias("child"), F.min(F.when(~leaf, F.col("far"))).alias("below"),
            F.max(F.when(leaf, _onward(F.coalesce("best", own), F.col("far")))).alias("raked"),
        ).withColumnRenamed("up", "id")
        met = state.join(kids.hint("merge"), "id", "left").withColumn("best", F.greatest("best", "raked")).drop("raked")
        inner = ~leaf & F.coalesce(F.col("kids") == 1, F.lit(False)) & F.col("up").isNotNull()
        met = met.withColumn("short", inner & (rank("id") > rank("child")) & F.coalesce(rank("id") > rank("up"), F.lit(False)))
        said = met.where("short").select(F.inline(F.array(
            F.struct(F.col("child").alias("id"), F.col("up").alias("new_up"), F.col("far").alias("more"), F.lit(None).cast(BEST).alias("passed")),
            F.struct(F.col("up").alias("id"), F.lit(None).cast("long").alias("new_up"), F.lit(None).cast("long").alias("more"), _onward(F.col("best"), F.col("far")).alias("passed")),
        ))).where("more is not null or passed is not null")
        said = said.repartition("id").groupBy("id").agg(F.max("new_up").alias("new_up"), F.max("more").alias("more"), F.max("passed").alias("passed"))
        stays = met.where(~leaf & ~F.col("short")).join(said.hint("merge"), "id", "left")
        none = F.lit(None).cast("long")
        stays = stays.select("id", F.coalesce("new_up", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), (F.coalesce("kids", F.lit(0)) == 0).alias("leaf"), F.greatest("best", "passed").alias("best"), F.lit(False).alias("gone"), none.alias("child"), none.alias("below"))
        goes = met.where(leaf | F.col("short")).select("id", "up", "far", "leaf", "best", F.lit(True).alias("gone"), F.when(~leaf, F.col("child")).alias("child"), F.when(~leaf, F.col("below")).alias("below"))
        both = cut(stays.unionAll(goes))
        if not taken:
            drop(state)
        taken.append(both)
        state = both.where("not gone").select("id", "up", "far", "leaf", "best").hint("merge")
        fewer = state.count()
        left, stuck = fewer, fewer == left
        if stuck:
            break
    state = _doubled(state.select("id", "up", "far", F.coalesce("best", own).alias("best")), left)
    labels = [cut(state.select(*final(F.col("best"))))]
    drop(state)
    for both in reversed(taken):
        gone = both.where("gone")
        labels.append(cut(gone.where("leaf").select(*final(F.coalesce("best", own)))))
        so_far = _union(labels).select(F.col("id").alias("child"), F.struct((F.col("pos")).alias("pos"), "line").alias("under"))
        through = gone.where("not leaf").hint("merge").join(so_far.hint("merge"), "child")
        labels.append(cut(through.select(*final(F.greatest("best", _onward(F.col("under"), F.col("below")))))))
        drop(both)
    out = _cut(_union(labels))
    drop(*labels)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    """Tables made by `cut`, all of one schema, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._cut_at for t in tables))


def _doubled(state: DataFrame, total: int) -> DataFrame:
    """state: id, up, far, best. The same rows with their best runs, by pointer doubling."""
    state, step = _cut(state), 1
    while not state.where("up is not null").isEmpty():
        if step > total:
            raise ValueError("a commit is its own ancestor")
        # what the commits say that stand `step` first parents above, and where their jumps lead
        sent = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.max(_onward(F.col("best"), F.col("far"))).alias("sent"))
        onward = state.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        grown = state.join(sent, "id", "left").withColumn("best", F.greatest("best", "sent")).join(onward, "up", "left")
        fresh = _cut(grown.select("id", F.col("next").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "best"))
        drop(state)
        state, step = fresh, step * 2
    return state


def reach(index: Lines, refs: DataFrame) -> DataFrame:
    """refs: repo_root, ref, sha. Rows (repo_root, ref, line, pos): the ref reaches the commits of the line from pos on. Refs of unknown commits reach nothing."""
    key = ["repo_root", "ref", "line"]
    asked = _cut(refs.where("ref is not null").select("repo_root", "ref", "sha"))
    met = asked.join(index.nodes, NODE).groupBy(*key).agg(F.min("pos").alias("pos"))
    reached = _cut(met)
    front, old = reached.withColumn("until", F.lit(None).cast("long")), None
    while not front.isEmpty():
        left = front.join(index.edges, "line").where("src >= pos and (until is null or src < until)")
        got = left.groupBy("repo_root", "ref", F.col("to_line").alias("line")).agg(F.min("to_pos").alias("pos"))
        fresh = _cut(got.join(reached.withColumnRenamed("pos", "until"), key, "left").where("until is null or pos < until").select(*key, "pos", "until"))
        both = _cut(reached.union(fresh.select(*key, "pos")).groupBy(*key).agg(F.min("pos").alias("pos")))
        drop(old, reached)
        front, old, reached = fresh, fresh, both
    drop(old, asked)
    return reached


def containing(index: Lines, reached: DataFrame, shas: DataFrame) -> DataFrame:
    """repo_root, sha and ref of each ref that contains each of the shas (repo_root, sha), without a walk."""
    return _held(shas.select(*NODE).distinct().join(index.nodes, NODE), reached)


def _held(labelled: DataFrame, reached: DataFrame) -> DataFrame:
    """labelled: rows of an index's nodes."""
    return labelled.join(reached.withColumnRenamed("pos", "from"), ["repo_root", "line"]).where(F.col("pos") >= F.col("from")).select(*NODE, "ref")


def reachable(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """repo_root, ref and sha of every commit that is the ref's own or an ancestor of it; unknown commits have no ancestors.

    commits: repo_root, sha, parents (array); refs: repo_root, ref, sha.
    """
    index = line_index(commits)
    return _held(index.nodes, reach(index, refs)).select("repo_root", "ref", "sha")


def ancestors(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (repo_root, sha, other) in which sha is other or an ancestor of it."""
    index = line_index(commits)
    asked = pairs.select("repo_root", "sha", "other").distinct()
    reached = reach(index, asked.select("repo_root", F.col("other").alias("ref"), F.col("other").alias("sha")).distinct())
    labelled = asked.join(index.nodes, NODE).join(reached.select("repo_root", F.col("ref").alias("other"), "line", F.col("pos").alias("from")), ["repo_root", "other", "line"])
    return labelled.where(F.col("pos") >= F.col("from")).select("repo_root", "sha", "other")


def patch_id(diff: Column) -> Column:
    """A digest of what a diff changes; null where it changes nothing.

    White space, places of hunks and object names do not count, nor does the order of the files.
    """
    kept = lambda line: ~line.rlike(r"^(index |similarity |dissimilarity |old mode |new mode )") & (line != "")
    lines = lambda part: F.transform(F.filter(F.split(part, "\n"), kept), lambda x: F.when(x.startswith("@@"), F.lit("@@")).otherwise(F.regexp_replace(x, r"\s+", "")))
    files = F.filter(F.split(F.concat(F.lit("\n"), diff), "\ndiff --git "), lambda part: part.contains("@@") | part.contains("GIT binary patch") | part.contains("Binary files"))
    each = F.array_sort(F.transform(files, lambda part: F.sha2(F.array_join(lines(part), "\n"), 256)))
    return F.when(F.size(each) > 0, F.sha2(F.array_join(each, ""), 256))


def equivalents(index: Lines, reached: DataFrame, patches: DataFrame, tips: DataFrame, shas: DataFrame | None = None) -> DataFrame:
    """repo_root, sha of commits of a branch, not of the default branch, whose patch a commit of the default branch outside the branch has too.

    patches: repo_root, sha, patch (null ones, and those of merges, left out); tips: repo_root, ref, default_ref, both of `reached`; shas: only these commits of branches.
    """
    labelled = _cut(patches.where("patch is not null").join(index.nodes, NODE).select(*NODE, "patch", "line", "pos"))
    of = lambda name: reached.select("repo_root", F.col("ref").alias(name), "line", F.col("pos").alias("from"))
    shared = labelled.groupBy("repo_root", "patch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repo_root", "patch")
    twice = labelled.join(shared, ["repo_root", "patch"], "left_semi").hint("merge")
    asked = twice if shas is None else twice.join(shas.select(*NODE).distinct(), NODE, "left_semi")
    held = lambda rows, name: rows.join(of(name), ["repo_root", "line"]).where(F.col("pos") >= F.col("from")).drop("from")
    pairs = tips.select("repo_root", "ref", "default_ref").distinct()
    own = held(asked, "ref").join(pairs, ["repo_root", "ref"])
    own = _outside(own, reached, "default_ref")
    theirs = held(twice, "default_ref").join(pairs, ["repo_root", "default_ref"])
    theirs = _outside(theirs, reached, "ref").select("repo_root", "ref", "default_ref", "patch").distinct()
    return own.join(theirs, ["repo_root", "ref", "default_ref", "patch"], "left_semi").select(*NODE).distinct()


def _outside(rows: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    """Rows (repo_root, line, pos, and a ref in the column `name`) of commits that the ref does not contain."""
    limit = reached.select("repo_root", F.col("ref").alias(name), "line", F.col("pos").alias("from"))
    return rows.join(limit, ["repo_root", name, "line"], "left").where(F.col("from").isNull() | (F.col("pos") < F.col("from"))).drop("from")


def graph_facts(commits: DataFrame, refs: DataFrame, repos: DataFrame, now: Column, patches: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of `commits.fates` from the graph alone.

    commits: repo_root, sha, parents, committed_at; refs: repo_root, ref (short names, remote ones with `origin/`), sha; repos: repo_root, head (what origin's
    head points to, or null), current (the branch checked out, or null); patches: repo_root, sha, patch (see `patch_id`). Commits of the last RECENT_DAYS that a ref contains
    are classified, the newest RECENT_CAP of each repository. Repositories without a default branch have no fates.
    """
    names = (F.regexp_replace("head", "^origin/", ""), F.lit("main"), F.lit("master"), F.col("current"))
    ladder = F.array(*(F.struct(F.lit(rank).alias("rank"), name.cast("string").alias("branch")) for rank, name in enumerate(names)))
    candidates = repos.select("repo_root", F.explode(ladder).alias("c")).select("repo_root", "c.rank", "c.branch").where("branch is not null and branch <> ''")
    local = refs.where(~F.col("ref").startswith("origin/"))
    chosen = _cut(default_branch(candidates, local.select("repo_root", F.col("ref").alias("branch")), ["repo_root"]))
    index = line_index(commits.join(chosen, "repo_root", "left_semi"))
    reached = reach(index, refs.join(chosen, "repo_root", "left_semi"))
    dated = commits.groupBy(*NODE).agg(F.max("committed_at").alias("committed_at"))
    late = dated.where(F.col("committed_at") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
    held = containing(index, reached, late)
    shas = _cut(recent_cap(late.join(held.select(*NODE).distinct(), NODE, "left_semi"), ["repo_root"], [F.desc("committed_at"), "sha"], RECENT_CAP).select(*NODE))
    contains = _cut(real_branches(containing(index, reached, shas).withColumnRenamed("ref", "branch")).withColumn("pos", F.concat(F.when(F.col("branch").startswith("origin/"), "1").otherwise("0"), "branch")))
    default = (F.col("branch") == F.col("default_branch")) | (F.col("branch") == F.concat(F.lit("origin/"), "default_branch"))
    others = contains.join(chosen, "repo_root").where(~default).select("repo_root", F.col("branch").alias("ref"), F.col("default_branch").alias("default_ref")).distinct()
    none = shas.where("false")
    single = commits.where(F.coalesce(F.size("parents"), F.lit(0)) < 2).select(*NODE).distinct()
    return {
        "repos": chosen.withColumn("now", now),
        "shas": shas,
        "ancestors": contains.join(chosen, "repo_root").where("branch = default_branch").select(*NODE),
        "cherries": none if patches is None else equivalents(index, reached, patches.join(single, NODE, "left_semi"), others, shas),
        "contains": contains,
        "tips": refs.join(dated, NODE, "left").select("repo_root", F.col("ref").alias("branch"), F.col("committed_at").alias("tip")),
    }
