"""Repositories and commits: log text, attribution, sizes, default branches, fates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant import iso_timestamp, leading_int
from .asof import asof_forward
from .filters import ATTRIBUTED_SURFACES, allowed

FRESH_DAYS, RECENT_CAP, RECENT_DAYS, FILE_CAP, FILE_BYTES = 14, 2000, 90, 5000, 1 << 20
NOISE_BRANCHES = ("origin", "origin/HEAD")


def parse_commit_log(texts: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Records `\\x1e sha \\x1f date` with numstat lines below: sha, committed_at, sums of lines, files, ord."""
    rec = texts.select(*keys, F.posexplode(F.split(text, "\u001e")).alias("ord", "rec")).where(F.col("rec").rlike(r"\S"))
    rows = F.split("rec", "\n")
    head = F.split(F.get(rows, F.lit(0)), "\u001f")
    stats = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x.rlike(r"\S"))
    total = lambda k: F.aggregate("stats", F.lit(0).cast("long"), lambda s, x: s + leading_int(F.get(F.split(x, "\t"), F.lit(k))))
    out = rec.select(*keys, "ord", F.get(head, F.lit(0)).alias("sha"), iso_timestamp(F.trim(F.get(head, F.lit(1)))).alias("committed_at"), stats.alias("stats"))
    out = out.where("length(sha) > 0 and committed_at is not null")
    return out.select(*keys, "sha", "committed_at", total(0).alias("lines_added"), total(1).alias("lines_deleted"), F.size("stats").cast("long").alias("files_changed"), "ord")


def parse_recent(texts: DataFrame, keys: list[str], now: Column, text: str = "value") -> DataFrame:
    """Lines `sha \\x1f date`; malformed ones are skipped and not counted, the first RECENT_CAP of the last RECENT_DAYS stay. A date that does not parse is null and stays."""
    rows = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    parts = F.split("line", "\u001f")
    rows = rows.select(*keys, "ord", F.trim(F.get(parts, F.lit(0))).alias("sha"), F.trim(F.get(parts, F.lit(1))).alias("date")).where("length(sha) > 0 and length(date) > 0")
    rows = rows.select(*keys, "ord", "sha", iso_timestamp(F.col("date")).alias("committed_at"))
    rows = rows.where(F.col("committed_at").isNull() | (F.col("committed_at") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")))
    return recent_cap(rows, keys, ["ord"])


def recent_cap(rows: DataFrame, keys: list[str], order: list, cap: int = RECENT_CAP) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def real_branches(df: DataFrame, branch: str = "branch") -> DataFrame:
    """Without empty names, detached heads and remote heads."""
    b = F.trim(F.col(branch))
    return df.withColumn(branch, b).where((b != "") & ~b.startswith("(") & ~b.isin(*NOISE_BRANCHES))


def patch_equivalents(texts: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """The shas of `- sha` lines, distinct over all branches."""
    line = texts.select(*keys, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").startswith("- "))
    return line.select(*keys, F.trim(F.substring("line", 3, 1 << 20)).alias("sha")).where("sha <> ''").distinct()


def default_branch(candidates: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """candidates: rank, branch; heads: branch. The best candidate that exists; repositories without one drop."""
    return candidates.join(heads.select(*keys, "branch").distinct(), [*keys, "branch"], "left_semi").groupBy(*keys).agg(F.min_by("branch", "rank").alias("default_branch"))


def repo_name(root: Column) -> Column:
    return F.element_at(F.split(root, "/"), -1)


def repo_size(files: DataFrame, keys: list[str]) -> DataFrame:
    """files: length, content. File count and lines; null lines over FILE_CAP files; large and binary files have no lines.

    Line ends are counted on bytes, so that a file in any encoding has its lines.
    """
    text = (F.col("length") <= FILE_BYTES) & ~F.contains(F.col("content"), F.lit(b"\x00"))
    lines = F.when(text, F.size(F.split(F.decode("content", "ISO-8859-1"), "\n")))
    out = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(lines), F.lit(0)).alias("loc"))
    return out.select(*keys, F.when(F.col("file_count") <= FILE_CAP, F.col("loc")).alias("total_loc"), "file_count")


def last_branch(branch: Column, order: Column) -> Column:
    """Aggregate or window function: the branch of the last row; an empty one is null."""
    return F.max_by(F.nullif(branch, F.lit("")), order)


def repo_of_cwd(cwds: DataFrame, roots: DataFrame) -> DataFrame:
    """cwd and repo_root: the deepest of the known roots that holds the folder, null if none does.

    Every folder is exploded to its parents, which are as many as it has parts, and joined to the roots by equality.
    """
    path = F.regexp_replace("cwd", r"(?<=.)/+$", "")
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.when(n == 1, F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("/"))).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("repo_root")))
    each = cwds.where("cwd is not null and cwd <> ''").select("cwd").distinct().select("cwd", F.explode(parents).alias("p")).select("cwd", "p.depth", "p.repo_root")
    known = roots.select(F.regexp_replace("repo_root", r"(?<=.)/+$", "").alias("repo_root")).distinct()
    return each.join(known.withColumn("hit", F.lit(True)), "repo_root", "left").groupBy("cwd").agg(F.max_by(F.when(F.col("hit"), F.col("repo_root")), F.when(F.col("hit"), F.col("depth"))).alias("repo_root"))


def gather_facts(repos: DataFrame, recent: DataFrame, containing: DataFrame, tips: DataFrame, cherries: DataFrame, ancestors: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables of `fates` from the texts that the version control prints.

    repos: repo_root, head (what origin's head points to, or null), heads (array of local heads), current (the branch checked out);
    recent: repo_root, value (lines sha \\x1f date); containing: repo_root, sha, value (a branch on each line); tips: repo_root, branch, value
    (a date, null if unknown); cherries: repo_root, branch, value (lines `- sha`); ancestors: repo_root, sha and `code`, the exit
    code of the test against the default branch. Repositories without a default branch have no fates.
    """
    names = (F.regexp_replace("head", "^origin/", ""), F.lit("main"), F.lit("master"), F.col("current"))
    ladder = F.array(*(F.struct(F.lit(rank).alias("rank"), name.cast("string").alias("branch")) for rank, name in enumerate(names)))
    candidates = repos.select("repo_root", F.explode(ladder).alias("c")).select("repo_root", "c.rank", "c.branch").where("branch is not null and branch <> ''")
    chosen = default_branch(candidates, repos.select("repo_root", F.explode("heads").alias("branch")), ["repo_root"])
    held = repos.select("repo_root").join(chosen, "repo_root").withColumn("now", now)
    line = containing.select("repo_root", "sha", F.posexplode(F.split("value", "\n")).alias("pos", "branch"))
    other = cherries.join(chosen, "repo_root").where((F.col("branch") != F.col("default_branch")) & (F.col("branch") != F.concat(F.lit("origin/"), "default_branch")))
    return {
        "repos": held,
        "shas": parse_recent(recent, ["repo_root"], now).select("repo_root", "sha").distinct(),
        "ancestors": ancestors.where("code = 0").select("repo_root", "sha"),
        "cherries": patch_equivalents(other, ["repo_root"]),
        "contains": real_branches(line),
        "tips": tips.select("repo_root", "branch", iso_timestamp(F.trim("value")).alias("tip")),
    }


def attribute(events: DataFrame, cwd_repo: DataFrame, commits: DataFrame, deny: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Usage events of attributed surfaces to the first commit at or after them, in their working directory's repository.

    commits: repo_root, sha, committed_at, lines_added, lines_deleted, files_changed, ord. The branch is that of the
    last event with the id in its repository; an empty one is null.
    """
    e = events.where(F.col("surface").isin(*ATTRIBUTED_SURFACES)).select("external_id", "occurred_at", "source_rank", "file_path", "line_no", F.col("metadata.cwd").alias("cwd"), F.col("metadata.git_branch").alias("git_branch")).where("cwd is not null and cwd <> ''")
    e = allowed(e.join(cwd_repo.where("repo_root is not null"), "cwd").withColumn("repo_name", repo_name(F.col("repo_root"))), deny)
    order = F.struct("source_rank", "file_path", "line_no")
    e = e.withColumn("branch", last_branch(F.col("git_branch"), order).over(Window.partitionBy("repo_root", "external_id")))
    hit = asof_forward(e.select("repo_root", "repo_name", "external_id", "occurred_at", "branch"), commits, ["repo_root"], "occurred_at", "committed_at", "ord", bucket_seconds=bucket_seconds)
    return hit.select("external_id", "repo_name", F.col("commit.sha").alias("commit_sha"), F.col("commit.committed_at").alias("committed_at"), "branch", F.col("commit.lines_added").alias("lines_added"), F.col("commit.lines_deleted").alias("lines_deleted"), F.col("commit.files_changed").alias("files_changed"))


def fates(repos: DataFrame, shas: DataFrame, ancestors: DataFrame, cherries: DataFrame, contains: DataFrame, tips: DataFrame) -> DataFrame:
    """repo_root, sha, branch and fate of each sha.

    repos: repo_root, default_branch, now; shas, ancestors, cherries: repo_root, sha; contains: repo_root, sha, branch, pos;
    tips: repo_root, branch, tip (timestamp or null).
    """
    key = ["repo_root", "sha"]
    default = (F.col("branch") == F.col("default_branch")) | (F.col("branch") == F.concat(F.lit("origin/"), "default_branch"))
    remote = F.col("branch").startswith("origin/")
    at = contains.join(repos.where("default_branch is not null"), "repo_root").join(tips, ["repo_root", "branch"], "left")
    fresh = F.coalesce(F.col("tip") >= F.col("now") - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"), F.lit(False))
    held = at.groupBy(*key).agg(
        F.bool_or(fresh).alias("fresh"),
        F.min_by(F.when(~default & ~remote, F.col("branch")), F.when(~default & ~remote, F.col("pos"))).alias("local"),
        F.min_by(F.when(~default & remote, F.substring("branch", 8, 1 << 20)), F.when(~default & remote, F.col("pos"))).alias("remote"),
        F.lit(True).alias("held"),
    )
    out = shas.join(repos.where("default_branch is not null"), "repo_root").join(held, key, "left")
    out = out.join(ancestors.select(*key).distinct().withColumn("ancestor", F.lit(True)), key, "left").join(cherries.select(*key).distinct().withColumn("cherry", F.lit(True)), key, "left")
    own = F.when(F.col("held"), F.col("default_branch"))
    branch = F.when(F.col("ancestor"), own).otherwise(F.coalesce("local", "remote", own))
    fate = F.when(F.col("ancestor") | F.col("cherry"), "shipped").when(F.col("fresh"), "in_flight").otherwise("unshipped")
    return out.select("repo_root", "sha", branch.alias("branch"), fate.alias("fate"))


def fate_tally(rows: DataFrame) -> DataFrame:
    """One row of counts and its line of text."""
    t = rows.agg(*(F.count_if(F.col("fate") == f).alias(f) for f in ("shipped", "in_flight", "unshipped")))
    return t.withColumn("line", F.format_string("%d shipped, %d in flight, %d unshipped", "shipped", "in_flight", "unshipped"))
