"""The engine's operators over the driver's tables, each with DuckDB SQL for the same rows.

On `events`, user_id stands for a session or repository, (ts, event_id) for log order; signup is a session start,
view a turn, click a token count, purchase a commit. Counters are whole cents of `value`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.variant import iso_string, members, number_or_zero, parse_line, string_or_null
from .operators import commits as C
from .operators import reachability as R
from .operators import usage as U
from .operators.asof import asof_forward
from .operators.filters import allowed, newer, sane, unseen, watermark
from .plans.sync import rollup
from .sources import surfaces as S
from .sources.lines import json_lines, key_values
from .sources.log_files import write_lines
from .sources.surfaces import union_all
from .storage import cut, scratch, sized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("cents", F.floor(F.col("value") * 100).cast("long"))


CENTS = "CAST(floor(value * 100) AS BIGINT)"


def _split(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'")


@query("""SELECT e.event_id, c.event_id AS commit_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON e.user_id = c.user_id AND e.ts <= c.ts""")
def asof_attribution(spark, sf_dir):
    e, c = _split(spark, sf_dir)
    return asof_forward(e.select("user_id", "ts", "event_id"), c.select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "event_id").select("event_id", F.col("commit.event_id").alias("commit_id"))


@query(ORACLES["asof_attribution"])
def asof_attribution_bucketed(spark, sf_dir):
    e, c = _split(spark, sf_dir)
    return asof_forward(e.select("user_id", "ts", "event_id"), c.select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "event_id", bucket_seconds=7 * 86400).select("event_id", F.col("commit.event_id").alias("commit_id"))


@query("""WITH e AS (SELECT event_id, user_id % 5 AS repo, DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) AS d FROM events),
c AS (SELECT o_orderkey, o_custkey % 5 AS repo, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT repo, d, min(o_orderkey) AS o_orderkey FROM c GROUP BY repo, d)
SELECT e.event_id, f.o_orderkey AS commit_id FROM e ASOF JOIN f ON e.repo = f.repo AND e.d <= f.d""")
def asof_attribution_ties(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("repo"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2400).cast("int")).alias("d"))
    c = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("repo"), F.col("o_orderdate").cast("date").alias("d"))
    return asof_forward(e, c, ["repo"], "d", "d", "o_orderkey").select("event_id", F.col("commit.o_orderkey").alias("commit_id"))


@query("""SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (
SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = e.user_id AND c.ts >= e.ts)""")
def asof_wip_unmatched(spark, sf_dir):
    e, c = _split(spark, sf_dir)
    return asof_forward(e.select("user_id", "ts", "event_id"), c.select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "event_id", keep_unmatched=True).where("commit is null").select("event_id")


@query(f"""SELECT c.event_id AS commit_id, count(*) AS n_events, CAST(sum(e.cents) AS BIGINT) AS tokens
FROM (SELECT *, {CENTS} AS cents FROM events WHERE event_type <> 'purchase') e
ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON e.user_id = c.user_id AND e.ts <= c.ts GROUP BY c.event_id""")
def commit_token_rollup(spark, sf_dir):
    e, c = _split(spark, sf_dir)
    hit = asof_forward(e.select("user_id", "ts", "cents"), c.select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "event_id")
    return hit.groupBy(F.col("commit.event_id").alias("commit_id")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("cents").alias("tokens"))


@query("""SELECT user_id, event_type, CASE WHEN arg_max(event_id % 3, event_id) = 0 THEN NULL ELSE 'b' || arg_max(event_id % 3, event_id) END AS branch
FROM events GROUP BY user_id, event_type""")
def branch_last_wins(spark, sf_dir):
    b = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string"))).otherwise("")
    return _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(C.last_branch(b, F.col("event_id")).alias("branch"))


@query("""SELECT e.event_id, 'repo' || (c.c_nationkey) AS repo_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE c.c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def cwd_repo_deny(spark, sf_dir):
    repo = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("/src/repo"), F.col("c_nationkey").cast("string")).alias("root"))
    deny = _t(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.concat(F.lit("repo"), F.col("n_nationkey").cast("string")).alias("repo_name"))
    return allowed(_t(spark, sf_dir, "events").select("event_id", "user_id").join(repo, "user_id").select("event_id", C.repo_name(F.col("root")).alias("repo_name")), deny).select("event_id", "repo_name")


@query("""WITH w AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER s AS meta,
max(CASE WHEN event_type = 'view' THEN event_id END) OVER s AS turn FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER s AS session_id,
last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER s AS turn, event_type FROM events
WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT f.event_id, f.session_id, CASE WHEN f.turn % 4 = 0 THEN NULL ELSE f.turn % 4 END AS model FROM f WHERE event_type = 'click'""")
def session_context_ffill(spark, sf_dir):
    w = U.up_to(["user_id"], ["ts", "event_id"])
    kind = F.col("event_type")
    meta = F.when(kind == "signup", F.struct(F.col("event_id").alias("id")))
    turn = F.when(kind == "view", F.struct(F.nullif(F.col("event_id") % 4, F.lit(0)).alias("model")))
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", U.fill(meta, w).alias("meta"), U.fill(turn, w).alias("turn"))
    return rows.where("event_type = 'click'").select("event_id", F.col("meta.id").alias("session_id"), F.col("turn.model").alias("model"))


@query(f"""WITH c AS (SELECT user_id, event_id, ts, {CENTS} AS cents FROM events WHERE event_type = 'click'),
t AS (SELECT *, CAST(sum(CASE WHEN event_id % 11 = 0 THEN -cents ELSE cents END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS total FROM c)
SELECT event_id, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS grown FROM t""")
def cumulative_delta(spark, sf_dir):
    order = ["ts", "event_id"]
    rows = _events(spark, sf_dir).where("event_type = 'click'")
    total = F.sum(F.when(F.col("event_id") % 11 == 0, -F.col("cents")).otherwise(F.col("cents"))).over(Window.partitionBy("user_id").orderBy(*order))
    rows = rows.select("user_id", "ts", "event_id", total.alias("total"))
    return rows.select("event_id", U.delta(F.col("total"), F.last("total", ignorenulls=True).over(U.before(["user_id"], order))).alias("grown"))


@query(f"""WITH c AS (SELECT user_id, event_id, ts, {CENTS} AS cents FROM events WHERE event_type = 'click'),
b AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) END AS total,
CASE WHEN event_id % 7 NOT IN (1, 2) THEN cents END AS own FROM c),
s AS (SELECT *, last_value(total IGNORE NULLS) OVER p AS prev,
coalesce(last_value(CASE WHEN total IS NOT NULL THEN TRUE WHEN own IS NOT NULL THEN FALSE END IGNORE NULLS) OVER p, TRUE) AS usable
FROM b WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, coalesce(own, CASE WHEN total IS NOT NULL AND usable THEN greatest(0, total - coalesce(prev, 0)) END)::BIGINT AS tokens FROM s
WHERE own IS NOT NULL OR (total IS NOT NULL AND usable)""")
def baseline_usage_choice(spark, sf_dir):
    order = ["ts", "event_id"]
    rows = _events(spark, sf_dir).where("event_type = 'click'")
    run = F.sum("cents").over(Window.partitionBy("user_id").orderBy(*order))
    m = F.col("event_id") % 7
    rows = rows.select("user_id", "ts", "event_id", F.when(m != 0, F.struct(run.alias("n"))).alias("total"), F.when(~m.isin(1, 2), F.struct(F.col("cents").alias("n"))).alias("last"))
    use = U.choose_usage(F.col("total"), F.col("last"), U.before(["user_id"], order), ["n"])
    return rows.select("event_id", use.alias("use")).where("use is not null").select("event_id", F.col("use.n").alias("tokens"))


@query("""WITH i AS (SELECT event_id, ts, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%dT%H:00:00.000Z') AS id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM i)
SELECT event_id, CASE WHEN n > 1 THEN id || ':' || n ELSE id END AS id FROM n""")
def duplicate_id_suffix(spark, sf_dir):
    hour = iso_string(F.date_trunc("hour", "ts"))
    rows = _t(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type", hour).alias("id"))
    return U.suffix_duplicates(rows, "id", ["ts", "event_id"]).select("event_id", "id")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2, event_id) AS n FROM events) WHERE n = 1""")
def first_relpath_wins(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("root_rank", F.col("event_id") % 2)
    return U.first_of(rows, ["user_id", "event_type"], ["root_rank", "event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH m AS (SELECT max(ts) AS top, min(ts) AS low FROM events)
SELECT event_id FROM events, m WHERE ts > low + INTERVAL 3 DAYS AND ts >= TIMESTAMP '2020-01-01' AND ts <= top + INTERVAL 24 HOURS AND event_id >= 0""")
def incremental_since(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    m = e.agg(F.max("at").alias("now"), (F.min("at") + F.expr("INTERVAL 3 DAYS")).alias("since"))
    return e.join(F.broadcast(m), F.lit(True)).where(newer(F.col("at"), F.col("since")) & sane(F.col("event_id").cast("string"), F.col("at"), F.col("now"))).select("event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 5 IN (2, 3) THEN CASE WHEN c_custkey % 4 < 3 THEN '2024-01-01T00:00:00.000Z' END
ELSE strftime(TIMESTAMP '2024-02-01' + to_days(CAST(c_custkey % 300 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') END AS since FROM customer""")
def watermark_since(spark, sf_dir):
    k = F.col("c_custkey")
    surface = F.element_at(F.array(*map(F.lit, ("claude-code", "copilot-cli", "codex", "later"))), (k % 4 + 1).cast("int"))
    own = F.when(k % 5 == 1, "no date").when(k % 5 == 2, "").when(k % 5 != 3, F.concat(F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return _t(spark, sf_dir, "customer").select("c_custkey", iso_string(watermark(surface, own, F.lit("2024-01-01T00:00:00Z"))).alias("since"))


@query("""WITH i AS (SELECT event_id, ts, user_id || ':' || event_type || ':' || strftime(ts, '%H') AS id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM i WHERE event_id % 3 <> 0)
SELECT event_id, id FROM n WHERE n = 1 AND id NOT IN (SELECT id FROM i WHERE event_id % 3 = 0)""")
def idempotent_ingest(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "HH")).alias("id"))
    return unseen(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), "id", ["event_id"]).select("event_id", "id")


@query("""SELECT event_type AS surface, CAST(floor((n - 1) / 250) AS BIGINT) AS batch_id, count(*) AS n_events, min(event_id) AS first_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL""")
def batching(spark, sf_dir):
    rows = U.batches(_t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), 250, ["event_type"], ["ts", "event_id"], ["day"])
    return rows.groupBy(F.col("event_type").alias("surface"), "batch_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_id"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS strict_k,
CASE WHEN event_id % 5 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS text_k FROM events WHERE event_id % 13 <> 0""")
def json_props(spark, sf_dir):
    quoted = F.regexp_replace("props", r": (\d+)", ': "$1"')
    line = F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit(" x"))).when(F.col("event_id") % 5 == 0, quoted).otherwise(F.col("props"))
    rows = _t(spark, sf_dir, "events").select("event_id", parse_line(F.col("props")).alias("p"), parse_line(line).alias("v")).where("v is not null")
    return rows.select("event_id", number_or_zero(F.col("p"), "$.k").alias("k"), number_or_zero(F.col("v"), "$.k").alias("strict_k"), string_or_null(F.col("v"), "$.k").alias("text_k"))


@query("""SELECT l_orderkey AS segment, l_returnflag AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY ALL""")
def segments_by_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    maps = rows.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n")))).alias("line"))
    v = maps.select("l_orderkey", parse_line(F.col("line")).alias("v"))
    return members(v, "v").select(F.col("l_orderkey").alias("segment"), F.col("key").alias("model"), F.variant_get("value", "$", "long").alias("tokens"))


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS branch FROM customer""")
def yaml_kv_last_wins(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    text = F.concat(F.lit("name: old\n : dropped\nid: "), F.col("c_custkey").cast("string"), F.lit("\r\nno colon\nname:   \""), "c_name", F.lit("\"  \nbranch: '"), "c_mktsegment", F.lit("'\n"))
    kv = F.col("kv")
    return key_values(c.select(F.col("c_custkey").cast("string").alias("file_path"), text.alias("value"))).select(kv["id"].cast("long").alias("id"), kv["name"].alias("name"), kv["branch"].alias("branch"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS sha, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_added,
CAST(sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber END) AS BIGINT) AS lines_deleted, count(*) AS files_changed FROM lineitem GROUP BY l_orderkey""")
def numstat_parse(spark, sf_dir):
    deleted = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_linenumber").cast("string"))
    line = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), deleted, F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    text = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("\u001e"), F.col("l_orderkey").cast("string"), F.lit("\u001f2024-01-01T00:00:00Z\n\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("value"))
    return C.parse_commit_log(text, ["l_orderkey"]).select("sha", "lines_added", "lines_deleted", "files_changed")


@query("""WITH f AS (SELECT o_orderkey AS sha, o_custkey % 7 AS repo, o_orderstatus = 'F' AND o_orderkey % 4 = 0 AS ancestor, o_orderkey % 9 = 0 AS cherry FROM orders),
b AS (SELECT DISTINCT l_orderkey AS sha, CASE WHEN l_linenumber = 1 THEN 'main' WHEN l_linenumber = 2 THEN 'origin/main' WHEN l_linenumber <= 4 THEN 'origin/f' || l_linenumber ELSE 'f' || l_linenumber END AS branch, l_linenumber AS pos FROM lineitem),
t AS (SELECT DISTINCT sha % 1 AS z, branch FROM b),
tips AS (SELECT branch, CASE WHEN branch IN ('f5', 'origin/f3') THEN 2 WHEN branch IN ('main', 'origin/main') THEN 14 WHEN branch = 'f6' THEN NULL ELSE 40 END AS age FROM t),
g AS (SELECT f.sha, bool_or(coalesce(age <= 14, FALSE)) AS fresh, arg_min(b.branch, pos) FILTER (b.branch LIKE 'f%') AS local, arg_min(b.branch, pos) FILTER (b.branch LIKE 'origin/f%') AS remote
FROM f JOIN b ON f.sha = b.sha LEFT JOIN tips ON tips.branch = b.branch WHERE f.repo <> 6 GROUP BY f.sha)
SELECT f.sha, CASE WHEN ancestor THEN CASE WHEN g.sha IS NULL THEN NULL ELSE 'main' END
ELSE coalesce(local, substr(remote, 8), CASE WHEN g.sha IS NULL THEN NULL ELSE 'main' END) END AS branch,
CASE WHEN ancestor OR cherry THEN 'shipped' WHEN coalesce(fresh, FALSE) THEN 'in_flight' ELSE 'unshipped' END AS fate
FROM f LEFT JOIN g ON f.sha = g.sha WHERE f.repo <> 6""")
def fate_classification(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("repo_root"), F.col("o_orderkey").alias("sha"), "o_orderstatus")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    repos = spark.range(7).select(F.col("id").alias("repo_root"), F.when(F.col("id") != 6, "main").alias("default_branch"), now.alias("now"))
    n = F.col("l_linenumber")
    branch = F.when(n == 1, "main").when(n == 2, "origin/main").when(n <= 4, F.concat(F.lit("origin/f"), n.cast("string"))).otherwise(F.concat(F.lit("f"), n.cast("string")))
    contains = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), branch.alias("branch"), n.alias("pos")).distinct().join(o.select("sha", "repo_root"), "sha")
    age = F.when(F.col("branch").isin("f5", "origin/f3"), 2).when(F.col("branch").isin("main", "origin/main"), 14).when(F.col("branch") != "f6", 40)
    tips = contains.select("repo_root", "branch").distinct().select("repo_root", "branch", (now - F.make_dt_interval(days=age)).alias("tip"))
    out = C.fates(repos, o.select("repo_root", "sha"), o.where("o_orderstatus = 'F' and sha % 4 = 0"), o.where("sha % 9 = 0"), contains, tips)
    return out.select("sha", "branch", "fate")


@query(f"""WITH r AS ({ORACLES['fate_classification']}), t AS (SELECT count(*) FILTER (fate = 'shipped') AS shipped, count(*) FILTER (fate = 'in_flight') AS in_flight, count(*) FILTER (fate = 'unshipped') AS unshipped FROM r)
SELECT *, shipped || ' shipped, ' || in_flight || ' in flight, ' || unshipped || ' unshipped' AS line FROM t""")
def fate_tally(spark, sf_dir):
    return C.fate_tally(fate_classification(spark, sf_dir))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5""")
def recent_cap(spark, sf_dir):
    return C.recent_cap(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey AS repo_root, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS default_branch FROM orders GROUP BY o_custkey""")
def default_branch_ladder(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_root"), F.col("o_orderstatus").alias("branch"))
    ladder = spark.createDataFrame([("F", 1), ("P", 2), ("O", 3), ("X", 0)], "branch string, rank int")
    return C.default_branch(o.select("repo_root").distinct().join(F.broadcast(ladder), F.lit(True)), o, ["repo_root"])


@query("""WITH f AS (SELECT source AS repo, encode(text) AS content FROM documents UNION ALL SELECT 'lineitem', encode(l_returnflag || chr(10) || l_linestatus) FROM lineitem)
SELECT repo, CASE WHEN count(*) <= 5000 THEN CAST(coalesce(sum(CASE WHEN octet_length(content) <= 1048576 THEN len(string_split(decode(content), chr(10))) END), 0) AS BIGINT) END AS total_loc, count(*) AS file_count
FROM f GROUP BY repo""")
def loc_guard(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("text").cast("binary").alias("content"))
    files = files.union(_t(spark, sf_dir, "lineitem").select(F.lit("lineitem"), F.concat("l_returnflag", F.lit("\n"), "l_linestatus").cast("binary")))
    return C.repo_size(files.withColumn("length", F.octet_length("content")), ["repo"])


@query("""SELECT surface, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM (
SELECT 'a' AS surface, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', user_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'c', o_custkey FROM orders) GROUP BY surface""")
def union_surfaces(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    parts = [e.where("event_type = 'view'").select(F.lit("a").alias("surface"), "user_id"), e.where("event_type = 'click'").select(F.lit("b").alias("surface"), "user_id"), _t(spark, sf_dir, "orders").select(F.lit("c").alias("surface"), F.col("o_custkey").alias("user_id"))]
    return union_all(parts).groupBy("surface").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"))


@query("""SELECT DISTINCT branch FROM (SELECT o_orderpriority AS branch FROM orders UNION SELECT l_linestatus FROM lineitem UNION SELECT '(HEAD detached)' UNION SELECT 'origin') WHERE branch NOT LIKE '(%' AND branch <> 'origin'""")
def distinct_branches(spark, sf_dir):
    noise = spark.createDataFrame([("(HEAD detached)",), ("origin",), ("  ",), ("origin/HEAD",)], "branch string")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("branch")).union(_t(spark, sf_dir, "lineitem").select("l_linestatus")).union(noise)
    return C.real_branches(rows).distinct()


@query("""SELECT l_orderkey AS repo, 'c' || l_linenumber AS sha FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL""")
def patch_equivalent(spark, sf_dir):
    line = F.concat(F.when(F.col("l_returnflag") == "A", "- ").otherwise("+ "), F.lit("c"), F.col("l_linenumber").cast("string"))
    text = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("repo")).agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    return C.patch_equivalents(text, ["repo"])


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model, count(*) AS n_events, CAST(sum({CENTS}) AS BIGINT) AS tokens FROM events GROUP BY ALL""")
def x_daily_tokens(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("cents").alias("tokens"))


@query(f"""SELECT strftime(ts, '%Y-%m') AS month, event_type AS model, count(*) AS events,
CAST(sum({CENTS} + event_id % 50 + event_id % 7 + CASE WHEN event_id % 2 = 0 THEN event_id % 11 ELSE event_id % 5 + event_id % 3 END) AS BIGINT) AS tokens FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m'), event_type)""")
def x_rollup(spark, sf_dir):
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("model"), F.col("cents").alias("input_tokens"), (i % 50).alias("output_tokens"), (i % 7).alias("cache_read_tokens"), F.when(i % 2 == 0, i % 11).alias("cache_write_tokens"), (i % 5).alias("cache_creation_5m_tokens"), (i % 3).alias("cache_creation_1h_tokens"))
    return rollup(rows, ["month", "model"])


def _logs(rows: DataFrame, line, folder: str = "/logs/u", file: str = "/log.jsonl") -> DataFrame:
    """One log file for each user, of the lines in order, as the line reader gives it."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    files = rows.groupBy("user_id").agg(text.alias("value"))
    path = F.concat(F.lit(folder), F.col("user_id").cast("string"), F.lit(file))
    return json_lines(files.select("value", path.alias("file_path"), F.lit(None).cast("timestamp").alias("modified"), F.lit(0).alias("source_rank")))


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _mod(n: int):
    return F.col("event_id") % n


def _first_surface_line():
    """A line for each event: counters of a wrong type, other types, no usage, bad times and text after the object among them."""
    cached = F.when(_mod(2) == 0, F.format_string(', "cache_creation": {"ephemeral_5m_input_tokens": %d}', _mod(7))).otherwise("")
    creation = F.when(_mod(4) == 1, F.format_string('"%d"', _mod(9))).otherwise(_mod(9).cast("string"))
    usage = F.format_string('{"input_tokens": %d, "output_tokens": %d, "cache_creation_input_tokens": %s%s}', "cents", _mod(100), creation, cached)
    return F.format_string(
        '{"type": "%s", "requestId": "r%d", "sessionId": "s%d", "timestamp": "%s", "message": {"model": "%s", "usage": %s}}%s',
        F.when(F.col("event_type") == "click", "assistant").otherwise("user"), "event_id", "user_id", F.when(_mod(17) == 0, "never").otherwise(_iso("ts")),
        F.when(_mod(10) == 0, "<synthetic>").otherwise(F.format_string("m%d", _mod(3))), F.when(_mod(13) == 0, "5").otherwise(usage), F.when(_mod(29) == 28, " x").otherwise(""),
    )


def _first_surface_rows(out: DataFrame) -> DataFrame:
    return out.select("external_id", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", F.col("metadata.session_id").alias("session_id"), iso_string(F.col("occurred_at")).alias("occurred_at"))


def _third_surface_lines(spark, sf_dir):
    """The events with a line each: session starts, turns, and counts with a total, a usage of their own, both or neither."""
    kind = F.col("event_type")
    run = F.sum(F.when(kind == "click", F.col("cents"))).over(U.up_to(["user_id"], ["ts", "event_id"]))
    rows = _events(spark, sf_dir).withColumn("run", run)
    meta = F.format_string('{"type": "session_meta", "payload": {"id": "s%d", "cwd": "/w%d"}}', "event_id", _mod(3))
    turn = F.format_string('{"type": "turn_context", "payload": {"turn_id": "t%d"%s}}', "event_id", F.when(_mod(4) == 0, "").otherwise(F.format_string(', "model": "m%d"', _mod(4))))
    part = lambda name, value, absent: F.when(absent, "").otherwise(F.format_string(f', "{name}": {{"input_tokens": %d}}', value))
    count = F.format_string('{"type": "event_msg", "timestamp": "%s", "payload": {"type": "token_count", "info": {"x": 1%s%s}}}', _iso("ts"), part("total_token_usage", F.col("run"), _mod(7) == 0), part("last_token_usage", F.col("cents"), _mod(7).isin(1, 2)))
    return rows.withColumn("value", F.when(kind == "signup", meta).when(kind == "view", turn).when(kind == "click", count).otherwise("noise"))


def _third_surface_rows(out: DataFrame) -> DataFrame:
    return out.select("external_id", "model", F.col("metadata.cwd").alias("cwd"), "input_tokens")


AT_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"""SELECT 'r' || event_id AS external_id, 'm' || event_id % 3 AS model, {CENTS} AS input_tokens, event_id % 100 AS output_tokens, CASE WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 9 END AS cache_creation_tokens,
CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END AS cache_creation_5m_tokens, 's' || user_id AS session_id, {AT_SQL} AS occurred_at
FROM events WHERE event_type = 'click' AND event_id % 10 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 29 <> 28""")
def scan_first_surface(spark, sf_dir):
    """Counters of a wrong type are 0; lines of another type, without usage, with a bad time or with text after the object drop."""
    return _first_surface_rows(S.claude_code_events(_logs(_events(spark, sf_dir), _first_surface_line())))


@query(ORACLES["scan_first_surface"] + " AND user_id % 5 > 1")
def files_first_surface(spark, sf_dir):
    """As scan_first_surface, over files that are written and found: those at the top or of another suffix are not of the layout."""
    user = F.col("user_id")
    name = F.format_string("u%d", user)
    path = F.when(user % 5 == 0, F.concat(name, F.lit(".jsonl"))).when(user % 5 == 1, F.concat(F.lit("p/"), name, F.lit(".txt"))).otherwise(F.concat(F.format_string("p%d/", user % 8), name, F.lit(".jsonl")))
    base = scratch(spark, "logs")
    write_lines(_events(spark, sf_dir).select(path.alias("path"), _first_surface_line().alias("value"), "ts", "event_id"), base, ["ts", "event_id"])
    return _first_surface_rows(S.scan_claude_code(spark, [base]))


@query(f"""WITH e AS (SELECT user_id, event_id, ts, {CENTS} AS cents, CASE WHEN event_id % 3 = 0 THEN '2024-01-01T00:00:00.000Z' ELSE {AT_SQL} END AS happened FROM events WHERE event_type = 'purchase' AND user_id % 6 <> 0),
m AS (SELECT *, 'a' AS model, cents AS input_tokens FROM e UNION ALL SELECT *, 'b', event_id % 8 FROM e WHERE event_id % 4 <> 0),
n AS (SELECT *, 's' || user_id || ':' || model || ':' || happened AS id FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM n)
SELECT CASE WHEN n > 1 THEN id || ':' || n ELSE id END AS external_id, model, input_tokens, event_id % 5 AS cache_write_tokens FROM r""")
def scan_second_surface(spark, sf_dir):
    """A row for each model of a shutdown line; lines without a time take the folder's, folders without a workspace file drop."""
    rows = _events(spark, sf_dir)
    use = F.format_string('"a": {"usage": {"inputTokens": %d, "cacheWriteTokens": %d}}, "b": {"usage": %s}', "cents", _mod(5), F.when(_mod(4) == 0, "3").otherwise(F.format_string('{"inputTokens": %d, "cacheWriteTokens": %d}', _mod(8), _mod(5))))
    time = F.when(_mod(3) == 0, "").otherwise(F.format_string('"timestamp": "%s", ', _iso("ts")))
    line = F.format_string('{"type": "%s", %s"data": {"modelMetrics": {%s}}}', F.when(F.col("event_type") == "purchase", "session.shutdown").otherwise(F.col("event_type")), time, use)
    user = F.col("user_id").cast("string")
    spaces = rows.where("user_id % 6 <> 0").select("user_id").distinct().select(F.concat(F.lit("/logs/u"), user, F.lit("/workspace.yaml")).alias("file_path"), F.concat(F.lit("id: s"), user, F.lit("\ncreated_at: 2024-01-01T00:00:00Z\n")).alias("value"))
    return S.copilot_cli_events(_logs(rows, line), key_values(spaces)).select("external_id", "model", "input_tokens", "cache_write_tokens")


@query(f"""WITH f AS (SELECT *, {CENTS} AS cents, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER s AS meta,
last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER s AS turn FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) END AS total, CASE WHEN event_id % 7 NOT IN (1, 2) THEN cents END AS own FROM f WHERE event_type = 'click'),
s AS (SELECT *, last_value(total IGNORE NULLS) OVER p AS prev, coalesce(last_value(CASE WHEN total IS NOT NULL THEN TRUE WHEN own IS NOT NULL THEN FALSE END IGNORE NULLS) OVER p, TRUE) AS usable
FROM c WHERE meta IS NOT NULL WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, coalesce(own, CASE WHEN total IS NOT NULL AND usable THEN greatest(0, total - coalesce(prev, 0)) END) AS use, 's' || meta || ':t' || turn || ':' || {AT_SQL} AS id FROM s WHERE turn % 4 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM u WHERE use IS NOT NULL)
SELECT CASE WHEN n > 1 THEN id || ':' || n ELSE id END AS external_id, 'm' || turn % 4 AS model, '/w' || meta % 3 AS cwd, CAST(use AS BIGINT) AS input_tokens FROM n""")
def scan_third_surface(spark, sf_dir):
    """Session state over a file: the session and turn in force, and the growth of the totals where a count has no usage of its own."""
    rows = _third_surface_lines(spark, sf_dir)
    return _third_surface_rows(S.codex_events(_logs(rows, F.col("value"))))


@query(ORACLES["scan_third_surface"])
def files_third_surface(spark, sf_dir):
    """As scan_third_surface, over a home that is written and found: archived files count where no session file has their relative path."""
    user = F.col("user_id")
    rel = F.format_string("%d/u%d.jsonl", user % 4, user)
    rows = _third_surface_lines(spark, sf_dir).select("user_id", rel.alias("rel"), "value", "ts", "event_id")
    at = lambda folder, value=F.col("value"), suffix="": F.struct(F.concat(folder, "rel", F.lit(suffix)).alias("path"), value.alias("value"))
    main = at(F.when(user % 4 == 1, "archived_sessions/").otherwise("sessions/"))
    hidden = F.when((user % 4 != 1) & (user % 3 == 0), at(F.lit("archived_sessions/"), F.regexp_replace("value", '"m', '"z')))
    other = F.when(user % 7 == 0, at(F.lit("sessions/"), suffix=".bak"))
    home = scratch(spark, "home")
    write_lines(rows.select(F.inline(F.array_compact(F.array(main, hidden, other))), "ts", "event_id"), home, ["ts", "event_id"])
    return _third_surface_rows(S.codex_events(json_lines(S.codex_lines(spark, [home]))))


@query("""WITH e AS (SELECT *, user_id % 5 AS repo FROM events), c AS (SELECT repo, ts, min(event_id) AS event_id FROM e WHERE event_type = 'purchase' AND repo <> 4 GROUP BY repo, ts)
SELECT 'x' || e.event_id AS external_id, 'r' || e.repo AS repo_name, 'c' || c.event_id AS commit_sha, CASE WHEN e.event_id % 3 <> 0 THEN 'b' || e.event_id % 3 END AS branch
FROM e ASOF JOIN c ON e.repo = c.repo AND e.ts <= c.ts WHERE e.event_type <> 'purchase' AND e.event_id % 11 <> 0 AND e.repo <> 0""")
def attributed_events(spark, sf_dir):
    """Working folders to repositories, surfaces, deny list, branch and as-of match together."""
    e = _t(spark, sf_dir, "events").withColumn("repo", (F.col("user_id") % 5).cast("string"))
    root = F.concat(F.lit("/src/r"), "repo")
    usage = e.where("event_type <> 'purchase'").select(F.when(_mod(11) == 0, "copilot-cli").otherwise("codex").alias("surface"), F.format_string("x%d", "event_id").alias("external_id"), F.col("ts").alias("occurred_at"), F.lit(0).alias("source_rank"), F.lit("f").alias("file_path"), F.col("event_id").alias("line_no"), F.struct(F.concat(root, F.lit("/lib")).alias("cwd"), F.when(_mod(3) == 0, "").otherwise(F.format_string("b%d", _mod(3))).alias("git_branch")).alias("metadata"))
    log = e.where("event_type = 'purchase' and repo <> '4'").select(root.alias("repo_root"), F.format_string("c%d", "event_id").alias("sha"), F.col("ts").alias("committed_at"), F.lit(1).alias("lines_added"), F.lit(0).alias("lines_deleted"), F.lit(1).alias("files_changed"), F.col("event_id").alias("ord"))
    roots = e.select(root.alias("repo_root")).distinct()
    deny = spark.createDataFrame([("r0",)], "repo_name string")
    out = C.attribute(usage, C.repo_of_cwd(usage.select("metadata.cwd"), roots), log, deny)
    return out.select("external_id", "repo_name", "commit_sha", "branch")


@query("""SELECT DISTINCT '/src/r' || c_nationkey || '/a/b' || c_custkey % 3 AS cwd, CASE WHEN n_regionkey = 0 THEN '/src/r' || c_nationkey || '/a' WHEN n_regionkey <> 1 THEN '/src/r' || c_nationkey END AS repo_root
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cwd_longest_root(spark, sf_dir):
    """The deepest known root above a folder; none for the folders of one region."""
    nation = _t(spark, sf_dir, "nation")
    root = F.format_string("/src/r%d", "n_nationkey")
    roots = nation.where("n_regionkey <> 1").select(root.alias("repo_root")).union(nation.where("n_regionkey = 0").select(F.concat(root, F.lit("/a/"))))
    return C.repo_of_cwd(_t(spark, sf_dir, "customer").select(F.format_string("/src/r%d/a/b%d", "c_nationkey", F.col("c_custkey") % 3).alias("cwd")), roots)


@query("""WITH o AS (SELECT o_custkey % 50 AS repo, o_orderkey AS sha, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey % 50) AS most FROM orders)
SELECT CAST(repo AS VARCHAR) AS repo_root, CAST(sha AS VARCHAR) AS sha FROM o WHERE n <= most - 2 OR n = most AND n % 2 = 0""")
def reachable_commits(spark, sf_dir):
    """A line of commits in each repository, a branch at its end that merges it or not, and a tip two commits before the end."""
    w = Window.partitionBy("repo_root").orderBy("o_orderkey")
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("repo_root"), "o_orderkey")
    o = o.select("repo_root", F.col("o_orderkey").cast("string").alias("sha"), F.lag(F.col("o_orderkey").cast("string")).over(w).alias("parent"), F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("repo_root")).alias("most"))
    side = (F.col("n") == F.col("most")) & (F.col("n") % 2 == 0)
    parent = F.when(F.col("n") == F.col("most"), F.lit("unknown")).otherwise(F.col("parent"))
    commits = o.select("repo_root", "sha", F.array(parent).alias("parents"))
    refs = o.where("n = most - 2").select("repo_root", F.lit("main").alias("ref"), "sha").union(o.where(side).select("repo_root", F.lit("side"), "sha"))
    return R.reachable(commits, refs).select("repo_root", "sha").distinct()


#: Graphs over the orders of 50 repositories: lines of commits with branches that part and are merged, from four refs of each.
_GRAPH_SQL = """o AS (SELECT o_custkey % 50 AS repo, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey % 50) AS most FROM orders),
c AS (SELECT *, CASE WHEN n % 6 = 1 AND n > 10 THEN n - 6 ELSE n - 1 END AS p1, CASE WHEN n % 4 = 0 THEN n - 3 END AS p2, 'p' || n % 40 AS patch, TIMESTAMP '2024-06-01' - (most - n) * INTERVAL 12 HOUR AS done FROM o),
e AS (SELECT repo, n, p1 AS p FROM c WHERE p1 >= 1 UNION SELECT repo, n, p2 FROM c WHERE p2 >= 1),
refs AS (SELECT repo, 'main' AS ref, max(n) AS n FROM c WHERE n % 6 = 0 AND n < most - 40 GROUP BY repo UNION ALL SELECT repo, 'f1', max(n) FROM c WHERE n % 6 = 3 GROUP BY repo
UNION ALL SELECT repo, 'origin/f2', max(n) FROM c WHERE n % 6 = 5 AND n < most - 30 GROUP BY repo UNION ALL SELECT repo, 'f0', 10 FROM c GROUP BY repo),
reach(repo, ref, n) AS (SELECT repo, ref, n FROM refs UNION SELECT r.repo, r.ref, e.p FROM reach r JOIN e ON e.repo = r.repo AND e.n = r.n)"""


def _graph(spark, sf_dir):
    w = Window.partitionBy("repo_root")
    c = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("repo_root"), "o_orderkey")
    c = c.select("repo_root", F.row_number().over(w.orderBy("o_orderkey")).alias("n"), F.count(F.lit(1)).over(w).alias("most"))
    n = F.col("n")
    first = F.when((n % 6 == 1) & (n > 10), n - 6).otherwise(n - 1)
    parents = F.filter(F.array(first, F.when(n % 4 == 0, n - 3)), lambda p: p >= 1)
    at = F.lit("2024-06-01 00:00:00").cast("timestamp") - F.make_dt_interval(hours=((F.col("most") - n) * 12).cast("int"))
    # written once: each question asked of the commits would number all orders again
    c = sized(cut(c.select("repo_root", n.cast("string").alias("sha"), parents.cast("array<string>").alias("parents"), at.alias("committed_at"), "n", "most")))
    last = lambda name, where: c.where(where).groupBy("repo_root").agg(F.max("n").cast("string").alias("sha")).select("repo_root", F.lit(name).alias("ref"), "sha")
    refs = last("main", "n % 6 = 0 and n < most - 40").union(last("f1", "n % 6 = 3")).union(last("origin/f2", "n % 6 = 5 and n < most - 30"))
    return c, refs.union(c.select("repo_root", F.lit("f0"), F.lit("10")).distinct())


@query(f"""WITH RECURSIVE {_GRAPH_SQL} SELECT repo AS repo_root, ref, CAST(reach.n AS VARCHAR) AS sha FROM reach WHERE EXISTS (SELECT 1 FROM c WHERE c.repo = reach.repo AND c.n = reach.n)""")
def merged_reachability(spark, sf_dir):
    """What each ref reaches where branches part and are merged."""
    c, refs = _graph(spark, sf_dir)
    return R.reachable(c, refs)


@query(f"""WITH RECURSIVE {_GRAPH_SQL},
late AS (SELECT c.* FROM c WHERE done >= TIMESTAMP '2024-06-01' - INTERVAL 90 DAY AND EXISTS (SELECT 1 FROM reach r WHERE r.repo = c.repo AND r.n = c.n)),
held AS (SELECT l.repo, l.n, r.ref FROM late l JOIN reach r ON r.repo = l.repo AND r.n = l.n),
tips AS (SELECT f.repo, f.ref, c.done FROM refs f JOIN c ON c.repo = f.repo AND c.n = f.n),
own AS (SELECT h.repo, h.n, h.ref, c.patch FROM held h JOIN c ON c.repo = h.repo AND c.n = h.n WHERE h.ref <> 'main' AND (p2 IS NULL OR p2 < 1)
AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.repo = h.repo AND r.n = h.n AND r.ref = 'main')),
theirs AS (SELECT DISTINCT r.repo, f.ref, c.patch FROM reach r JOIN c ON c.repo = r.repo AND c.n = r.n JOIN refs f ON f.repo = r.repo
WHERE r.ref = 'main' AND (p2 IS NULL OR p2 < 1) AND NOT EXISTS (SELECT 1 FROM reach x WHERE x.repo = r.repo AND x.ref = f.ref AND x.n = r.n)),
cherry AS (SELECT DISTINCT repo, n FROM own JOIN theirs USING (repo, ref, patch)),
g AS (SELECT h.repo, h.n, bool_or(t.done >= TIMESTAMP '2024-06-01' - INTERVAL 14 DAY) AS fresh, bool_or(h.ref = 'main') AS ancestor,
min(h.ref) FILTER (h.ref LIKE 'f%') AS local, min(substr(h.ref, 8)) FILTER (h.ref LIKE 'origin/%') AS remote FROM held h JOIN tips t USING (repo, ref) GROUP BY h.repo, h.n)
SELECT g.repo AS repo_root, CAST(g.n AS VARCHAR) AS sha, CASE WHEN ancestor THEN 'main' ELSE coalesce(local, remote, 'main') END AS branch,
CASE WHEN ancestor OR k.n IS NOT NULL THEN 'shipped' WHEN fresh THEN 'in_flight' ELSE 'unshipped' END AS fate
FROM g LEFT JOIN cherry k ON k.repo = g.repo AND k.n = g.n WHERE g.repo IN (SELECT repo FROM refs WHERE ref = 'main')""")
def graph_fates(spark, sf_dir):
    """Fates from commits, refs and patches alone: what contains what, tips, ancestors and equal patches."""
    c, refs = _graph(spark, sf_dir)
    repos = c.select("repo_root").distinct().withColumns({"head": F.lit(None).cast("string"), "current": F.lit("f9")})
    patches = c.select("repo_root", "sha", F.concat(F.lit("p"), (F.col("n") % 40).cast("string")).alias("patch"))
    return C.fates(**R.graph_facts(c, refs, repos, F.lit("2024-06-01 00:00:00").cast("timestamp"), patches))


@query("""WITH d AS (SELECT l_orderkey AS sha, l_suppkey % 5 AS file, string_agg(CAST(l_quantity AS BIGINT) % 3, ',' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) % 3) AS body FROM lineitem GROUP BY ALL),
p AS (SELECT sha, string_agg(file || ':' || body, ';' ORDER BY file) AS patch FROM d GROUP BY sha)
SELECT patch AS what, count(*) AS n, min(sha) AS first_sha FROM p GROUP BY patch""")
def patch_ids(spark, sf_dir):
    """Diffs of equal content have one id, whatever their order of files, places, spaces and object names."""
    sha, q = F.col("l_orderkey"), (F.col("l_quantity").cast("long") % 3).cast("string")
    rows = _t(spark, sf_dir, "lineitem").groupBy(sha, (F.col("l_suppkey") % 5).alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", q.alias("q")))), lambda x: x["q"]).alias("body"))
    hunk = F.transform("body", lambda q: F.concat(F.lit("+  add"), F.repeat(F.lit(" "), (sha % 3).cast("int")), q))
    part = F.concat(F.format_string("diff --git a/f%d b/f%d\nindex %x..%x 100644\n--- a/f%d\n+++ b/f%d\n@@ -%d,2 +%d,3 @@ near\n", "file", "file", sha, sha + 1, "file", "file", sha % 90, sha % 91), F.array_join(hunk, "\n"), F.lit("\n"))
    order = F.when(sha % 2 == 0, F.col("file")).otherwise(-F.col("file"))
    texts = rows.select(sha, F.concat(F.col("file").cast("string"), F.lit(":"), F.array_join("body", ",")).alias("what"), "file", part.alias("part"), order.alias("o")).groupBy(sha).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "part"))), lambda x: x["part"]), "").alias("diff"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "what"))), lambda x: x["what"]), ";").alias("what"))
    return texts.groupBy(R.patch_id(F.col("diff")).alias("id")).agg(F.min("what").alias("what"), F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_sha")).drop("id")
