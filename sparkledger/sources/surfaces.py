"""The log surfaces: each scan turns session files into usage events."""

from __future__ import annotations

import json
import os
import platform
import socket
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.variant import at, is_object, iso_string, iso_timestamp, members, number_or_zero, string_or_null
from ..operators import usage as U
from ..operators.filters import newer
from .lines import existing, file_lines, json_lines, key_values, listed_files, read_small, whole_files

COUNTERS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens"]


def _listed(name: str) -> list[str]:
    return [x.strip() for x in os.environ.get(name, "").split(",") if x.strip()]


def claude_config_dirs() -> list[str]:
    """The configured folders, else the two usual ones."""
    return _listed("CLAUDE_CONFIG_DIR") or [str(Path.home() / ".claude"), str(Path.home() / ".config" / "claude")]


def claude_project_dirs() -> list[str]:
    return [f"{d}/projects" for d in claude_config_dirs()]


def codex_homes() -> list[str]:
    return _listed("CODEX_HOME") or [str(Path.home() / ".codex")]


def account_files() -> list[str]:
    return [f"{d}/.claude.json" for d in _listed("CLAUDE_CONFIG_DIR")] + [str(Path.home() / ".claude.json")]


def read_account(spark: SparkSession, path: str | None = None) -> DataFrame:
    """At most one row: the first candidate file, in any file system Spark knows, with an account object."""
    for p in [path] if path else account_files():
        try:
            acct = json.loads(read_small(spark, p) or "").get("oauthAccount")
        except (ValueError, AttributeError):
            continue
        if isinstance(acct, dict):
            names = ("accountUuid", "emailAddress", "organizationUuid", "billingType")
            return spark.createDataFrame([tuple(acct.get(n) if isinstance(acct.get(n), str) else None for n in names)], schemas.ACCOUNT)
    return spark.createDataFrame([], schemas.ACCOUNT)


def _event(surface: str, **columns: Column) -> list[Column]:
    """The columns of a usage event, in the order of the schema."""
    got = {"surface": F.lit(surface), "source_rank": F.col("source_rank"), "file_path": F.col("file_path"), "line_no": F.col("line_no")} | columns
    parts = [x.strip().split(" ", 1) for x in schemas.USAGE_EVENT.replace("struct<cwd:string,git_branch:string,session_id:string,version:string,entrypoint:string,origin:struct<host:string,platform:string,client:string,client_version:string>>", "M").split(", ")]
    kind = schemas.USAGE_EVENT[schemas.USAGE_EVENT.index("struct<") :]
    return [got.get(n, F.lit(None)).cast(kind if t == "M" else t).alias(n) for n, t in parts]


def _metadata(cwd, branch, session, version, entrypoint, host, plat, client, client_version) -> Column:
    origin = F.struct(host.alias("host"), plat.alias("platform"), client.alias("client"), client_version.alias("client_version"))
    return F.struct(cwd.alias("cwd"), branch.alias("git_branch"), session.alias("session_id"), version.alias("version"), entrypoint.alias("entrypoint"), origin.alias("origin"))


def scan_claude_code(spark: SparkSession, bases: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """The events of `<base>/<project>/<file>.jsonl`."""
    return claude_code_events(json_lines(file_lines(spark, claude_project_dirs() if bases is None else bases, "/*/*.jsonl", since=since)), since)


def claude_code_events(rows: DataFrame, since: Column | None = None) -> DataFrame:
    """One event for each assistant line with a model, an id and a valid time."""
    v = F.col("v")
    u = "$.message.usage"
    rows = rows.where((string_or_null(v, "$.type") == "assistant") & is_object(at(v, "$.message")) & is_object(at(v, u)))
    ident, model, time = string_or_null(v, "$.requestId"), string_or_null(v, "$.message.model"), iso_timestamp(string_or_null(v, "$.timestamp"))
    rows = rows.where(ident.isNotNull() & (model != "<synthetic>") & time.isNotNull() & newer(time, since))
    split = lambda n: F.when(is_object(at(v, f"{u}.cache_creation")), number_or_zero(v, f"{u}.cache_creation.{n}")).otherwise(0)
    version, entry = string_or_null(v, "$.version"), string_or_null(v, "$.entrypoint")
    meta = _metadata(string_or_null(v, "$.cwd"), string_or_null(v, "$.gitBranch"), string_or_null(v, "$.sessionId"), version, entry, F.lit(socket.gethostname()), F.lit(platform.system().lower()), entry, version)
    return rows.select(*_event("claude-code", external_id=ident, provider=F.lit("anthropic"), model=model, input_tokens=number_or_zero(v, f"{u}.input_tokens"), output_tokens=number_or_zero(v, f"{u}.output_tokens"), cache_read_tokens=number_or_zero(v, f"{u}.cache_read_input_tokens"), cache_creation_tokens=number_or_zero(v, f"{u}.cache_creation_input_tokens"), cache_creation_5m_tokens=split("ephemeral_5m_input_tokens"), cache_creation_1h_tokens=split("ephemeral_1h_input_tokens"), occurred_at=time, metadata=meta))


def scan_copilot_cli(spark: SparkSession, bases: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """The events of session folders that have a workspace file."""
    bases = [str(Path.home() / ".copilot" / "session-state")] if bases is None else bases
    return copilot_cli_events(json_lines(file_lines(spark, bases, "/*/events.jsonl")), key_values(whole_files(spark, bases, "/*/workspace.yaml")), since)


def copilot_cli_events(rows: DataFrame, spaces: DataFrame, since: Column | None = None) -> DataFrame:
    """One event for each model of each shutdown line in a folder that has a workspace file (spaces: file_path, kv)."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    rows = rows.withColumn("dir", folder).join(spaces.select(folder.alias("dir"), "kv"), "dir")
    v = F.col("v")
    rows = rows.where((string_or_null(v, "$.type") == "session.shutdown") & is_object(at(v, "$.data.modelMetrics")))
    time = F.coalesce(iso_timestamp(string_or_null(v, "$.timestamp")), iso_timestamp(F.col("kv")["created_at"]))
    rows = rows.withColumn("time", time).withColumn("metrics", at(v, "$.data.modelMetrics")).where(F.col("time").isNotNull() & newer(F.col("time"), since))
    rows = rows.withColumn("session", F.coalesce(F.col("kv")["id"], F.element_at(F.split("dir", "/"), -1)))
    rows = members(rows, "metrics").withColumnRenamed("key", "model").withColumn("use", at(F.col("value"), "$.usage")).where(is_object(F.col("use")))
    n = lambda name: number_or_zero(F.col("use"), f"$.{name}")
    none = F.lit(None).cast("string")
    meta = _metadata(F.col("kv")["cwd"], F.col("kv")["branch"], F.col("session"), none, none, F.lit(""), F.lit(""), F.lit("copilot-cli"), none)
    ident = F.concat_ws(":", "session", "model", iso_string(F.col("time")))
    out = rows.select(*_event("copilot-cli", external_id=ident, provider=F.lit("openai"), model=F.col("model"), input_tokens=n("inputTokens"), output_tokens=n("outputTokens"), cache_read_tokens=n("cacheReadTokens"), cache_creation_tokens=n("cacheWriteTokens"), cache_write_tokens=n("cacheWriteTokens"), cache_creation_5m_tokens=F.lit(0), cache_creation_1h_tokens=F.lit(0), occurred_at=F.col("time"), metadata=meta))
    return U.suffix_duplicates(out, "external_id", ["source_rank", "file_path", "line_no", "model"])


def codex_files(spark: SparkSession, homes: list[str]) -> DataFrame:
    """file_path, modified, length and source_rank of the session files to read, chosen by paths alone.

    Session files before archived ones, one for each relative path of a home; a home with neither folder is read itself.
    """
    out = None
    for rank, home in enumerate(homes):
        roots = _codex_roots(spark, home)
        files = listed_files(spark, roots or [home], recursive=True, name="*.jsonl")
        if roots:
            rel = F.regexp_replace("file_path", r"^.*?/(?:sessions|archived_sessions)/", "")
            files = U.first_of(files.withColumn("rel", rel), ["rel"], ["source_rank", "file_path"]).drop("rel")
        files = files.withColumn("source_rank", F.lit(2 * rank) + F.col("source_rank"))
        out = files if out is None else out.unionByName(files)
    return out


def _codex_roots(spark: SparkSession, home: str) -> list[str]:
    return [r for r in (f"{home}/sessions", f"{home}/archived_sessions") if existing(spark, [r])]


def codex_lines(spark: SparkSession, homes: list[str], since: Column | None = None) -> DataFrame:
    """The lines of the chosen files. The choice meets the lines by path, broadcast like the listing it comes from, so no content is shuffled."""
    out = None
    for rank, home in enumerate(homes):
        rows = file_lines(spark, _codex_roots(spark, home) or [home], recursive=True, name="*.jsonl", since=since).withColumn("source_rank", F.lit(2 * rank) + F.col("source_rank"))
        out = rows if out is None else out.unionByName(rows)
    chosen = codex_files(spark, homes).select("file_path", "source_rank")
    return out.join(F.broadcast(chosen), ["file_path", "source_rank"], "left_semi")


def _usage_block(v: Column, path: str) -> Column:
    names = [n for n in COUNTERS]
    return F.when(is_object(at(v, path)), F.struct(*(number_or_zero(v, f"{path}.{n}", negative=False).alias(n) for n in names)))


def scan_codex(spark: SparkSession, bases: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """The events of the session files of all homes, or of the given folders."""
    rows = codex_lines(spark, codex_homes(), since) if bases is None else file_lines(spark, bases, recursive=True, name="*.jsonl", since=since)
    return codex_events(json_lines(rows), since)


def codex_parts(rows: DataFrame) -> DataFrame:
    """The fields of session, turn and token count lines that the session state is made of."""
    v = F.col("v")
    text = lambda path: string_or_null(v, path, keep_empty=False)
    rows = rows.where(is_object(at(v, "$.payload")))
    kind = string_or_null(v, "$.type")
    meta, turn = kind == "session_meta", kind == "turn_context"
    count = (kind == "event_msg") & (string_or_null(v, "$.payload.type") == "token_count")
    session = F.struct(F.coalesce(text("$.payload.session_id"), text("$.payload.id")).alias("id"), F.coalesce(text("$.payload.originator"), text("$.payload.source")).alias("client"), text("$.payload.cli_version").alias("version"))
    cwd = text("$.payload.cwd")
    return rows.select(
        "file_path", "source_rank", "line_no", F.coalesce(count, F.lit(False)).alias("count"),
        F.when(meta, session).alias("meta"),
        F.when(meta & is_object(at(v, "$.payload.git")), F.struct(text("$.payload.git.branch").alias("branch"))).alias("git"),
        F.when(turn, F.struct(text("$.payload.turn_id").alias("id"), text("$.payload.model").alias("model"))).alias("turn"),
        F.when(meta | (turn & cwd.isNotNull()), F.struct(cwd.alias("cwd"))).alias("dir"),
        F.when(count, iso_timestamp(text("$.timestamp"))).alias("time"),
        F.when(count, is_object(at(v, "$.payload.info"))).alias("has_info"),
        F.coalesce(text("$.payload.model"), text("$.payload.info.model")).alias("own_model"),
        F.when(count, _usage_block(v, "$.payload.info.total_token_usage")).alias("total"),
        F.when(count, _usage_block(v, "$.payload.info.last_token_usage")).alias("last"),
    ).where("count or meta is not null or turn is not null")


def codex_events(rows: DataFrame, since: Column | None = None) -> DataFrame:
    """Events of token counts, with the session state rebuilt by windows over each file.

    The windows of a file share one shuffle and one sort; `since` drops events only after the state is whole.
    """
    rows = codex_parts(rows)
    keys, order = ["source_rank", "file_path"], ["line_no"]
    w = U.up_to(keys, order)
    rows = rows.withColumns({c: U.fill(F.col(c), w) for c in ("meta", "git", "turn", "dir")}).where("count")
    live = F.col("time").isNotNull() & F.col("meta.id").isNotNull() & F.col("has_info")
    rows = rows.where(live)
    rows = rows.withColumn("use", U.choose_usage(F.col("total"), F.col("last"), U.before(keys, order), COUNTERS)).withColumn("model", F.coalesce("own_model", "turn.model")).where("use is not null and model is not null").where(newer(F.col("time"), since))
    return U.suffix_duplicates(codex_usage(rows), "external_id", ["source_rank", "file_path", "line_no"])


def codex_ident() -> Column:
    """The id of a count, without suffix."""
    return F.concat_ws(":", F.col("meta.id"), F.coalesce("turn.id", F.lit("turn-unknown")), iso_string(F.col("time")))


def codex_usage(rows: DataFrame, ident: Column | None = None) -> DataFrame:
    """rows: counts with the state in force (meta, git, turn, dir), their time, use and model. Usage events, without suffixes unless `ident` has them."""
    ident = codex_ident() if ident is None else ident
    read, write = F.col("use.cached_input_tokens"), F.col("use.cache_write_input_tokens")
    about = _metadata(F.col("dir.cwd"), F.col("git.branch"), F.col("meta.id"), F.col("meta.version"), F.col("meta.client"), F.lit(socket.gethostname()), F.lit(platform.system().lower()), F.coalesce("meta.client", F.lit("codex")), F.col("meta.version"))
    return rows.select(*_event("codex", external_id=ident, provider=F.lit("openai"), model=F.col("model"), input_tokens=U.exclusive_input(F.col("use.input_tokens"), read, write), output_tokens=F.col("use.output_tokens"), cache_read_tokens=read, cache_creation_tokens=write, cache_write_tokens=write, cache_creation_5m_tokens=F.lit(0), cache_creation_1h_tokens=F.lit(0), occurred_at=F.col("time"), metadata=about))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all surfaces."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Surfaces by name; add a scan to extend the engine.
SCANNERS: dict[str, Callable[..., DataFrame]] = {"claude-code": scan_claude_code, "copilot-cli": scan_copilot_cli, "codex": scan_codex}


def detected_logs(spark: SparkSession, bases: list[str]) -> DataFrame:
    """dir and entries of each existing log folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for b in existing(spark, bases):
        path = jvm.org.apache.hadoop.fs.Path(b)
        rows.append((b, len(path.getFileSystem(conf).listStatus(path))))
    return spark.createDataFrame(rows, "dir string, entries long")
