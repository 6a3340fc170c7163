"""The sync run: scan, filter, batch and store usage events; attribute them; classify commits.

Everything a run writes goes to folders of its own (`run=<id>`), which nothing reads until the manifest names them. A manifest is one small file with a version
number, made by a rename that fails if the version is there, so a run is in the ledger wholly or not at all and of two runs at a time one raises. What a run that
died left behind is deleted by the next one. The state file with the watermarks is replaced after the manifest, in one rename; a run that dies between the two is
read again, and the sink drops the ids it has. Batch ids go on from run to run. A surface that fails keeps its old watermark.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.variant import iso_string, iso_timestamp
from ..operators import commits as C
from ..operators.filters import LEGACY_SURFACES, parse_state, sane, unseen
from ..operators.usage import batches
from ..sources.lines import read_small
from ..sources.surfaces import SCANNERS

EVENT_BATCH, ATTRIBUTION_BATCH, FATE_BATCH = 250, 1000, 2000
LOOPBACK = {"localhost", "127.0.0.1", "::1"}


def secure_url(raw: str) -> str:
    """https, or http on a loopback host; anything else raises."""
    from urllib.parse import urlsplit

    url = urlsplit(raw)
    if not url.scheme or not url.hostname:
        raise ValueError(f"not a server URL: {raw}")
    if url.scheme == "https" or url.scheme == "http" and url.hostname in LOOPBACK:
        return raw
    raise ValueError(f"insecure server URL: {url.scheme}://{url.netloc}")


EVENTS = schemas.USAGE_EVENT + ", batch_id long"


def since_for(state: dict, surface: str):
    """A surface's watermark as a column, or None."""
    own, legacy = state["surfaces"].get(surface), state["lastSyncAt"]
    text = own or (legacy if surface in LEGACY_SURFACES else None)
    return iso_timestamp(F.lit(text)) if text else None


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Writes a small file in any file system Spark knows aside and renames it, over an old one if `replace`, else raising FileExistsError if there is one."""
    from py4j.protocol import Py4JJavaError

    sc = spark.sparkContext
    aside, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    rename = getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        files.rename(aside, at, how)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if not replace and "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none if it is missing."""
    at, fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


#: What each kind of run writes; of events all runs count, of the others the last.
PARTS = {"events": ("events", "wire/events"), "attributions": ("attributions", "repo_sizes", "wire/attributions"), "fates": ("fates", "wire/fates")}


class Ledger:
    """A folder, in any file system Spark knows, with the stored relations, their wire forms and the state file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: By surface, rows of the last sync that the sink had already (or that repeat an id).
        self.skipped: dict[str, int] = {}

    def state(self) -> dict:
        return parse_state(read_small(self.spark, f"{self.folder}/state.json"))

    def save_state(self, state: dict) -> None:
        write_text(self.spark, f"{self.folder}/state.json", json.dumps(state, indent=2))

    def denied(self) -> list[str]:
        try:
            names = json.loads(read_small(self.spark, f"{self.folder}/config.json") or "{}").get("denyRepos", [])
        except (ValueError, AttributeError):
            names = []
        return [n for n in names if isinstance(n, str)]

    def deny(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.denied()], "repo_name string")

    def exclude(self, repo: str) -> None:
        write_text(self.spark, f"{self.folder}/config.json", json.dumps({"denyRepos": sorted({*self.denied(), repo})}))

    def manifest(self) -> dict:
        """The newest manifest: version, runs of events (run, surface, rows, batches) and the current runs of the other kinds."""
        versions = sorted(n for n in folders(self.spark, f"{self.folder}/manifest") if n.endswith(".json"))
        if not versions:
            return {"version": 0, "events": [], "attributions": None, "fates": None}
        return json.loads(read_small(self.spark, f"{self.folder}/manifest/{versions[-1]}"))

    def commit(self, manifest: dict, **changes) -> dict:
        """The next version of a manifest; raises FileExistsError if another run has made one since it was read."""
        new = manifest | changes | {"version": manifest["version"] + 1}
        write_text(self.spark, f"{self.folder}/manifest/{new['version']:010d}.json", json.dumps(new), replace=False)
        for name in folders(self.spark, f"{self.folder}/manifest"):
            if name.endswith(".json") and int(name.split(".")[0]) < new["version"] - 1:
                delete(self.spark, f"{self.folder}/manifest/{name}")
        return new

    def recover(self, manifest: dict) -> None:
        """Deletes what no manifest names."""
        for kind, parts in PARTS.items():
            live = {e["run"] for e in manifest["events"]} if kind == "events" else {manifest[kind]}
            for part in parts:
                for name in folders(self.spark, f"{self.folder}/{part}"):
                    if name.startswith("run=") and name[4:] not in live:
                        delete(self.spark, f"{self.folder}/{part}/{name}")

    def _wrote(self, what: str) -> None:
        """Called after each write; tests stop a run here."""

    def _save(self, df: DataFrame, part: str, run: str) -> DataFrame:
        """Writes a part of a run and returns it as it was written."""
        at = f"{self.folder}/{part}/run={run}"
        df.write.parquet(at)
        self._wrote(part)
        return self.spark.read.schema(df.schema).parquet(at)

    def _live(self, part: str, schema: str) -> DataFrame:
        runs = [f"{self.folder}/{part}/run={e['run']}" for e in self.manifest()["events"]]
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._live("events", EVENTS)

    def envelopes(self) -> DataFrame:
        """The envelopes of all stored events: surface, batch_id, n_events, body."""
        return self._live("wire/events", "surface string, batch_id long, n_events int, body string")

    def sync(self, full: bool = False, bases: dict[str, list[str]] | None = None, now: datetime | None = None, account: DataFrame | None = None) -> dict[str, int]:
        """Stores the new events of every surface and the envelopes that carry them; returns their number by surface."""
        now = now or datetime.now(timezone.utc)
        state, out, manifest = self.state(), {}, self.manifest()
        self.recover(manifest)
        account = self.spark.createDataFrame([], schemas.ACCOUNT) if account is None else account
        for surface, scan in SCANNERS.items():
            since = None if full else since_for(state, surface)
            rows = scan(self.spark, None if bases is None else bases.get(surface, []), since)
            read = Observation(f"read-{surface}-{uuid.uuid4().hex}")
            rows = rows.where(sane(F.col("external_id"), F.col("occurred_at"), F.lit(now))).observe(read, F.count(F.lit(1)).alias("n"))
            found, run = f"{self.folder}/found/{surface}", uuid.uuid4().hex
            rows.write.mode("overwrite").parquet(found)
            self._wrote("found")
            order = ["source_rank", "file_path", "line_no"]
            before = sum(e["batches"] for e in manifest["events"] if e["surface"] == surface)
            new = batches(unseen(self.spark.read.parquet(found), self.events(), "external_id", order), EVENT_BATCH, ["surface"], order, ["source_rank", "file_path"])
            new = self._save(new.withColumn("batch_id", F.col("batch_id") + before), "events", run)
            total = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("batch_id") + 1 - before, F.lit(0)).alias("batches")).first()
            out[surface] = total.n
            self.skipped[surface] = read.get["n"] - out[surface]
            self._save(wire_events(new, account if surface == "claude-code" else account.limit(0)), "wire/events", run)
            if total.n:
                manifest = self.commit(manifest, events=[*manifest["events"], {"run": run, "surface": surface, "rows": total.n, "batches": total.batches}])
                self._wrote("manifest")
            else:
                for part in PARTS["events"]:
                    delete(self.spark, f"{self.folder}/{part}/run={run}")
            state["surfaces"][surface] = now.astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            self.save_state(state)
            self._wrote("state")
        return out

    def attribute(self, events: DataFrame, cwd_repo: DataFrame, repo_commits: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """Stores and returns the attributions, in batches, and their envelopes; files: repo_root, length, content of the tracked files."""
        rows = C.attribute(events, cwd_repo, repo_commits, self.deny())
        manifest, run = self.manifest(), uuid.uuid4().hex
        rows = self._save(batches(rows.withColumn("surface", F.lit("all")), ATTRIBUTION_BATCH, ["surface"], ["repo_name", "external_id", "commit_sha"], ["repo_name"]).drop("surface"), "attributions", run)
        met = C.allowed(cwd_repo.where("repo_root is not null").select("repo_root").distinct().withColumn("repo_name", C.repo_name(F.col("repo_root"))), self.deny())
        if files is None:
            sizes = met.select("repo_name", F.lit(None).cast("long").alias("total_loc"), F.lit(0).cast("long").alias("file_count"))
        else:  # a repository without tracked files has no lines, one of too many files an unknown number
            none = F.col("file_count").isNull()
            sizes = met.join(C.repo_size(files, ["repo_root"]), "repo_root", "left").select("repo_name", F.when(none, F.lit(0)).otherwise(F.col("total_loc")).cast("long").alias("total_loc"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))
        self._save(wire_attributions(rows, self._save(sizes, "repo_sizes", run)), "wire/attributions", run)
        self.recover(self.commit(manifest, attributions=run))
        return rows

    def classify(self, facts: dict[str, DataFrame]) -> DataFrame:
        """Stores and returns the fates, in batches, and their envelopes; facts: the tables of `operators.commits.fates` by name."""
        rows = C.fates(**facts).withColumn("repo_name", C.repo_name(F.col("repo_root"))).withColumn("surface", F.lit("all"))
        manifest, run = self.manifest(), uuid.uuid4().hex
        rows = self._save(batches(rows, FATE_BATCH, ["surface"], ["repo_root", "sha"], ["repo_root"]).drop("surface"), "fates", run)
        self._save(wire_fates(rows), "wire/fates", run)
        self.recover(self.commit(manifest, fates=run))
        return rows


def wire_events(events: DataFrame, account: DataFrame) -> DataFrame:
    """One envelope for each batch: surface, batch_id and the JSON of source, account and events."""
    event = F.struct(*[c for c in events.columns if c not in ("occurred_at", "batch_id", "source_rank", "file_path", "line_no")], iso_string(F.col("occurred_at")).alias("occurred_at"))
    order = F.struct("source_rank", "file_path", "line_no", event.alias("e"))
    groups = events.groupBy("surface", "batch_id").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    acct = account.limit(1).select(F.struct("*").alias("account"))
    body = F.to_json(F.struct(F.struct("surface", F.lit("local_logs").alias("kind")).alias("source"), "account", F.transform("rows", lambda r: r["e"]).alias("events")))
    return groups.join(F.broadcast(acct), F.lit(True), "left").select("surface", "batch_id", F.size("rows").alias("n_events"), body.alias("body"))


def wire_attributions(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One envelope for each batch of attributions: batch_id, n_rows and the JSON of all repositories and the batch.

    The repositories, few beside the events, stand in every envelope; a batch has ATTRIBUTION_BATCH rows at most.
    """
    one = F.struct(F.col("external_id").alias("externalId"), F.col("repo_name").alias("repoName"), F.col("commit_sha").alias("commitSha"), iso_string(F.col("committed_at")).alias("committedAt"), "branch", F.col("lines_added").alias("linesAdded"), F.col("lines_deleted").alias("linesDeleted"), F.col("files_changed").alias("filesChanged"))
    repo = F.struct(F.col("repo_name").alias("name"), F.col("total_loc").alias("totalLoc"), F.col("file_count").alias("fileCount"))
    repos = sizes.agg(F.array_sort(F.collect_list(repo)).alias("repos"))
    groups = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(one)).alias("attributions"))
    return groups.join(F.broadcast(repos), F.lit(True)).select("batch_id", "n_rows", F.to_json(F.struct("repos", "attributions"), {"ignoreNullFields": "false"}).alias("body"))


def wire_fates(rows: DataFrame) -> DataFrame:
    """One envelope for each batch of fates: batch_id, n_rows and its JSON, with no repositories or attributions."""
    one = F.struct(F.col("repo_name").alias("repoName"), F.col("sha").alias("commitSha"), "branch", "fate")
    groups = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(one)).alias("fates"))
    none = F.array().cast("array<string>")
    return groups.select("batch_id", "n_rows", F.to_json(F.struct(none.alias("repos"), none.alias("attributions"), "fates"), {"ignoreNullFields": "false"}).alias("body"))


def rollup(events: DataFrame, by: list[str]) -> DataFrame:
    """Extension: token totals; the neutral cache-write bucket replaces the two timed ones where it is set."""
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.coalesce("cache_write_tokens", F.col("cache_creation_5m_tokens") + F.col("cache_creation_1h_tokens"))
    return events.rollup(*by).agg(F.count(F.lit(1)).alias("events"), F.sum(total).alias("tokens"))
