"""The ledger's sink: runs that stop between any two writes, two at a time, batch ids, sizes."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkledger.plans import sync
from sparkledger.plans.sync import Ledger, folders, write_text
from tests_logs import assistant, write

T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


class Stopped(Exception):
    pass


class Dying(Ledger):
    """Stops after its n-th write."""

    left = 0

    def _wrote(self, what):
        self.left -= 1
        if self.left == 0:
            raise Stopped(what)


def content(book):
    events = sorted(r.external_id for r in book.events().collect())
    sent = [e["id"] for r in book.envelopes().collect() for e in ({"id": x["external_id"]} for x in json.loads(r.body)["events"])]
    ids = [(r.surface, r.batch_id) for r in book.envelopes().collect()]
    assert sorted(sent) == events and len(set(ids)) == len(ids)
    assert {(r.surface, r.batch_id) for r in book.events().collect()} == set(ids)
    return events


def test_a_run_that_stops_anywhere_is_repeated_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "SCANNERS", {"claude-code": sync.SCANNERS["claude-code"]})
    logs = tmp_path / "logs"
    write(logs / "c" / "p" / "a.jsonl", [assistant(f"r{i}") for i in range(3)])
    bases = {"claude-code": [str(logs / "c")]}
    stops, n = [], 0
    while True:
        n += 1
        book = Dying(spark, str(tmp_path / f"book{n}"))
        book.left = n
        try:
            book.sync(bases=bases, now=T0)
        except Stopped as e:
            stops.append(str(e))
        else:
            break
        book.left = 0
        write(logs / "c" / "p" / f"late{n}.jsonl", [assistant(f"n{n}", time="2024-05-01T11:00:00Z")])
        want = sorted(["r0", "r1", "r2"] + [f.stem.replace("late", "n") for f in (logs / "c" / "p").glob("late*")])
        book.sync(bases=bases, now=T0, full=True)
        assert content(book) == want, stops[-1]
        assert {x[4:] for x in folders(spark, f"{book.folder}/events")} == {e["run"] for e in book.manifest()["events"]}
    assert stops == ["found", "events", "wire/events", "manifest", "state"]


def test_batches_go_on_and_runs_exclude_each_other(spark, tmp_path):
    logs, book = tmp_path / "logs", Ledger(spark, str(tmp_path / "book"))
    bases = {"claude-code": [str(logs)]}
    for k in range(3):
        write(logs / "p" / f"{k}.jsonl", [assistant(f"r{k}-{i}", time=f"2024-05-01T10:0{k}:00Z") for i in range(260)])
        book.sync(bases=bases, now=T0, full=True)
    assert sorted(r.batch_id for r in book.envelopes().collect()) == list(range(6))
    assert len(folders(spark, f"{book.folder}/manifest")) == 2 and len(content(book)) == 780
    stale = book.manifest()
    book.commit(stale, fates=None)
    with pytest.raises(FileExistsError):
        book.commit(stale, fates=None)
    assert not [x for x in folders(spark, f"{book.folder}/manifest") if x.endswith(".new")]


def test_state_is_replaced_in_one_step(spark, tmp_path):
    at = str(tmp_path / "state.json")
    for text in ("one", "two"):
        write_text(spark, at, text)
        assert (tmp_path / "state.json").read_text() == text
    with pytest.raises(FileExistsError):
        write_text(spark, at, "three", replace=False)
    assert (tmp_path / "state.json").read_text() == "two"


def test_sizes_of_repositories(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"))
    write(tmp_path / "logs" / "p" / "a.jsonl", [assistant("r1"), assistant("r2") | {"cwd": "/v"}])
    book.sync(bases={"claude-code": [str(tmp_path / "logs")]}, now=T0)
    df = spark.createDataFrame
    cwd = df([("/w", "/src/app"), ("/v", "/src/bare")], "cwd string, repo_root string")
    log = df([(r, f"c{r}", T0 + timedelta(minutes=30), 1, 1, 1, 0) for r in ("/src/app", "/src/bare")], "repo_root string, sha string, committed_at timestamp, lines_added long, lines_deleted long, files_changed long, ord int")
    files = df([("/src/app", 4, bytearray(b"a\nb\n"))], "repo_root string, length long, content binary")
    for _ in range(2):
        book.attribute(book.events(), cwd, log, files)
    wired = [json.loads(r.body) for r in spark.read.parquet(f"{book.folder}/wire/attributions").collect()]
    assert len(wired) == 1 and wired[0]["repos"] == [{"name": "app", "totalLoc": 3, "fileCount": 1}, {"name": "bare", "totalLoc": 0, "fileCount": 0}]
    assert len(folders(spark, f"{book.folder}/attributions")) == 1 and book.events().where(F.col("batch_id") == 0).count() == 2
