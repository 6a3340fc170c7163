"""Incremental and sanity filters, watermarks, idempotent ingest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import iso_timestamp

#: Surfaces that fall back to the legacy shared watermark (fixed values).
LEGACY_SURFACES = ("claude-code", "copilot-cli", "codex")
#: Surfaces whose events are attributed to commits (fixed values).
ATTRIBUTED_SURFACES = ("claude-code", "codex")
EARLIEST = "2020-01-01T00:00:00Z"


def newer(occurred_at: Column, since: Column | None) -> Column:
    """Strictly after the watermark; everything without one."""
    return F.lit(True) if since is None else since.isNull() | (occurred_at > since)


def touched(modified: Column, since: Column | None) -> Column:
    """A file whose modification time equals the watermark is read again."""
    return F.lit(True) if since is None else since.isNull() | (modified >= since)


def sane(external_id: Column, occurred_at: Column, now: Column) -> Column:
    """A non-empty id and a time from 2020 to a day ahead, both ends included."""
    low = F.to_timestamp(F.lit(EARLIEST))
    return (F.length(external_id) > 0) & occurred_at.between(low, now + F.expr("INTERVAL 24 HOURS"))


def parse_state(text: str | None) -> dict:
    """lastSyncAt and surfaces of a state file; members of a wrong type are dropped."""
    try:
        raw = json.loads(text or "")
    except ValueError:
        raw = {}
    raw = raw if isinstance(raw, dict) else {}
    surfaces = raw.get("surfaces")
    surfaces = surfaces if isinstance(surfaces, dict) else {}
    last = raw.get("lastSyncAt")
    return {"lastSyncAt": last if isinstance(last, str) else None, "surfaces": {k: v for k, v in surfaces.items() if isinstance(v, str)}}


def watermark(surface: Column, own: Column, legacy: Column) -> Column:
    """A surface's own watermark if it has one (an invalid one is none), else the legacy one for the frozen surfaces."""
    return F.when(F.length(own) > 0, iso_timestamp(own)).when(surface.isin(*LEGACY_SURFACES) & (F.length(legacy) > 0), iso_timestamp(legacy))


def unseen(incoming: DataFrame, sink: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """The first row of each id that the sink does not have.

    The sink's ids are met with the incoming ones, which AQE broadcasts while they are few, so that a sync of a
    few new rows scans one column of the sink and shuffles none of it.
    """
    from .usage import first_of

    seen = sink.select(ident).join(incoming.select(ident), ident, "left_semi").distinct()
    return first_of(incoming, [ident], order).join(seen, ident, "left_anti")


def allowed(df: DataFrame, deny: DataFrame, name: str = "repo_name") -> DataFrame:
    """Rows whose repository is not on the deny list; AQE broadcasts the list while it is small."""
    return df.join(deny.select(name).distinct(), name, "left_anti")
