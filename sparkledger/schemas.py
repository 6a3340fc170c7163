"""Schemas of the engine's relations."""

from __future__ import annotations

USAGE_EVENT = (
    "surface string, source_rank int, file_path string, line_no long, external_id string, provider string, model string, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cache_write_tokens long, "
    "cache_creation_5m_tokens long, cache_creation_1h_tokens long, occurred_at timestamp, "
    "metadata struct<cwd:string,git_branch:string,session_id:string,version:string,entrypoint:string,"
    "origin:struct<host:string,platform:string,client:string,client_version:string>>"
)
ACCOUNT = "account_uuid string, email_address string, organization_uuid string, billing_type string"
REPO_COMMIT = "sha string, committed_at timestamp, lines_added long, lines_deleted long, files_changed long, ord int"
