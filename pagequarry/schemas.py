"""Explicit schemas of the job's tables, as column name -> SQL type; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = "map<string,string>"
ERROR = (
    "struct<kind:string,refused:boolean,detail:string,status_code:int,"
    "timeout_s:double,proxy:string>"
)
NOTES = "array<struct<key:string,params:map<string,string>>>"

REQUESTS = {
    "batch_id": "bigint",
    "ord": "bigint",
    "url_raw": "string",
    "format": "string",
    "timeout_s": "double",
}

# One row per attempt at a URL; (url, attempt) is the key.
CAPTURES = {
    "url": "string",
    "attempt": "int",
    "proxy": "string",
    # a plain HTTP look before the browser
    "probe_status": "int",
    "probe_type": "string",
    "probe_url": "string",
    "probe_body": "binary",
    "probe_error_kind": "string",
    "probe_error_text": "string",
    "proxy_status": "int",
    "probe_skipped": "boolean",
    # what the browser saw
    "start_error": "string",
    "raised": "boolean",
    "success": "boolean",
    "error_text": "string",
    "first_status": "int",
    "final_status": "int",
    "final_url": "string",
    "headers": HEADERS,
    "html": "string",
    "body": "binary",
    "pdf": "binary",
    "screenshot": "string",
    "mhtml": "string",
    # a plain download after the browser
    "dl_status": "int",
    "dl_type": "string",
    "dl_url": "string",
    "dl_headers": HEADERS,
    "dl_body": "binary",
    "dl_error_kind": "string",
    "dl_error_text": "string",
}

FINAL_RESPONSES = {
    "url": "string",
    "attempt": "int",
    "status": "int",
    "headers": HEADERS,
    "body": "binary",
}

OUTCOMES = {
    "batch_id": "bigint",
    "ord": "bigint",
    "url": "string",
    "ok": "boolean",
    "final_url": "string",
    "status_code": "int",
    "content_kind": "string",
    "content_type": "string",
    "text": "string",
    "data": "binary",
    "extension": "string",
    "title": "string",
    "error": ERROR,
    "notes": NOTES,
}

ARTIFACTS = {"token": "string", "path": "string", "seq": "bigint"}
DELIVERIES = {"token": "string", "method": "string", "ranged": "boolean", "complete": "boolean"}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


def conform(df: DataFrame, schema: dict[str, str], keep_extra: bool = False) -> DataFrame:
    """Cast the columns of ``df`` to ``schema``; missing ones become null."""
    have = set(df.columns)
    columns = [
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in schema.items()
    ]
    extra = [c for c in df.columns if c not in schema] if keep_extra else []
    return df.select(*columns, *extra)
