"""The mark of a masked dataset, and the audit of runs.  Anything unclear counts as not masked."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkmask.sources.dataset import AUDIT, STAMP, Folder

# The stamp's properties.
SANITIZED, SANITIZED_UTC, CONFIG_HASH, TOOL_VERSION = "Sanitized", "SanitizedUtc", "ConfigHash", "ToolVersion"
VERSION = "0.1.0"
AUDIT_SCHEMA = "RunUtc timestamp_ntz, ToolVersion string, ConfigHash string, TablesTouched int, RowsUpdated long, DurationSeconds decimal(18,2)"


@dataclass(frozen=True)
class Status:
    sanitized: bool
    when: dt.datetime | None = None
    config_hash: str | None = None
    tool_version: str | None = None


def interpret(properties: dict[str, str | None] | None) -> Status:
    """Only 'true' in any case and '1' count, space around aside; a date that can't be read leaves the stamp valid."""
    given = properties or {}
    flag = (given.get(SANITIZED) or "").strip().lower()
    try:
        when = dt.datetime.fromisoformat((given.get(SANITIZED_UTC) or "").strip())
        when = when.astimezone(dt.UTC) if when.tzinfo else when.replace(tzinfo=dt.UTC)
    except ValueError:
        when = None
    return Status(flag in ("true", "1"), when, given.get(CONFIG_HASH), given.get(TOOL_VERSION))


def read(folder: Folder) -> Status:
    text = folder.read_text(STAMP)
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    return interpret(found if isinstance(found, dict) else {})


@dataclass(frozen=True)
class Record:
    run_utc: dt.datetime
    config_hash: str
    tables_touched: int
    rows_updated: int
    duration_seconds: float


def write(folder: Folder, record: Record) -> None:
    """The stamp first, then the audit row."""
    when = record.run_utc.astimezone(dt.UTC)
    folder.write_text(STAMP, json.dumps({SANITIZED: "true", SANITIZED_UTC: when.isoformat(), CONFIG_HASH: record.config_hash, TOOL_VERSION: VERSION}))
    row = (when.replace(tzinfo=None), VERSION, record.config_hash, record.tables_touched, record.rows_updated, f"{record.duration_seconds:.2f}")
    schema = AUDIT_SCHEMA.replace("DurationSeconds decimal(18,2)", "DurationSeconds string")
    df = folder.spark.createDataFrame([row], schema)
    df.withColumn("DurationSeconds", df["DurationSeconds"].cast("decimal(18,2)")).write.mode("append").parquet(f"{folder.root}/{AUDIT}")


def audit(folder: Folder) -> DataFrame:
    if not folder.exists(AUDIT):
        return folder.spark.createDataFrame([], AUDIT_SCHEMA)
    return folder.spark.read.schema(AUDIT_SCHEMA).parquet(f"{folder.root}/{AUDIT}")
