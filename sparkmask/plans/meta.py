"""Facts about tables that Spark doesn't keep: keys, unique rules, history, computed and generated columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T

#: The audit table that the tool itself writes; no rule can name it.
TOOL_TABLE = "dbo.__SanitizationLog"
SYSTEM_SCHEMAS = frozenset({"sys", "cdc", "information_schema"})


class Temporal(Enum):
    NONE = 0
    HISTORY = 1
    VERSIONED = 2


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    data_type: T.DataType
    nullable: bool = True
    max_length: int | None = None  # characters; None where there is no limit
    computed: str | None = None  # the expression that rebuilds it
    identity: bool = False
    generated: bool = False
    unsigned: bool = False  # a one-byte integer from 0 to 255
    uuid: bool = False
    padded: bool = False

    @property
    def writable(self) -> bool:
        return self.computed is None and not self.identity and not self.generated

    @property
    def textual(self) -> bool:
        return isinstance(self.data_type, T.StringType) and not self.uuid


@dataclass(frozen=True)
class UniqueRule:
    name: str
    columns: tuple[str, ...]

    def covers(self, column: str) -> bool:
        return column.lower() in (c.lower() for c in self.columns)


@dataclass(frozen=True)
class TableMeta:
    name: str  # schema.table
    columns: tuple[ColumnMeta, ...]
    primary_key: tuple[str, ...] = ()
    unique_rules: tuple[UniqueRule, ...] = ()
    temporal: Temporal = Temporal.NONE
    history: str | None = None
    change_feed: bool = False

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def in_key(self, name: str) -> bool:
        return name.lower() in (k.lower() for k in self.primary_key)

    @property
    def key_columns(self) -> tuple[ColumnMeta, ...]:
        """In key order; names that the table lacks are left out."""
        return tuple(c for c in map(self.column, self.primary_key) if c)


@dataclass(frozen=True)
class Catalog:
    name: str
    tables: tuple[TableMeta, ...]
    change_feed: bool = False

    def table(self, name: str) -> TableMeta | None:
        return next((t for t in self.tables if t.name.lower() == name.lower()), None)

    @property
    def history_names(self) -> frozenset[str]:
        """Lower-cased names of tables that keep another's history."""
        linked = {t.history.lower() for t in self.tables if t.history}
        return frozenset(linked | {t.name.lower() for t in self.tables if t.temporal is Temporal.HISTORY})


def columns_of(schema: T.StructType) -> tuple[ColumnMeta, ...]:
    """What a schema tells; CHAR and VARCHAR lengths come from the fields' metadata."""
    out = []
    for f in schema.fields:
        declared = re.match(r"(char|varchar)\((\d+)\)", f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", ""))
        kind = f.dataType
        if isinstance(kind, (T.CharType, T.VarcharType)):
            declared = re.match(r"(char|varchar)\((\d+)\)", kind.simpleString())
            kind = T.StringType()
        out.append(ColumnMeta(f.name, kind, f.nullable, int(declared[2]) if declared else None, padded=bool(declared) and declared[1] == "char"))
    return tuple(out)


def table_meta(name: str, schema: T.StructType, facts: dict | None = None) -> TableMeta:
    """A table from its schema and its entry in the sidecar file.

    facts: primaryKey, unique ({name: columns}), history, temporal, changeFeed, and columns ({name: {maxLength, computed,
    identity, generated, unsigned, uuid, nullable}}).
    """
    facts = facts or {}
    extra = {k.lower(): v for k, v in facts.get("columns", {}).items()}
    names = {"maxLength": "max_length", "computed": "computed", "identity": "identity", "generated": "generated", "unsigned": "unsigned", "uuid": "uuid", "nullable": "nullable"}
    columns = tuple(replace(c, **{names[k]: v for k, v in extra.get(c.name.lower(), {}).items() if k in names}) for c in columns_of(schema))
    history = facts.get("history")
    kind = Temporal[facts["temporal"].upper()] if "temporal" in facts else Temporal.VERSIONED if history else Temporal.NONE
    unique = tuple(UniqueRule(k, tuple(v)) for k, v in facts.get("unique", {}).items())
    return TableMeta(name, columns, tuple(facts.get("primaryKey", ())), unique, kind, history, bool(facts.get("changeFeed")))


def build_catalog(name: str, schemas: dict[str, T.StructType], sidecar: str | dict | None = None) -> Catalog:
    """All tables but those of system schemas, by schema and name."""
    facts = json.loads(sidecar) if isinstance(sidecar, str) else sidecar or {}
    by_name = {k.lower(): v for k, v in facts.get("tables", {}).items()}
    kept = sorted((n for n in schemas if n.split(".")[0].lower() not in SYSTEM_SCHEMAS), key=lambda n: n.lower().split("."))
    return Catalog(name, tuple(table_meta(n, schemas[n], by_name.get(n.lower())) for n in kept), bool(facts.get("changeFeed")))


def inventory(spark, catalog: Catalog):
    """The catalog's columns as a DataFrame: (table, ordinal, column, type, nullable, writable, textual, key_ordinal)."""
    rows = []
    for t in catalog.tables:
        keys = [k.lower() for k in t.primary_key]
        for i, c in enumerate(t.columns, 1):
            rows.append((t.name, i, c.name, c.data_type.simpleString(), c.nullable, c.writable, c.textual, keys.index(c.name.lower()) + 1 if c.name.lower() in keys else None))
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string, nullable boolean, writable boolean, textual boolean, key_ordinal int")


