"""Checks that a written value fits a column and turns it into a Python value."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from .meta import ColumnMeta
from .rules import StaticSpec

_WHOLE = re.compile(r"-?[0-9]+\Z")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


class Refused(ValueError):
    """Why a value can't be written."""


def convert(spec: StaticSpec, column: ColumnMeta):
    """The value for a column; Refused where kind, range, form or length doesn't fit.  Quoted and unquoted differ."""
    kind = column.data_type
    if column.uuid:
        return _parsed(spec, column, "a GUID", lambda s: str(uuid.UUID(s)))
    if isinstance(kind, T.StringType):
        text = _string(spec, column)
        if column.max_length is not None and len(text) > column.max_length:
            raise Refused(f"{column.name} holds {column.max_length} characters and the value has {len(text)}.")
        return text
    if type(kind) in _BITS:
        return _integer(spec, column)
    if isinstance(kind, T.DecimalType):
        try:
            return Decimal(_number(spec, column))
        except InvalidOperation:
            raise Refused(f"{spec.text} isn't a decimal number.") from None
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(_number(spec, column))
    if isinstance(kind, T.BooleanType):
        if spec.text in ("true", "false", "1", "0") and spec.kind != "string":
            return spec.text in ("true", "1")
        raise Refused(f"{column.name} takes true, false, 1 or 0 without quotes.")
    if isinstance(kind, T.DateType):
        return _parsed(spec, column, "a date such as 1970-01-01 (ISO 8601)", lambda s: dt.datetime.fromisoformat(s).date())
    if isinstance(kind, T.TimestampNTZType):
        return _parsed(spec, column, "a time such as 1970-01-01T00:00:00 (ISO 8601)", lambda s: dt.datetime.fromisoformat(s).replace(tzinfo=None))
    if isinstance(kind, T.TimestampType):
        return _parsed(spec, column, "a time such as 1970-01-01T00:00:00+02:00 (ISO 8601)", _zoned)
    null = ' Use "null"' + ("" if column.nullable else ", which needs a column that allows nulls,") + " or empty the table."
    raise Refused(f"{column.name} is of type {kind.simpleString()}, which takes no fixed value.{null}")


def _zoned(text: str) -> dt.datetime:
    when = dt.datetime.fromisoformat(text)
    return when if when.tzinfo else when.replace(tzinfo=dt.UTC)


def _string(spec: StaticSpec, column: ColumnMeta) -> str:
    if spec.kind != "string":
        raise Refused(f'{column.name} takes a string: write "{spec.text}" with quotes.')
    return spec.text


def _number(spec: StaticSpec, column: ColumnMeta) -> str:
    if spec.kind != "number":
        raise Refused(f"{column.name} takes a number: write {spec.text} without quotes.")
    return spec.text


def _integer(spec: StaticSpec, column: ColumnMeta) -> int:
    text = _number(spec, column)
    if not _WHOLE.match(text):
        raise Refused(f"{column.name} takes a whole number, not {text}.")
    bits = _BITS[type(column.data_type)]
    low, high = (0, 255) if column.unsigned else (-(1 << bits - 1), (1 << bits - 1) - 1)
    if not low <= int(text) <= high:
        raise Refused(f"{column.name} takes {low} to {high}, not {text}.")
    return int(text)


def _parsed(spec: StaticSpec, column: ColumnMeta, what: str, parse):
    try:
        return parse(_string(spec, column))
    except Refused:
        raise
    except ValueError:
        raise Refused(f'{column.name} takes {what}, not "{spec.text}".') from None
