"""A mask for one DataFrame from a few rules, for use without a rule file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from . import run_plan
from .masker import TableMask
from .meta import Catalog, table_meta
from .rules import load


class CannotMask(ValueError):
    """What the planner refused."""


def table_plan(df: DataFrame, name: str, key: list[str], columns: dict[str, dict]) -> TableMask:
    """The mask that rules {column: {strategy, value, unique}} make; CannotMask names all refusals."""
    entries = [{"name": c, **r} for c, r in columns.items()]
    rules = load(json.dumps({"tables": [{"name": name, "columns": entries}]}))
    plan = run_plan.build(Catalog("inline", (table_meta(name, df.schema, {"primaryKey": key}),)), rules)
    if plan.problems:
        raise CannotMask("\n".join(map(str, plan.problems)))
    return plan.mask.tables[0]
