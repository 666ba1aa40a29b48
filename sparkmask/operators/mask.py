"""Masking as one lazy projection over a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmask.functions import masking
from sparkmask.functions.identifiers import column
from sparkmask.plans.masker import MaskColumn, TableMask
from sparkmask.plans.meta import TableMeta
from sparkmask.plans.rules import Strategy


@dataclass(frozen=True)
class Context:
    """What a strategy may use beside the old value."""

    mask: MaskColumn
    table: TableMeta  # whose key makes values
    kind: T.DataType

    @property
    def key(self) -> Column:
        keys = self.table.key_columns
        return masking.discriminator([column(k.name) for k in keys], [k.uuid for k in keys])


def _scrambled(old: Column, given: Context) -> Column:
    return masking.scramble_unique(old, given.key) if given.mask.unique else masking.scramble(old)


#: The new value of a column from its old one.  Another function can be put in a strategy's place by `register`.
STRATEGIES: dict[Strategy, Callable[[Column, Context], Column]] = {
    Strategy.NULL: lambda old, given: masking.constant(None, given.kind),
    Strategy.STATIC: lambda old, given: masking.constant(given.mask.value, given.kind),
    Strategy.SCRAMBLE: _scrambled,
    Strategy.EMAIL: lambda old, given: masking.generated_email(given.key),
    Strategy.KEEP: lambda old, given: old,
}


def register(strategy: Strategy, make: Callable[[Column, Context], Column]) -> Callable[[Column, Context], Column]:
    """Has `make` carry out a strategy from now on; gives back what did so before."""
    before, STRATEGIES[strategy] = STRATEGIES[strategy], make
    return before


def expression(mask: MaskColumn, table: TableMeta, kind: T.DataType) -> Column:
    """The new value of a column, of the type it had."""
    return STRATEGIES[mask.strategy](column(mask.column.name), Context(mask, table, kind))


def masked(df: DataFrame, plan: TableMask, key_of: TableMeta | None = None) -> DataFrame:
    """The table with its masked columns replaced and its computed columns built again from what they are made of.

    Only columns that the projection needs are read: an overwritten one never is.  key_of is the table whose key makes
    values, where that is another one, as for a history.
    """
    by = {m.column.name.lower(): m for m in plan.columns}
    out = []
    for f in df.schema.fields:
        m = by.get(f.name.lower())
        out.append(expression(m, key_of or plan.table, f.dataType).alias(f.name, metadata=f.metadata) if m else column(f.name))
    done = df.select(*out)
    computed = {c.name: F.expr(c.computed) for c in plan.table.columns if c.computed is not None and c.name in df.columns}
    return done.withColumns(computed) if computed else done


def emptied(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.where(F.lit(False))


def keyed_update(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of `new` where its key occurs there; keys of `new` must be unique."""
    values = [c for c in new.columns if c not in keys]
    marked = new.select(*map(column, keys), *[column(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_found"))
    joined = df.join(marked, list(keys), "left")
    return joined.select(*[F.when(F.col("_found"), column(f"_new_{c}")).otherwise(column(c)).alias(c) if c in values else column(c) for c in df.columns])
