"""Pages and ranges by key order, and reconciliation of two versions of a table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column


def after(keys: Sequence[str], values: Sequence) -> Column:
    """Whether a row's key comes after the given one, comparing column by column.

    The bound on the first column follows from the rest, and stores can skip what it rules out.
    """
    whole = F.struct(*map(column, keys)) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)])
    return _bound(keys, values, whole, lambda k, v: k >= v, lambda k, v: k > v)


def upto(keys: Sequence[str], values: Sequence) -> Column:
    """Whether a row's key is the given one or comes before it; nulls come first."""
    whole = F.struct(*map(column, keys)) <= F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)])
    before = lambda k, v: k.isNull() | (k <= v)
    return _bound(keys, values, whole, before, before)


def _bound(keys: Sequence[str], values: Sequence, whole: Column, some, all_) -> Column:
    """With one key column its bound alone, else also the first column's; a null bound has none that stores could use."""
    if values[0] is None:
        return whole
    first = column(keys[0])
    return all_(first, F.lit(values[0])) if len(keys) == 1 else some(first, F.lit(values[0])) & whole


def between(keys: Sequence[str], low: Sequence, high: Sequence) -> Column:
    """After `low` and not after `high`."""
    return after(keys, low) & upto(keys, high)


def page(df: DataFrame, keys: Sequence[str], size: int, last: Sequence | None = None) -> DataFrame:
    """The `size` rows that follow `last` in key order; the first ones without it."""
    rest = df if last is None else df.where(after(keys, last))
    return rest.orderBy(*keys).limit(size)


def reconcile(before: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: counts of both, keys missing from either, and whether all agree."""
    old, new = before.select(*keys), now.select(*keys)
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    each = both.groupBy(*keys).agg(F.sum("_old").alias("old"), F.count_if(F.col("_old") == 0).alias("new"))
    sums = each.agg(
        F.coalesce(F.sum("old"), F.lit(0)).cast("long").alias("rows_before"),
        F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("rows_after"),
        F.coalesce(F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0))), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0))), F.lit(0)).cast("long").alias("added"),
    )
    return sums.withColumn("complete", (F.col("missing") == 0) & (F.col("added") == 0))


def key_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows with a null in the key, and whether the columns can be a key."""
    each = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    sums = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
    )
    return sums.withColumn("is_key", (F.col("rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0))
