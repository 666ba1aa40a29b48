"""The sweep: every string column against every shape, in one scan of each table and one aggregate."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmask.functions import patterns
from sparkmask.functions.identifiers import column, quoted


def string_columns(df: DataFrame) -> list[tuple[str, Column]]:
    """(path, text) of each string column, those inside structs included; padded ones lose their padding."""
    found: list[tuple[str, Column]] = []

    def walk(path: tuple[str, ...], kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk((*path, f.name), f.dataType)
        elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            col = F.col(".".join(map(quoted, path)))
            found.append((".".join(path), F.rtrim(col) if isinstance(kind, T.CharType) else col))

    for f in df.schema.fields:
        # Spark reads CHAR and VARCHAR as strings and keeps the declared kind in the metadata
        declared = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
        if declared.startswith("char("):
            found.append((f.name, F.rtrim(column(f.name))))
        else:
            walk((f.name,), f.dataType)
    return found


_SCHEMA = "table string, column string, pattern string, hits long, inspected long"


def _marks(text: Column, known: list[str]) -> Column:
    """A bit for each shape that a value leaks, and one more as the value was looked at."""
    looked, bits = F.lit(1 << len(patterns.PATTERNS)), F.col("bits")
    return F.when((bits == 0) | patterns.is_masked(text, known), looked).otherwise(bits.bitwiseOR(looked))


def _counted(tables: Mapping[str, DataFrame], known: Iterable[str], compatible: bool) -> DataFrame | None:
    """The counts of all tables.  Their texts run through the same few expressions, numbered by column, so that plans
    and generated code don't grow with the number of columns; only what holds a shape reaches the one aggregate."""
    texts, names = None, []
    for name, df in tables.items():
        columns = string_columns(df)
        if columns:
            each = F.array(*[F.struct(F.lit(len(names) + i).alias("id"), text.alias("text")) for i, (_, text) in enumerate(columns)])
            part = df.select(F.inline(each))
            texts = part if texts is None else texts.union(part)
            names += [(name, c) for c, _ in columns]
    if texts is None:
        return None
    n, text = len(patterns.PATTERNS), F.col("text")
    bits = F.lit(0)
    for k, p in enumerate(patterns.PATTERNS):
        bits = bits.bitwiseOR(F.when(patterns.matches(text, p), 1 << k).otherwise(0))
    # whether a value is masked output is asked only once it passes here, which hardly any does
    asked = patterns.prefilter(text) if compatible else F.col("bits") != 0
    marks = texts.withColumn("bits", bits).where(asked).select("id", _marks(text, list(known)).alias("marks"))
    zeros = texts.sparkSession.range(0, len(names), 1, 1).select(F.col("id").cast("int"), F.lit(0).alias("marks"))
    bit = lambda k: F.count_if(F.col("marks").bitwiseAND(F.lit(1 << k)) != 0)
    rows = marks.union(zeros).groupBy("id").agg(F.array(*map(bit, range(n))).alias("hits"), bit(n).alias("inspected"))
    called = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in names])[F.col("id")]
    shapes = F.array(*[F.lit(p) for p in patterns.PATTERNS])
    rows = rows.select(called.alias("name"), "inspected", F.inline(F.arrays_zip(shapes.alias("pattern"), F.col("hits").alias("hits"))))
    return rows.select("name.table", "name.column", "pattern", F.col("hits").cast("long"), F.col("inspected").cast("long"))


def sweep(tables: Mapping[str, DataFrame], known: Iterable[str] = (), compatible: bool = False) -> DataFrame:
    """(table, column, pattern, hits, inspected): one row for each string column and shape, zeros included.

    hits counts values that hold the shape and aren't masked output; a value counts once for each shape.  inspected
    counts values of the column that hold any shape, excused ones included.  Each table is scanned once.
    """
    if not tables:
        raise ValueError("no table to sweep")
    found = _counted(tables, known, compatible)
    return next(iter(tables.values())).sparkSession.createDataFrame([], _SCHEMA) if found is None else found


def counts(df: DataFrame, known: Iterable[str] = (), compatible: bool = False) -> DataFrame:
    """(column, pattern, hits, inspected) of one table, as in `sweep`."""
    return sweep({"": df}, known, compatible).drop("table")


def totals(swept: DataFrame) -> DataFrame:
    """One row: columns scanned, values inspected, hits, and whether nothing was found."""
    each = swept.groupBy("table", "column").agg(F.max("inspected").alias("inspected"), F.sum("hits").alias("hits"))
    return each.agg(
        F.count("*").alias("columns_scanned"),
        F.coalesce(F.sum("inspected"), F.lit(0)).cast("long").alias("rows_inspected"),
        F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits"),
        (F.coalesce(F.sum("hits"), F.lit(0)) == 0).alias("passed"),
    )
