"""The same masks over streams: a stateless projection, a gate for each micro-batch, and hits by time window."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmask.functions import patterns
from sparkmask.operators import sweep
from sparkmask.operators.mask import masked
from sparkmask.plans.masker import TableMask


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def mask_stream(df: DataFrame, plan: TableMask) -> DataFrame:
    """Row by row and without state, so that the plan of a batch holds as it is."""
    return masked(df, plan)


class GateFailed(ValueError):
    """A micro-batch still holds what looks personal."""


def gate(write: Callable[[DataFrame, int], None], known: Iterable[str] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sweeps a micro-batch and writes it only if nothing was found."""
    known = list(known)

    def check(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            found = [(r["column"], r["pattern"], r["hits"]) for r in sweep.counts(df, known).where("hits > 0").collect()]
            if found:
                raise GateFailed(f"batch {epoch}: " + ", ".join(f"{n} x {p} in {c}" for c, p, n in sorted(found)))
            write(df, epoch)
        finally:
            df.unpersist()

    return check


def hit_rate(df: DataFrame, time_col: str, text_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, pattern, hits, rows) by tumbling windows; rows later than `late` are dropped by the watermark."""
    timed = df.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    tests = [F.count_if(patterns.leaks(F.col(text_col), p)).alias(p) for p in patterns.PATTERNS]
    sums = timed.groupBy(F.window("_t", window)).agg(*tests, F.count("*").alias("rows"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"`{p}`").alias("hits")) for p in patterns.PATTERNS]))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), each.alias("e"), "rows").select("start", "end", "e.*", "rows")
