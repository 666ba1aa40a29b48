"""Reading tables, cutting lineage, and walking Arrow batches in pieces of bounded size."""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmask.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> Iterator[None]:
    """Has Spark hand Python at most so many rows and bytes at once in what is run inside; the settings are put back after."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def cut(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder, whose files Spark removes once nothing refers to it any more."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = shared_folder(spark)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    # Spark asks for this setting when it checkpoints; others' checkpoints are left to theirs
    conf, name = sc._jsc.sc().conf(), "spark.cleaner.referenceTracking.cleanCheckpoints"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        with small_batches(spark):
            return df.checkpoint()
    finally:
        conf.set(name, before)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and bytes (one row at least), so that few texts are Python objects
    at once."""
    for b in batches:
        i = 0
        while i < b.num_rows:
            part = b.slice(i, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, (part.num_rows + 1) // 2)
            yield part
            i += part.num_rows


def dealt_anew(df: DataFrame) -> DataFrame:
    """The same rows without the order of an aggregate or join before.

    A join with an aggregate on its own key would take the aggregate's partitions as they are, and Spark can't split a
    large key then.  After this both sides are shuffled for the join, and it can.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame) -> DataFrame:
    """Columns called c0, c1 and so on, as functions over Arrow batches take no names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def stable_bucket(col, buckets: int):
    """The remainder of crc32 of a key's text."""
    return F.crc32(col.cast("string").cast("binary")) % buckets


def chunks(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose sizes add up to at most `most`; a larger row gets a run of its own."""
    sizes = list(sizes)
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if j > i and total + size > most:
            yield i, j
            i, total = j, 0
        total += size
    if len(sizes) > i:
        yield i, len(sizes)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint when its counted rows are at most `most_rows`; else unchanged, so that joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
