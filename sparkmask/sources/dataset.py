"""A dataset is a folder of tables, one folder or file a table; writes go to a staging folder first.

    root/schema.table.parquet      a table
    root/schema.table.parquet/_change_data, root/_change_feed
                                   old versions of rows, of one table or of all; a run drops them
    root/_facts.json               keys, unique rules, histories (see plans.meta), tables of databases
    root/_stamp.json               written last, after the sweep passed
    root/_audit/                   a row for each run
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkmask.plans.meta import Catalog, build_catalog

FACTS, STAMP, AUDIT = "_facts.json", "_stamp.json", "_audit"
FEED, TABLE_FEED = "_change_feed", "_change_data"


class Folder:
    """Files through Hadoop's FileSystem, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self.path().getFileSystem(self._conf)

    def names(self) -> list[str]:
        if not self._fs().exists(self.path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self.path()))

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self.path(name))

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs().open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8-sig")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._fs().create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        if not self._fs().delete(self.path(name), True) and self.exists(name):
            raise OSError(f"{self.path(name)} can't be deleted")

    def make(self) -> None:
        self._fs().mkdirs(self.path())

    def move(self, name: str, to: Folder, as_name: str) -> None:
        if not self._fs().rename(self.path(name), to.path(as_name)):
            raise OSError(f"{self.root}/{name} can't be moved to {to.root}/{as_name}")


class Dataset:
    """Tables of a folder; those that the facts give a `jdbc` entry are read from a database and published as files."""

    def __init__(self, spark: SparkSession, root: str, default_schema: str = "main"):
        self.spark, self.folder, self.default_schema = spark, Folder(spark, root), default_schema
        self.files = {}
        for name in self.folder.names():
            if name.endswith(".parquet") and not name.startswith(("_", ".")):
                bare = name.removesuffix(".parquet")
                self.files[bare if "." in bare else f"{default_schema}.{bare}"] = name
        facts = json.loads(self.folder.read_text(FACTS) or "{}")
        here = {n.lower() for n in self.files}
        self.jdbc = {n: f["jdbc"] for n, f in facts.get("tables", {}).items() if "jdbc" in f and n.lower() not in here}
        self.files |= {n: f"{n}.parquet" for n in self.jdbc}

    @property
    def name(self) -> str:
        return self.folder.root.rsplit("/", 1)[-1]

    def table(self, name: str) -> DataFrame:
        found = next(n for n in self.files if n.lower() == name.lower())
        if found in self.jdbc:
            given = dict(self.jdbc[found])
            return jdbc_table(self.spark, given.pop("url"), given.pop("table", found), given.pop("key", None), given.pop("bounds", None), given.pop("partitions", 64), **given)
        return self.spark.read.parquet(f"{self.folder.root}/{self.files[found]}")

    def feeds(self) -> list[str]:
        """Folders under the root that keep old versions of rows."""
        inside = [f"{f}/{TABLE_FEED}" for n, f in self.files.items() if n not in self.jdbc and self.folder.exists(f"{f}/{TABLE_FEED}")]
        return [FEED] * self.folder.exists(FEED) + inside

    def catalog(self) -> Catalog:
        return build_catalog(self.name, {n: self.table(n).schema for n in self.files}, self.folder.read_text(FACTS))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: Sequence[int] | None = None, partitions: int = 64, **options) -> DataFrame:
    """A table of a database, read in ranges of an integer key where its bounds are given.  The driver must be installed."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
