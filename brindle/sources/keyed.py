"""Tables dealt into buckets by key and sorted by it, for lookups of a key and for merges that leave the old rows where they are."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph
from brindle.shared import remove
from brindle.sources import files

BUCKETS = 64


class NotUnique(ValueError):
    """A write was stopped: some keys occur more than once, or are null."""


def check_unique(df: DataFrame, key: str, shown: int = 5) -> None:
    """Raises ``NotUnique`` with some of the keys that are null or occur more than once."""
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).orderBy(key).limit(shown).collect()
    if bad:
        raise NotUnique(f"{key}: " + ", ".join(f"{r[key]} ({r['count']} rows)" for r in bad))


class KeyedTable:
    """A table of one row a key under a folder, each version in a folder of its own.

    Rows are dealt by Spark's own hash of the key into buckets, a file each,
    sorted by the key, with a Bloom filter on it.  So ``lookup`` opens the file of
    its bucket alone, joins on the key don't shuffle this side, and ``merge``
    moves only the new rows.  A version counts once its marker is written; the one
    before stays for those who read it.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def versions(self) -> list[int]:
        """Numbers of the versions that are whole."""
        return sorted(int(v[1:]) for v in files.tables(self.spark, self.root) if files.there(self.spark, f"{self.root}/{v}/_SUCCESS"))

    def _named(self, version: int, schema: str | None = None) -> str:
        """A name for a version's files in the session's catalog, which tells Spark their buckets."""
        name = f"keyed_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.root}/v{version}').hex}"
        if not self.spark.catalog.tableExists(name):
            path = f"{self.root}/v{version}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def read(self) -> DataFrame:
        """The rows of the last version."""
        done = self.versions()
        if not done:
            raise FileNotFoundError(f"{self.root} holds no version")
        return self.spark.table(self._named(done[-1]))

    def lookup(self, keys: Sequence[object]) -> DataFrame:
        """The rows of some keys: files of other buckets aren't opened."""
        return self.read().where(F.col(self.key).isin(*keys))

    def write(self, df: DataFrame, checked: bool = True) -> int:
        """A new version of these rows alone; its number.  checked: keys that repeat stop it before anything is written."""
        if checked:
            check_unique(df, self.key)
        return self._written(df.repartition(self.buckets, self.key))

    def merge(self, new: DataFrame, order: Sequence[str] = ()) -> int:
        """A new version with the rows of new set by key, of one key the last by order; without an order, keys of new that repeat stop it.

        The old rows are read bucket by bucket where they lie; only new is dealt.
        """
        if not order:
            check_unique(new, self.key)
        merged = graph.upsert_nodes(self.read(), new, self.key, order)
        return self._written(merged)

    def plan(self, new: DataFrame) -> DataFrame:
        """What ``merge`` would write, to look at."""
        return graph.upsert_nodes(self.read(), new, self.key)

    def _written(self, df: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        path, name = f"{self.root}/v{version}", f"keyed_{uuid.uuid4().hex}"
        remove(self.spark, path)  # of a write that was broken off
        writer = df.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table's files stay
        old = self.versions()[:-2]
        remove(self.spark, *(f"{self.root}/v{v}" for v in old))
        return version
