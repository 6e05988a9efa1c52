"""A graph of node and edge tables that streams upsert in transactions: one manifest names the current files of all tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph
from brindle.shared import remove
from brindle.sources import files

#: Folders that a table is dealt to by its key, and manifests that are kept: readers of the last but one still find its files.
PARTS, KEPT = 64, 2
MANIFEST = "table string, part int, folder string"


@dataclass(frozen=True)
class Nodes:
    key: str
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edges:
    """src and dst: the column and the node table that it refers to."""

    src: tuple[str, str]
    dst: tuple[str, str]
    order: tuple[str, ...] = ()


class GraphStore:
    """Tables under a folder; ``commit`` merges a batch of rows into several of them at once, ``read`` gives one as of the last commit.

    A commit writes the parts that it touches under a new version, then a
    manifest of all tables' current parts; the manifest counts once it is whole.
    So a commit that fails anywhere leaves what was there, and one that comes
    again does no harm.  Edges whose ends are no nodes of the version that is
    being written are dropped.  What no kept manifest names is deleted after a
    commit.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, nodes: Mapping[str, Nodes], edges: Mapping[str, Edges], parts: int = PARTS):
        self.spark, self.root, self.nodes, self.edges, self.parts = spark, root.rstrip("/"), dict(nodes), dict(edges), parts

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._manifests(), default=0)

    def _manifests(self) -> list[int]:
        return [int(n) for n in files.tables(self.spark, f"{self.root}/manifest") if files.there(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]

    def _folders(self, number: int) -> dict[tuple[str, int], str]:
        """The folder of each part of each table: parts x tables rows."""
        return {(r["table"], r["part"]): r["folder"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{number}").collect()} if number else {}

    def _open(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a commit, the last if None; None if it has no rows yet."""
        now = self._folders(self.version() if version is None else version)
        mine = [f for (t, _), f in sorted(now.items()) if t == table]
        return self._open(mine) if mine else None

    def _dealt(self, df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(self.parts)).cast("int"))

    def _merged(self, table: str, new: DataFrame, key: tuple[str, ...], order: tuple[str, ...], now: dict, version: str) -> None:
        """Writes the touched parts of a table, old rows and new, and names them in ``now``."""
        last = self._dealt(graph.last_wins(new, list(key), list(order)) if order else new.dropDuplicates(list(key)), *key).persist()
        try:
            touched = [r[0] for r in last.select("__part").distinct().collect()]
            old = [now[table, p] for p in touched if (table, p) in now]
            merged = last
            if old:
                packed = lambda df: df.withColumn("__key", F.struct(*key))
                kept = graph.upsert_nodes(packed(self._open(old).drop("__part")), packed(last.drop("__part")), "__key")
                columns = dict.fromkeys(c for c in [*last.columns, *kept.columns] if c not in ("__part", "__key"))
                merged = self._dealt(kept.withColumns({k: F.col(f"__key.{k}") for k in key}).select(*columns), *key)
            if touched:
                merged.write.partitionBy("__part").parquet(f"{self.root}/{version}/{table}")
                now |= {(table, p): f"{version}/{table}/__part={p}" for p in touched}
        finally:
            last.unpersist()

    def _known(self, table: str, asked: DataFrame, column: str, now: dict) -> DataFrame:
        """The rows whose column is a key of a node table, of which only the parts that they touch are read."""
        key = self.nodes[table].key
        parts = [r[0] for r in self._dealt(asked.select(F.col(column).alias(key)), key).select("__part").distinct().collect()]
        there = [now[table, p] for p in parts if (table, p) in now]
        return asked.join(self._open(there).select(F.col(key).alias(column)), column, "left_semi").select(*asked.columns) if there else asked.where("false")

    def commit(self, batch: Mapping[str, DataFrame]) -> int:
        """Merges the rows of each table of the batch, of one key the last by order; the number of the commit, or of the last if there was nothing to do."""
        number = self.version()
        now, version = self._folders(number), f"data/v{number + 1}-{uuid.uuid4().hex[:8]}"
        before = dict(now)
        for table in self.nodes:
            if table in batch:
                self._merged(table, batch[table], (self.nodes[table].key,), self.nodes[table].order, now, version)
        for table, kind in self.edges.items():
            if table in batch:
                ends = reduce(lambda df, end: self._known(end[1], df, end[0], now), (kind.src, kind.dst), batch[table])
                self._merged(table, ends, (kind.src[0], kind.dst[0]), kind.order, now, version)
        if now == before:
            return number
        rows = [(t, p, f) for (t, p), f in sorted(now.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{number + 1}")
        self.reclaim()
        return number + 1

    def reclaim(self) -> None:
        """Deletes manifests but for the last ones, and folders that none of these names; a commit that was broken off leaves its files until the next."""
        done = sorted(self._manifests())
        kept = done[-KEPT:]
        named = {f for n in kept for f in self._folders(n).values()}
        gone = [f"{self.root}/manifest/{n}" for n in files.tables(self.spark, f"{self.root}/manifest") if int(n) not in kept]
        for version in files.tables(self.spark, f"{self.root}/data"):
            at = f"data/{version}"
            mine = {f"{at}/{t}/{p}" for t in files.tables(self.spark, f"{self.root}/{at}") for p in files.tables(self.spark, f"{self.root}/{at}/{t}")}
            gone += [f"{self.root}/{f}" for f in mine - named] if mine & named else [f"{self.root}/{at}"]
        remove(self.spark, *gone)

    def upserting(self, split: Callable[[DataFrame], Mapping[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that commits each batch; split: a batch's rows by table."""

        def merge(batch: DataFrame, batch_id: int) -> None:
            held = batch.persist()
            try:
                self.commit(split(held))
            finally:
                held.unpersist()

        return merge
