"""Shared scratch tables: where lineage is cut and files are exchanged.

Everything lies under ``spark.checkpoint.dir`` (or, where that is unset and the
master is local as in tests, under a temporary folder), so a lost executor costs
the recomputation of its tasks and never a table.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; a temporary one only where none is configured and driver and executors are one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{base_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_left() -> None:
    for spark, path in _LEFT:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session may be gone, and the folder with it
            return


def save(df: DataFrame, what: str = "table", by: list[str] | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage is cut.

    ``saved_path(df)`` gives the place, for ``drop``.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def sendable(saved: DataFrame, most: int = 8 << 20) -> bool:
    """Whether a saved table may be broadcast: its files, compressed, have so many bytes at most, about a tenth of what an executor then holds."""
    spark = saved.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(saved_path(saved))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() <= most


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def saved_path(df: DataFrame) -> str:
    return df._brindle_path


def release() -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        files = sorted(top.rglob("*.py"))
        digest = hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
        archive = Path(tempfile.mkdtemp(prefix="brindle-")) / f"brindle-{digest}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return spark
