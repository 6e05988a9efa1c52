"""Tables in the folder that driver and executors share, where lineage is cut, and this package for the executors' workers."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where none is set and the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Kept:
    """Tables written for the length of a computation; all but those asked for go when it ends, those at the end of the process."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, what: str, stays: bool = False) -> DataFrame:
        path = f"{base_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        (_LEFT.append((self.spark, path)) if stays else self.paths.append(path))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, but: int, spared: int = 0) -> None:
        """Removes the tables before the last so many, but for the first ones spared."""
        if len(self.paths) > spared + but:
            gone = self.paths[spared:-but]
            self.paths = self.paths[:spared] + self.paths[-but:]
            remove(self.spark, *gone)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, *self.paths)


@atexit.register
def _remove_left() -> None:
    for spark, path in _LEFT:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may be gone, and the folder with it
            return


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to the executors' Python workers once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        files = sorted(top.rglob("*.py"))
        digest = hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
        archive = Path(tempfile.mkdtemp(prefix="brindle-")) / f"brindle-{digest}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return spark
