"""A vector index: blocks of the cells of a similarity join, one folder for each cell, so that a search reads few of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import similarity
from brindle.shared import Kept, shipped

#: Neighbours and the recall that the measured number of probes finds of them; queries that it is measured on, at most.
NEIGHBOURS, RECALL, ASKED = 10, 0.9, 200


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def build(vectors: DataFrame, key: str, column: str, path: str, *, cells: int | None = None, measure: bool = True) -> bool:
    """Writes an index of all vectors; False, and nothing is done, if one is there.

    Centres are drawn from all vectors, at most 4096; every vector is indexed,
    but for those that ``similarity.usable`` leaves out.  measure: some vectors,
    200 at most, are looked up exactly and with 1, 2, 4... probes, and the first
    number that finds nine tenths of their ten nearest is kept as the default.
    """
    spark = shipped(vectors.sparkSession)
    if exists(spark, path):
        return False
    one = vectors.where(F.size(column) > 0).select(F.size(column).alias("n")).first()
    rows = similarity.vectors_of(vectors, key, column, one["n"]) if one else None
    n = rows.count() if one else 0
    if n == 0:
        raise ValueError("no vectors to index")
    dim, kind = one["n"], dict(rows.dtypes)["id"]
    with Kept(spark) as kept:
        centres = similarity.centres_of(rows, n, cells, dim)
        spread = kept.table(similarity.dealt(rows, centres, dim, kind, None), "dealt")
        known = similarity.cells_of(spread, centres)
        similarity.blocks_of(spread, known, dim, kind, None).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        probes = _measured(spark, path, rows, n, known, dim, kind) if measure else similarity.FIRST
    table = [(c, [float(x) for x in known.centres[c]], float(known.radii[c]), int(known.sizes[c]), probes) for c in range(len(known.centres))]
    spark.createDataFrame(table, "cell int, centre array<double>, radius double, n bigint, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return True


def _measured(spark: SparkSession, path: str, rows: DataFrame, n: int, known: similarity.Cells, dim: int, kind: str) -> int:
    """The fewest probes, doubling, with the recall wanted."""
    there, part = int((known.sizes > 0).sum()), min(1.0, ASKED / n)
    asked = rows.where(F.pmod(F.xxhash64("vector", F.lit("asked")), F.lit(1 << 30)) < part * (1 << 30)).orderBy(F.xxhash64("vector"), "id").limit(ASKED)
    blocks = spark.read.parquet(f"{path}/blocks")
    probes = 1
    with Kept(spark) as kept:
        asked = kept.table(asked, "asked")
        look = lambda **how: {(r["query"], r["entity"]) for r in similarity.matched(asked, blocks, known, dim, (kind, kind), NEIGHBOURS, least=None, apart=False, kept=kept, **how).collect()}
        truth = look(first=similarity.FIRST, exact=True)
        while probes < there and len(truth & look(first=probes, exact=False)) < RECALL * len(truth):
            probes *= 2
    return min(probes, there)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, similarity.Cells, int, str]:
    told = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    known = similarity.Cells(*(np.array([r[c] for r in told]) for c in ("centre", "radius", "n")))
    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks, known, told[0]["probes"], blocks.schema["ids"].dataType.elementType.simpleString()


def search(spark: SparkSession, path: str, key: str, query: Sequence[float], k: int, *, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(key, score): the k nearest of the vectors in the ``probes`` nearest cells, as measured if None; exact: of all.  Only folders of cells that are met are read."""
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "q bigint, v array<double>")
    found = search_all(spark, path, asked, "q", "v", k, probes=probes, exact=exact)
    return found.select(F.col("entity").alias(key), "score").orderBy(F.desc("score"), key)


def search_all(spark: SparkSession, path: str, queries: DataFrame, key: str, column: str, k: int, *, probes: int | None = None, exact: bool = False, apart: bool = False) -> DataFrame:
    """(query, entity, score, rank) of many queries, of different keys; see ``search``."""
    blocks, known, default, kind = _opened(shipped(spark), path)
    dim = known.centres.shape[1]
    asked = similarity.vectors_of(queries, key, column, dim)
    with Kept(spark) as kept:
        first = similarity.FIRST if exact else probes or default
        return similarity.matched(asked, blocks, known, dim, (dict(queries.dtypes)[key], kind), k, least=None, apart=apart, first=first, exact=exact, kept=kept)
