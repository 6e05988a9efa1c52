"""Readers and writers of review, catalog and aspect files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "__bad_line"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines under a schema; a bad line fails the query, an empty input at once, as does a required column that the schema lacks."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): bad lines are kept apart, to be counted or looked at."""
    full = T.StructType.fromDDL(schema).add(BAD, "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return df.where(F.col(BAD).isNull()).drop(BAD), df.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def load_report(good: DataFrame, bad: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a value under the first of the keys that the table has, counts): counts is one row of rows kept, rows without a key, and bad lines."""
    there = [k for k in keys if k in good.columns]
    if not there:
        raise ValueError(f"none of {', '.join(keys)} is a column")
    has = F.coalesce(F.col(there[0]).cast("string") != "", F.lit(False))
    counts = good.agg(F.count_if(has).alias("kept"), F.count_if(~has).alias("without_key")).join(bad.agg(F.count("*").alias("bad")))
    return good.where(has), counts


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, n): lines with their number from 0, files by name, lines as they stand in them.

    A pass counts the lines of each split of a file; sums over the splits before,
    a row each, and a line's row within its split give its number.  No line moves.
    """
    split = F.struct("_metadata.file_path", "_metadata.file_block_start")
    # The id counts rows within the task; the least of a split is where it starts there.
    lines = spark.read.text(path).select("value", split.alias("split"), F.monotonically_increasing_id().alias("row"))
    sizes = lines.groupBy("split").agg(F.count("*").alias("lines"), F.min("row").alias("first"))
    before = sizes.select("split", "first", (F.sum("lines").over(Window.orderBy("split")) - F.col("lines")).alias("before"))
    return lines.join(F.broadcast(before), "split").select("value", (F.col("before") + F.col("row") - F.col("first")).alias("n"))  # a row for each split of the input


def first_lines(spark: SparkSession, path: str, fraction: float) -> DataFrame:
    """The first part of the lines by count: files by name, lines as they stand in them; each is kept or left out where it lies."""
    return numbered_lines(spark, path).where(F.col("n") < int(line_count(spark, path) * fraction)).select("value")


class Scan:
    """Rows of JSON lines whose counts are taken while they are read: rows kept, rows without a key, and bad lines, by ``counts`` after an action over all of ``rows``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        full = T.StructType.fromDDL(schema).add(BAD, "string")
        there = [k for k in keys if k in full.fieldNames()]
        if not there:
            raise ValueError(f"none of {', '.join(keys)} is a column")
        lines = spark.read.text(path).where(F.trim("value") != "")
        df = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
        bad, has = F.col(BAD).isNotNull(), F.coalesce(F.col(there[0]).cast("string") != "", F.lit(False))
        self._seen = Observation()
        seen = df.observe(self._seen, F.count_if(~bad & has).alias("kept"), F.count_if(~bad & ~has).alias("without_key"), F.count_if(bad).alias("bad"))
        self.rows = seen.where(~bad & has).drop(BAD)

    def counts(self) -> dict[str, int]:
        """Waits for the first action over the rows; no read of its own."""
        return {k: int(v) for k, v in self._seen.get.items()}


def read_csv(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A CSV file; rows: so many of them at most."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df if rows is None else df.limit(rows)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Names of the processed outputs, and the columns of the last.
OUTPUTS = ("processed_metadata", "processed_reviews", "combined_product_data", "recommender_data")
RECOMMENDER = ("asin", "title", "main_category", "average_rating", "combined_text")


def write_outputs(metadata: DataFrame, reviews: DataFrame, combined: DataFrame, root: str) -> None:
    """The four processed outputs as CSV, one folder each."""
    for name, df in zip(OUTPUTS, (metadata, reviews, combined, combined.select(*(c for c in RECOMMENDER if c in combined.columns))), strict=True):
        write_csv(df, f"{root}/{name}")


def read_outputs(spark: SparkSession, root: str, schemas: dict[str, str], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The processed tables: metadata and reviews must be there; the combination is computed anew where it isn't."""
    missing = [n for n in OUTPUTS[:2] if not there(spark, f"{root}/{n}")]
    if missing:
        raise FileNotFoundError(f"{root}: {', '.join(missing)}")
    out = {n: read_csv(spark, f"{root}/{n}", schemas[n]) for n in OUTPUTS[:2]}
    name = OUTPUTS[2]
    out[name] = read_csv(spark, f"{root}/{name}", schemas[name]) if there(spark, f"{root}/{name}") else combine(out[OUTPUTS[0]], out[OUTPUTS[1]])
    return out


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer: one term a line, trimmed, distinct, sorted."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct().orderBy("term")


def statements(text: str) -> list[str]:
    """The statements of a script: comment lines and blank ones are left out, a semicolon ends a statement."""
    kept = [x.strip() for x in text.splitlines()]
    joined = "\n".join(x for x in kept if x and not x.startswith("//"))
    return [s.strip() for s in joined.split(";") if s.strip()]


def string_lists(column: str) -> Column:
    """Lists of lists from a column that may hold JSON of either depth, or a bare text."""
    c = F.col(column)
    nested, flat = F.from_json(c, "array<array<string>>"), F.from_json(c, "array<string>")
    is_nested = c.rlike(r"^\s*\[\s*\[")
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<array<string>>")).when(is_nested, nested).when(c.rlike(r"^\s*\["), F.array(flat)).otherwise(F.array(F.array(c)))


def store(tables: dict[str, DataFrame], root: str, dry_run: bool = False) -> None:
    """Node and edge tables as Parquet, one folder each; nothing is run if dry_run."""
    if not dry_run:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the stored tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in where.listStatus(at) if f.isDirectory()) if where.exists(at) else []


def registered(spark: SparkSession, root: str) -> list[str]:
    """All stored tables as views, for SQL."""
    names = tables(spark, root)
    for name in names:
        load(spark, root, name).createOrReplaceTempView(name)
    return names


def clear(spark: SparkSession, root: str) -> None:
    """Deletes the stored tables and their views."""
    for name in tables(spark, root):
        spark.catalog.dropTempView(name)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dump(spark: SparkSession, root: str, target: str) -> list[str]:
    """Copies all stored tables to another folder, by Spark; restoring is the same the other way round."""
    names = tables(spark, root)
    store({name: load(spark, root, name) for name in names}, target)
    return names
