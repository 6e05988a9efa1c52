"""Queries that go through files, stored tables and streams: what they write is made from the driver's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import models
from brindle.functions import scalars as fn
from brindle.operators import clean, preferences, records, state
from brindle.plans.catalog import attributes, brands, mentions, query, table
from brindle.shared import Kept, base_dir, remove
from brindle.sources import files
from brindle.sources.keyed import KeyedTable
from brindle.streaming import state as streams
from brindle.streaming.graph_store import Edges, GraphStore, Nodes


class Folder:
    """A folder for a query's files, gone when its result, written as a table, stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{base_dir(spark)}/query-{uuid.uuid4().hex}"

    def __enter__(self) -> Folder:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)

    def told(self, df: DataFrame) -> DataFrame:
        return Kept(self.spark).table(df, "told", stays=True)


# --- files -----------------------------------------------------------------------------


@query("SELECT p_partkey AS asin, p_name AS title, p_type || '|' || p_brand AS path, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM part")
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as JSON lines and back, with lists and missing values."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("path"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    with Folder(spark) as f:
        files.write_jsonl(part, f"{f.path}/part")
        back = files.read_jsonl(spark, f"{f.path}/part", "asin bigint, title string, path array<string>, price double", ["asin"])
        return f.told(back.withColumn("path", F.array_join("path", "|")))


@query("SELECT count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) AS kept, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 = 0) AS without_key, count(*) FILTER (p_partkey % 7 = 0) AS bad, CAST(sum(p_size) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) AS BIGINT) AS sizes FROM part")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are broken and some lack the key: counted while they are read."""
    good = F.to_json(F.struct(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("k"), F.col("p_partkey").cast("string"))).alias("asin"), F.col("p_size").alias("size")))
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 != 0, good).otherwise(F.concat(F.lit("{broken "), "p_name")).alias("value"))
    with Folder(spark) as f:
        lines.write.text(f"{f.path}/lines")
        scan = files.Scan(spark, f"{f.path}/lines", "asin string, size int", ["asin"])
        total = scan.rows.agg(F.sum("size").alias("sizes")).first()["sizes"]
        return spark.createDataFrame([scan.counts() | {"sizes": total}], "kept bigint, without_key bigint, bad bigint, sizes bigint")


@query("SELECT event_id, event_type, value, props FROM events WHERE event_id % 2 = 0")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV in two appends and read back: quotes and commas in them stay."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").where("event_id % 2 = 0")
    with Folder(spark) as f:
        files.write_csv(rows.where("event_id % 4 = 0"), f"{f.path}/csv")
        files.write_csv(rows.where("event_id % 4 = 2"), f"{f.path}/csv", append=True)
        return f.told(files.read_csv(spark, f"{f.path}/csv", "event_id bigint, event_type string, value double, props string"))


@query("SELECT CAST(n AS BIGINT) AS n, line FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS n, count(*) OVER () AS total, l_orderkey || ' ' || l_linenumber AS line FROM lineitem) WHERE n < floor(total * 0.3)")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three tenths of the lines of many files, with their numbers."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").repartitionByRange(8, *order).sortWithinPartitions(*order).select(F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value"))
    with Folder(spark) as f:
        lines.write.text(f"{f.path}/lines")
        total = files.line_count(spark, f"{f.path}/lines")
        return f.told(files.numbered_lines(spark, f"{f.path}/lines").where(F.col("n") < int(total * 0.3)).select("n", F.col("value").alias("line")))


@query("SELECT DISTINCT trim(p_name) AS term FROM part WHERE trim(p_name) <> ''")
def gazetteer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer file with blanks and repeats."""
    with Folder(spark) as f:
        table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value")).write.text(f"{f.path}/terms")
        return f.told(files.read_terms(spark, f"{f.path}/terms"))


# --- stored tables ---------------------------------------------------------------------


@query("SELECT p_partkey AS asin, CASE WHEN p_size > 10 THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_name AS title FROM part")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in a keyed table, some with a new price merged in."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("title"), "p_size")
    with Folder(spark) as f:
        keyed = KeyedTable(spark, f"{f.path}/parts", "asin", 8)
        keyed.write(part.drop("p_size"))
        keyed.merge(part.where("p_size > 10").select("asin", (F.col("price") + 1).alias("price")))
        return f.told(keyed.read())


@query("WITH {REV}, k AS (SELECT user_id, asin, rating FROM rev WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND asin IN (SELECT p_partkey FROM part WHERE p_size > 5) QUALIFY row_number() OVER (PARTITION BY user_id, asin ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1) SELECT * FROM k")
def graph_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, products and ratings in two commits of a graph: ratings whose customer comes with the second commit find it there."""
    from brindle.plans.catalog import reviews

    order = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    rated = reviews(spark, sf_dir).select("user_id", "asin", "rating", *order)
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    items = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"))
    with Folder(spark) as f:
        store = GraphStore(spark, f"{f.path}/graph", {"user": Nodes("user_id"), "item": Nodes("asin")}, {"rated": Edges(("user_id", "user"), ("asin", "item"), order)}, 4)
        # Of an edge the last row by order is in one of the commits; those of the first that the second repeats come again there.
        half = F.col("user_id") % 2 == 0
        store.commit({"user": users.where(half), "item": items, "rated": rated.where(half)})
        store.commit({"user": users.where(~half), "rated": rated})
        return f.told(store.read("rated").select("user_id", "asin", "rating"))


@query("SELECT p_partkey AS asin, p_brand AS name FROM part UNION ALL SELECT c_custkey, c_name FROM customer")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables stored, dumped to another folder and read from there by their names."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asin"), F.col("c_name").alias("name"))
    with Folder(spark) as f:
        files.store({"brand": brands(spark, sf_dir), "customer": customers}, f"{f.path}/a")
        names = files.dump(spark, f"{f.path}/a", f"{f.path}/b")
        return f.told(files.load(spark, f"{f.path}/b", names[0]).unionByName(files.load(spark, f"{f.path}/b", names[1])))


# --- streams -----------------------------------------------------------------------------


def _last_told(spark: SparkSession, f: Folder, batches: DataFrame, part: str, made) -> DataFrame:
    """Every row that a stream tells over the rows of a table, which come in files by a column, with the number of the batch."""
    batches.repartition(part).write.partitionBy(part).parquet(f"{f.path}/in")
    stream = spark.readStream.schema(batches.schema).option("maxFilesPerTrigger", 2).parquet(f"{f.path}/in").drop(part)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{f.path}/out")
    made(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{f.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{f.path}/out")


@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id DESC)[1:5], ',') AS history FROM events GROUP BY user_id")
def stream_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user, by a stream over several batches with keyed state."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 6).alias("part"))
    with Folder(spark) as f:
        told = _last_told(spark, f, events, "part", lambda s: streams.bounded_history(s, "user_id", "event_id", "event_id", 5))
        last = told.groupBy("user_id").agg(F.max_by("history", "batch").alias("history"))
        return f.told(last.select("user_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history")))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each name of each user, by a stream over several batches with keyed state."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", (F.col("event_id") % 6).alias("part"))
    with Folder(spark) as f:
        told = _last_told(spark, f, events, "part", lambda s: streams.profiles(s, "user_id", "event_type", "value", "event_id"))
        return f.told(told.groupBy("user_id", "event_type").agg(F.max_by("value", "batch").alias("value")))


@query("SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of ten minutes, by a stream whose watermark no row misses."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 6).alias("part"))
    with Folder(spark) as f:
        told = _last_told(spark, f, events, "part", lambda s: streams.windowed_counts(s, "ts", "event_type", "10 minutes", "400 days").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))
        return f.told(told.groupBy("event_type", "start").agg(F.max("n").alias("n")))


# --- scalars and collects that had no query ---------------------------------------------


@query("WITH {MENTION} SELECT aspect, upper(aspect) || '-' || sentiment AS surface_form, count(*) AS mention_count FROM men GROUP BY ALL")
def aspect_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.aspect_forms(mentions(spark, sf_dir).withColumn("surface_form", F.concat_ws("-", F.upper("aspect"), "sentiment")))


@query("SELECT p_brand AS brand, name, value, count(*) AS n FROM (SELECT p_brand, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, 'type', p_type FROM part) GROUP BY ALL")
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attributes(spark, sf_dir).join(brands(spark, sf_dir).withColumnRenamed("name", "brand"), "asin")
    return records.pair_rows(rows, "brand", "name", "value")


@query("SELECT p_partkey AS asin, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size END AS number FROM part")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of texts, null for what is none and for NaN."""
    kinds = F.array(F.col("p_retailprice").cast("string"), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.lit("NaN"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), fn.safe_float(F.get(kinds, F.expr("cast(p_partkey % 4 as int)"))).alias("number"))


@query("SELECT 'p' || p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS kind FROM part")
def first_present_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids under one of several names, the first that a row has; wanted columns that the table lacks are passed over."""
    part = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("asin"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("kind"))
    return clean.optional_select(clean.first_present(part, clean.ITEM_NAMES, "item"), ["item", "kind", "nowhere"])


@query("SELECT event_id, event_type AS k, CAST(event_id % 10 AS VARCHAR) AS v FROM events")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list in a model's answer between fences, with a comment and a trailing comma."""
    raw = F.concat(F.lit("Here: ```json\n[{\"k\": \""), "event_type", F.lit("\", \"v\": \""), (F.col("event_id") % 10).cast("string"), F.lit("\"}, // that is all\n]``` done"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(fn.json_list(fn.json_cleaned(raw), "array<struct<k: string, v: string>>")).alias("x"))
    return rows.select("event_id", "x.k", "x.v")


@query("SELECT p_partkey AS asin, p_type AS a, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'old' END AS b, CASE WHEN p_size % 2 = 0 THEN 'new' END AS c FROM part")
def merged_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of a turn laid over those of the turns before."""
    old = F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.lit("old"))
    new = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("b"), F.col("p_brand"), F.lit("c"), F.lit("new"))).otherwise(F.create_map().cast("map<string, string>"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), old.alias("old"), new.alias("new"))
    both = part.select("asin", state.merged_filters("old", "new").alias("f"))
    return both.select("asin", *(F.col("f")[k].alias(k) for k in "abc"))


@query("SELECT doc_id, string_split(text, ' ')[1] AS aspect, string_split(text, ' ')[-1] AS opinion, 'Positive' AS sentiment FROM documents WHERE length(text) > 0")
def model_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model that fails on batches with a text of a line feed in it, and so is asked text by text there."""

    def model(texts: list[str]) -> list[list[tuple[str, str, str]]]:
        if len(texts) > 1 and any("\n" in t for t in texts):
            raise ValueError
        return [[(t.split(" ")[0], t.split(" ")[-1], "Positive")] for t in texts]

    return models.triplets(table(spark, sf_dir, "documents"), "doc_id", "text", model)
