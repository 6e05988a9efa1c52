"""Summary statistics of reviews and catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_and_count(df: DataFrame, by: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(value), digits).alias("avg_rating"), F.count(value).alias("review_count"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share) of each value; shares come from a window over the counts in one task, so value is to have few values, as ratings have."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def binned(df: DataFrame, value: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """(bin, least, n) of values in equal bins from lo to hi, numbered from 1; hi itself is in the last bin, values beyond are left out."""
    x, width = F.col(value), (hi - lo) / bins
    bin_ = F.least(F.floor((x - lo) / width) + 1, F.lit(bins)).cast("int")
    return df.where(x.between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).select("bin", F.round(lo + (F.col("bin") - 1) * width, 6).alias("least"), "n")


def top_means(df: DataFrame, by: str, value: str, n: int = 15) -> DataFrame:
    """Mean and count of the n groups with the most rows."""
    return mean_and_count(df, [by], value).orderBy(F.desc("review_count"), by).limit(n)


def summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, exact median and ends.  The median keeps each distinct value with its count: for values like ratings, of which there are few."""
    return df.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def shares(df: DataFrame, by: str, n: int = 15) -> DataFrame:
    """The n most frequent values with their share and the cumulative share, in per cent of all rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), by).limit(n)
    running = F.sum("n").over(Window.partitionBy().orderBy(F.desc("n"), by))
    return top.withColumn("running", running).join(F.broadcast(total)).select(by, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share"), F.round(100 * F.col("running") / F.col("total"), 6).alias("cumulative"))


def activity(counts: Column) -> Column:
    return F.when(counts == 1, "1").when(counts <= 5, "2-5").when(counts <= 10, "6-10").when(counts <= 50, "11-50").otherwise("51+")


def activity_buckets(reviews: DataFrame, user: str) -> DataFrame:
    per = reviews.groupBy(user).agg(F.count("*").alias("n"))
    return per.groupBy(activity(F.col("n")).alias("bucket")).agg(F.count("*").alias("users"))


def top_reviewer(reviews: DataFrame, user: str, item: str) -> DataFrame:
    return reviews.groupBy(user).agg(F.count("*").alias("reviews"), F.countDistinct(item).alias("products")).orderBy(F.desc("reviews"), user).limit(1)


def coverage(reviews: DataFrame, user: str, item: str) -> DataFrame:
    found = reviews.agg(F.count("*").alias("reviews"), F.countDistinct(item).alias("products"), F.countDistinct(user).alias("users"))
    return found.withColumns({"per_product": F.round(F.col("reviews") / F.col("products"), 6), "per_user": F.round(F.col("reviews") / F.col("users"), 6)})


def detail_keys(df: DataFrame, details: str) -> DataFrame:
    return df.select(F.explode(F.map_keys(details)).alias("key")).distinct()
