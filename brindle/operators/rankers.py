"""Product features and a ranker from ratings, with Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.records import min_max


def text_features(kind: str = "hashed", size: int = 1000, vocabulary: int = 100_000) -> list:
    """Stages from ``text`` (null counts as empty) to ``text_vector``: hashed words of unit length, or TF-IDF over the most frequent words."""
    words = [SQLTransformer(statement="SELECT *, coalesce(text, '') AS told FROM __THIS__"), RegexTokenizer(inputCol="told", outputCol="words", pattern="\\W+"), StopWordsRemover(inputCol="words", outputCol="kept", stopWords=StopWordsRemover.loadDefaultStopWords("english"))]
    if kind == "hashed":
        return [*words, HashingTF(inputCol="kept", outputCol="counts", numFeatures=size), Normalizer(inputCol="counts", outputCol="text_vector")]
    return [*words, CountVectorizer(inputCol="kept", outputCol="counts", vocabSize=vocabulary), IDF(inputCol="counts", outputCol="text_vector")]


def item_features(items: DataFrame, categorical: Sequence[str], kind: str = "hashed", **options) -> PipelineModel:
    """A fitted pipeline from items (text and categorical columns) to ``features``: sparse vectors, one after another.  Unseen and null categories have a place of their own."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep")
    one_hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_vector" for c in categorical], handleInvalid="keep")
    joined = VectorAssembler(inputCols=["text_vector", *one_hot.getOutputCols()], outputCol="features")
    return Pipeline(stages=[*text_features(kind, **options), index, one_hot, joined]).fit(items)


def ranker(ratings: DataFrame, user: str, item: str, rating: str, *, rank: int = 64, rounds: int = 10, seed: int = 7) -> ALSModel:
    """Matrix factorisation of implicit ratings by alternating least squares; keys must be whole numbers of 32 bits."""
    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=rounds, seed=seed, implicitPrefs=True, coldStartStrategy="drop").fit(ratings)


def top_positive(scores: DataFrame, by: Sequence[str], item: str, score: str, k: int) -> DataFrame:
    """The k best of each group among scores above 0, with their rank."""
    ranked = scores.where(F.col(score) > 0).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), item)))
    return ranked.where(F.col("rank") <= k)


def ranked_for(model: ALSModel, users: DataFrame, n: int = 10, cold: DataFrame | None = None) -> DataFrame:
    """(user, item, score) of the n best items of each user, scores scaled to 0 to 1 over all; users that the model doesn't know get ``cold``, a table (item, score)."""
    user, item = model.getUserCol(), model.getItemCol()
    known = model.recommendForUserSubset(users, n).select(user, F.inline("recommendations")).withColumnRenamed("rating", "score")
    scaled = min_max(known.select(user, item, F.col("score").cast("double").alias("raw")), "raw", "score").drop("raw")
    if cold is None:
        return scaled
    new = users.select(user).distinct().join(known.select(user).distinct(), user, "left_anti")
    return scaled.unionByName(new.join(F.broadcast(cold.select(item, "score").orderBy(F.desc("score"), item).limit(n))).select(user, item, "score"))
