"""From raw documents to packed sequences, in stages that each apply one operator of ``brindle.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
it is written as Parquet and read again.  All but the last keep the columns of
documents.

Columns beside ``doc_id``, ``text`` and ``n_chars`` are carried along, whatever
their names, up to the last stage, and never looked at.  Null, empty and blank
texts have no words and go in the first stage, as do all texts of fewer than 50
words.  Rows may repeat and ids may repeat or be null: the near-duplicate stage
keeps one row of each group, repeats included, so later stages see a text once.
An empty table gives no rows in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import complement_pack, ngram_join, pii_bootstrap, suffix_decontam, weak_quality
from brindle.llm.scratch import save, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go; repeats are judged each for itself."""
    ship(spark)
    return weak_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: similarity of 0.8 or more on five-word shingles.  Texts without words are linked with nothing and stay."""
    ship(spark)
    return ngram_join.drop_near_duplicates(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; null and empty texts stay."""
    ship(spark)
    return suffix_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows; a null text stays null."""
    ship(spark)
    return pii_bootstrap.mask(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: each piece's place.  A null or empty text is one piece of the end id."""
    ship(spark)
    return complement_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("packing", packed)]
#: The label model and the packing can't be put into SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name)
    return docs
