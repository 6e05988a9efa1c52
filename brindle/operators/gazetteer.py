"""Phrases of a gazetteer of any size in texts: joins on tokens instead of one large expression.

A token is a run of letters and digits, or any other single character, so the
tokens of a text are the text.  A term is met where its tokens are, which is
where it stands between letters and digits of no other word.  Positions of
texts meet the first tokens of terms, each with the lengths that terms beginning
so have, and what has such a length there is looked up whole.  Both joins have
one row of a key on the side of the terms, so a frequent token multiplies by the
lengths of its terms and never by their number.

Positions are many times as large as the texts, so none is shuffled before a
term is likely there: first tokens and 64-bit hashes of the terms go to the
texts, the hashes in as many parts as they need, and only what has the hash of
a term goes to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import slugify
from brindle.shared import Kept

#: Most bytes of first tokens, and most hashes of terms, that are broadcast at once.
SENT_BYTES, SENT_HASHES = 32 << 20, 2_000_000
WORD = r"^[\p{L}\p{N}]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def _terms(terms: DataFrame, term: str) -> DataFrame:
    known = terms.select(F.col(term).cast("string").alias("term")).where("term IS NOT NULL AND term <> ''").distinct()
    return known.select("term", tokens("term").alias("t")).select("term", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"))


def starts(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, position, n, term): the longest term at each place of a text where one begins.

    position and n count tokens, from 0.  Terms are met in
    their own case.  Null and empty texts and terms meet nothing; repeated terms
    count once.  Keys of texts are taken to be different.
    """
    kept = Kept(texts.sparkSession)
    known = kept.table(_terms(terms, term), "terms", stays=True)
    firsts = kept.table(known.groupBy(F.col("first").alias("token")).agg(F.collect_set("n").alias("lengths")), "firsts", stays=True)
    hashes = kept.table(known.select(F.xxhash64("term").alias("hash")).distinct(), "hashes", stays=True)
    split = texts.select(F.col(key).alias("key"), tokens(F.col(text).cast("string")).alias("tokens")).where("size(tokens) > 0")
    placed = split.select("key", "tokens", F.posexplode("tokens").alias("position", "token"))
    before = F.get("tokens", F.col("position") - 1)
    placed = placed.where(F.col("token").rlike(WORD) | before.isNull() | ~before.rlike(WORD))
    if (firsts.agg(F.sum(F.octet_length("token") + 4 * F.size("lengths") + 32)).first()[0] or 0) <= SENT_BYTES:
        sized = placed.join(F.broadcast(firsts), "token")
    else:  # every length at every place
        lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
        sized = placed.withColumn("lengths", F.array(*map(F.lit, lengths)))
    sized = sized.select("key", "position", "tokens", F.explode("lengths").alias("n")).where("position + n <= size(tokens)")
    last, after = F.get("tokens", F.col("position") + F.col("n") - 1), F.get("tokens", F.col("position") + F.col("n"))
    whole = F.coalesce(last.rlike(WORD) | ~after.rlike(WORD), F.lit(True))
    asked = sized.where(whole).select("key", "position", "n", F.array_join(F.slice("tokens", F.col("position") + 1, F.col("n")), "").alias("term"))
    parts, likely = max(1, -(-hashes.count() // SENT_HASHES)), None
    for part in range(parts):
        some = F.broadcast(hashes.where(F.pmod("hash", F.lit(parts)) == part))
        one = asked.withColumn("hash", F.xxhash64("term")).join(some, "hash", "left_semi").drop("hash")
        likely = one if likely is None else likely.union(one)
    met = likely.join(known.select("term"), "term")
    return met.groupBy("key", "position").agg(F.max_by(F.struct("n", "term"), "n").alias("best")).select(F.col("key").alias(key), "position", "best.n", "best.term")


def leftmost(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, position, n, term): of each text the term that begins first, of those that begin there the longest; texts without one have no row."""
    met = starts(texts, key, text, terms, term)
    first = met.groupBy(key).agg(F.min_by(F.struct("position", "n", "term"), "position").alias("m"))
    return first.select(key, "m.position", "m.n", "m.term")


def apart(met: DataFrame, key: str) -> DataFrame:
    """Of the matches of ``starts`` those that reading from the left leaves: none begins within the one before.

    A text's matches meet in one array, as large as the text at most.
    """
    one = F.struct("position", "n", "term")
    step = lambda acc, m: F.when(m["position"] >= acc["free"], F.struct((m["position"] + m["n"]).alias("free"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc)
    none = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<struct<position: int, n: int, term: {dict(met.dtypes)['term']}>>").alias("kept"))
    held = met.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return held.select(key, F.inline(F.aggregate("all", none, step, lambda acc: acc["kept"])))


def canonical(df: DataFrame, text: str, terms: DataFrame, out: str = "aspect", term: str = "term") -> DataFrame:
    """df with ``out``: the leftmost, longest term of the text in lower case, else the text's slug; null for a null text.

    Each different text is looked at once and joined back, so a mention that a
    third of all rows repeat costs one look.
    """
    surface = df.select(F.trim(F.col(text)).alias("__surface")).where("__surface IS NOT NULL").distinct()
    found = leftmost(surface, "__surface", "__surface", terms, term).select("__surface", F.lower("term").alias("__term"))
    joined = df.withColumn("__surface", F.trim(F.col(text))).join(found, "__surface", "left")
    return joined.withColumn(out, F.coalesce("__term", slugify("__surface"))).drop("__surface", "__term")
