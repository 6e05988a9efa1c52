"""Scalar functions of the engine as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price ranges in dollars, lower bound included, upper excluded.
PRICE_RANGES = ((0, 50), (50, 150), (150, 400), (400, 1000), (1000, 1500), (1500, None))
#: Details and feature keys.
MISSING_DETAIL = "Not Available"
BRAND_KEYS = ("Brand", "brand", "Brand Name", "Brand_Name")
GENERIC_KEYS = ("feature", "bullet_point", "product_feature", "about_this_item")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(c: Column | str) -> Column:
    """A number, or null for what is none (NaN too)."""
    x = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def review_id(user: Column | str, item: Column | str, epoch_s: Column | str, title: Column | str) -> Column:
    """sha256 of the four parts joined by a bar; a null reads ``None``."""
    part = lambda c: F.coalesce(col(c).cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", *map(part, (user, item, epoch_s, title))), 256)


def category_id(path: Column | str, depth: Column) -> Column:
    """sha1 of the first ``depth`` names of a path."""
    return F.sha1(F.array_join(F.slice(col(path), F.lit(1), depth), " > "))


def bucket_index(price: Column | str) -> Column:
    """The price range's number from 1, null without a price in any."""
    p, out = col(price), F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(PRICE_RANGES, 1))):
        inside = (p >= lo) & (p < hi) if hi is not None else p >= lo
        out = F.when(inside & ~F.isnan(p), k).otherwise(out)
    return out


def bucket_name(lo: float, hi: float | None) -> str:
    return f"USD_{lo:.2f}_{'inf' if hi is None else f'{hi:.2f}'}"


def bucket_id(price: Column | str) -> Column:
    names = F.array(*(F.lit(bucket_name(lo, hi)) for lo, hi in PRICE_RANGES))
    return F.get(names, bucket_index(price) - 1)


def attribute_key(c: Column | str) -> Column:
    return F.replace(F.lower(F.trim(col(c))), F.lit(" "), F.lit("_"))


def slugify(c: Column | str) -> Column:
    """Letters and digits in lower case, what is between them as one underscore; ``unknown`` if there are none."""
    words = F.trim(F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", " ")))
    return F.when(words == "", "unknown").otherwise(F.replace(words, F.lit(" "), F.lit("_")))


# Units: a value is a dimension, else a storage size, else a weight, else as it is.  Fixed values: the units and the patterns that tell them.


def normalized_dimension(c: Column) -> Column:
    """Inches and centimetres spelt one way; a blank around every ``x``, inside words too."""
    x = F.regexp_replace(c, r"(\d+)\s*(?:\"|'')", "$1 inch")
    x = F.regexp_replace(x, r"\b(?:in|inches)\b", "inch")
    x = F.regexp_replace(x, r"(\d+)\s*(cm|mm)\b", "$1 $2")
    return F.trim(F.regexp_replace(x, r"\s*x\s*", " x "))


def normalized_storage(c: Column) -> Column:
    for unit in ("gb", "mb", "tb", "kb"):
        c = F.regexp_replace(c, rf"(\d+)\s*{unit}\b", f"$1 {unit.upper()}")
    return c


def normalized_attribute(c: Column | str) -> Column:
    x = F.lower(F.trim(col(c)))
    dimension = x.rlike(r"\d+\s*(?:\"|''|in\b|inch|cm\b|mm\b)|\d+\s*x\s*\d+")
    storage, weight = x.rlike(r"\d+\s*(?:gb|mb|tb|kb)\b"), x.rlike(r"\d+\s*(?:lbs|lb|kg|g|oz)\b")
    return F.when(dimension, normalized_dimension(x)).when(storage, normalized_storage(x)).when(weight, F.regexp_replace(x, r"\blbs\b", "lb")).otherwise(x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two float arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(col(x), col(y), lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def index_score(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity on the scale from 0 to 1."""
    return (1 + cosine(a, b)) / 2


def review_weight(helpful: Column | str, verified: Column | str) -> Column:
    h = F.coalesce(col(helpful), F.lit(0))
    return F.lit(1.0) + F.when(h > 5, 0.5).when(h > 0, 0.2).otherwise(0.0) + F.when(F.coalesce(col(verified), F.lit(False)), 0.3).otherwise(0.0)


def repeats(weight: float) -> int:
    """Copies of a text of this weight in a combination."""
    return max(1, int(weight)) + (weight - int(weight) >= 0.5)


def weighted_text(metadata: Column | str, reviews: Column | str, metadata_weight: float = 1.5, review_weight_: float = 1.0) -> Column:
    parts = [F.coalesce(col(metadata), F.lit(""))] * repeats(metadata_weight) + [F.coalesce(col(reviews), F.lit(""))] * repeats(review_weight_)
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def json_cleaned(c: Column | str) -> Column:
    """A model's JSON without fences, line comments and trailing commas."""
    x = F.regexp_replace(col(c), r"```(?:json)?", "")
    x = F.regexp_replace(x, r"//[^\n]*", "")
    return F.trim(F.regexp_replace(x, r",\s*([}\]])", "$1"))


def json_list(c: Column | str, schema: str) -> Column:
    """The array between the first and the last bracket of a text, or null."""
    return F.from_json(F.regexp_extract(col(c), r"(?s)\[.*\]", 0), schema)


def sentiment(c: Column | str) -> Column:
    x = F.lower(F.trim(col(c)))
    return F.initcap(F.when(x.isin("positive", "negative", "neutral"), x).otherwise("neutral"))
