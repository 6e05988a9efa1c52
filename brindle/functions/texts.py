"""Texts of records, nodes and mentions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import GENERIC_KEYS, col, normalized_attribute, slugify

#: White space of Unicode, as a class of a regular expression.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The details that a record's text gives first.
TOLD_DETAILS = ("Material", "Color", "Size", "Style", "Brand")


def collapsed(c: Column | str) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{BLANK}+", " "))


def _words(cut: Column) -> Column:
    return F.filter(F.split(cut, " "), lambda w: w != "")


def _clean(cut: Column, words: Column, tokens: int) -> Column:
    return F.when(F.size(words) > tokens, F.array_join(F.slice(words, 1, tokens), " ")).when(F.size(words) > 0, cut)


def _reason(given: Column, cut: Column, words: Column, tokens: int) -> Column:
    reasons = ((given.isNull(), "non-string text"), (cut == "", "empty after strip"), (F.size(words) == 0, "empty after cap"), (F.lit(tokens < 1), "empty after token cap"))
    out = F.lit(None).cast("string")
    for failed, reason in reversed(reasons):
        out = F.when(failed, reason).otherwise(out)
    return out


def sanitized(c: Column | str, characters: int = 512, tokens: int = 200) -> Column:
    """White space collapsed, cut to so many characters, then tokens; null where nothing is left.  A blank at the cut stays unless tokens are cut.  For whole texts in a table see ``sanitize``."""
    cut = F.substring(collapsed(c), 1, characters)
    return _clean(cut, _words(cut), tokens)


def rejection(c: Column | str, characters: int = 512, tokens: int = 200) -> Column:
    """Why a text is rejected, or null."""
    cut = F.substring(collapsed(c), 1, characters)
    return _reason(col(c), cut, _words(cut), tokens)


def sanitize(df: DataFrame, text: str, characters: int = 512, tokens: int = 200) -> DataFrame:
    """df with ``clean`` and ``reason``, as ``sanitized`` and ``rejection`` give them.

    The collapse of the whole text and the words of what is left of it are
    columns of projections of their own, so each is made once for a row.
    """
    flat = df.withColumn("__cut", F.substring(collapsed(text), 1, characters))
    split = flat.withColumn("__words", _words(F.col("__cut")))
    words, cut = F.col("__words"), F.col("__cut")
    return split.withColumns({"clean": _clean(cut, words, tokens), "reason": _reason(col(text), cut, words, tokens)}).drop("__cut", "__words")


def list_text(c: Column | str, between: str = " | ") -> Column:
    """A list's elements in one text; nulls are left out, and no list is an empty text."""
    return F.coalesce(F.array_join(col(c), between), F.lit(""))


def _parts(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def metadata_text(title: Column | str, description: Column | str, features: Column | str, categories: Column | str, main_category: Column | str, store: Column | str, details: Column | str) -> Column:
    """A catalog record in one text: the title twice, lists, category, brand, the told details, then all details.  Lists are arrays, details a map; what is missing or empty is left out."""
    pair = lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    entries = F.coalesce(F.map_entries(col(details)), F.array().cast("array<struct<key: string, value: string>>"))
    told = F.filter(entries, lambda e: e["key"].isin(*TOLD_DETAILS) & (e["value"] != ""))
    every = F.filter(entries, lambda e: e["key"] != "")
    lists = [list_text(c, " ") for c in (description, features, categories)]
    brand = F.when(col(store) != "", F.concat(F.lit("Brand: "), col(store)))
    return _parts(col(title), col(title), *lists, col(main_category), brand, F.array_join(F.transform(told, pair), " "), F.array_join(F.transform(every, pair), " "))


def review_text(title: Column | str, text: Column | str) -> Column:
    """Title and text of a review, or null without either."""
    both = _parts(col(title), col(text))
    return F.when(both != "", both)


def attribute_text(name: Column | str, value: Column | str, generic: Sequence[str] = GENERIC_KEYS) -> Column:
    """``name: value`` with the value normalised; of a generic name the value alone."""
    n, v = F.coalesce(col(name), F.lit("")), normalized_attribute(F.coalesce(col(value), F.lit("")))
    return F.when(F.lower(F.trim(n)).isin(*generic), v).otherwise(F.concat(n, F.lit(": "), v))


def _or(c: Column | str, default: str) -> Column:
    return F.coalesce(F.when(col(c) != "", col(c)), F.lit(default))


def brand_text(name: Column | str, domain: Column | str) -> Column:
    return F.concat(F.lit("Brand: "), col(name), F.lit(". Domain: "), _or(domain, "consumer electronics"))


def category_text(name: Column | str, parent: Column | str) -> Column:
    """A category with its parent."""
    return F.concat(F.lit("Category: "), col(name), F.lit(". Parent: "), _or(parent, "Root"))


def category_context_text(name: Column | str, path: Column | str, titles: Column | str, most: int = 5, words: int = 10) -> Column:
    """A category with the names above it in its path and the first titles of its products, each cut to some words."""
    p = col(path)
    above = F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ", ")).otherwise("Root Category")
    shown = F.filter(F.slice(col(titles), 1, most), lambda t: t != "")
    cut = F.transform(shown, lambda t: F.array_join(F.slice(F.split(collapsed(t), " "), 1, words), " "))
    items = F.when(F.size(F.coalesce(col(titles), F.array().cast("array<string>"))) > 0, F.array_join(cut, ", ")).otherwise("None")
    return F.concat(F.lit("Category: "), F.coalesce(col(name), F.lit("")), F.lit(". Context: "), above, F.lit(". Related items: "), items, F.lit("."))


def product_text(title: Column | str, category: Column | str, features: Column | str, description: Column | str, most: int = 5) -> Column:
    """A product with its category and its first features (an array)."""
    shown = F.coalesce(F.array_join(F.slice(col(features), 1, most), ", "), F.lit(""))
    return F.concat(F.lit("Product: "), _or(title, ""), F.lit(". Category: "), _or(category, "Unknown"), F.lit(". Features: "), shown, F.lit(". Description: "), _or(description, ""))


def canonical_aspect(c: Column | str, terms: Sequence[str]) -> Column:
    """The first term of a gazetteer in a text, in lower case, of those that start at one place the longest; else the slug.

    Terms are met as whole tokens and in their own case.  The terms become one
    regular expression: a gazetteer of some thousands at most.
    """
    surface = F.trim(col(c))
    if not terms:
        return slugify(surface)
    import re

    longest = sorted(set(terms), key=lambda t: (-len(t), t))
    quoted = [re.sub(r"([^\w\s])", r"\\\1", t) for t in longest]
    found = F.regexp_extract(surface, rf"(?<![\p{{L}}\p{{N}}])({'|'.join(quoted)})(?![\p{{L}}\p{{N}}])", 1)
    return F.when(found != "", F.lower(found)).otherwise(slugify(surface))
