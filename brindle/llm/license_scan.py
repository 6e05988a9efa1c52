"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are classed by length; a class has windows of its own size, an eighth
of it apart, so that some window lies within a sixteenth of wherever a template
starts.  MinHash bands (``BANDS`` of ``ROWS``) of windows retrieve templates: two
shingle sets of similarity s meet in a band with probability
1 - (1 - s**ROWS)**BANDS.  The worst case of a match has a share of 0.8, a window
a quarter longer than the template and a sixteenth of it off: s is 0.47 and the
probability 0.999.  The retrieved templates are verified by the exact share of
their shingles that the window holds.

A text in which no anchor word of any template occurs can't reach the share and
isn't split: a template's anchor words are such that every set of shingles large
enough has one of them.  Of other texts only windows with a template's shingle
are hashed; others can't match either.  DataFrame operations only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, ROWS, BANDS, SHARE = 3, 2, 28, 0.8
#: Most templates of one pass: their shingles are a constant set and their bands a broadcast table, both bounded by this; more take several passes.
MOST_TEMPLATES = 2000

#: Public notices, as they are customarily printed.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A_Z, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATOR, text.translate(str.maketrans(_A_Z, _LOW))) if w]


@dataclass(frozen=True)
class Shape:
    """Windows of a length class, in shingles."""

    window: int

    @property
    def step(self) -> int:
        return max(1, self.window // 8)


def shape_of(shingles: int) -> Shape:
    """The class of a template: windows up to a quarter longer than it."""
    window = 1
    while window < shingles:
        window = max(window + 1, window * 5 // 4)
    return Shape(window)


def anchors(words: list[str], share: float) -> list[str]:
    """Few, long words of which every ``share`` of the shingles has one."""
    n = max(1, len(words) - K + 1)
    left = {i: set(words[i : i + K]) for i in range(n)}
    spare, out = int(n - share * n + 1e-9), []
    while len(left) > spare:
        best = max(sorted(set().union(*left.values())), key=lambda w: (sum(w in s for s in left.values()) * min(len(w), 7) ** 2, w))
        out.append(best)
        left = {i: s for i, s in left.items() if best not in s}
    return out


def _shingles(words: Column) -> Column:
    """Hashes of K successive words; of fewer words the whole sequence."""
    get = lambda i, d: F.get(words, i + d)
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*(get(i, d) for d in range(K))))).when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))


def _bands(values: Column) -> Column:
    least = [F.array_min(F.transform(values, _seeded(i))) for i in range(ROWS * BANDS)]
    return F.array(*(F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def _seeded(i: int):
    return lambda x: F.xxhash64(x, F.lit(i))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, license, window, shingles, bands) of the templates that have words."""
    rows = [(i, name, w, shape_of(max(1, len(w) - K + 1)).window) for i, (name, text) in enumerate(templates) if (w := words_of(text))]
    literal = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.array(*map(F.lit, w)).alias("words"), F.lit(z).alias("window")) for i, n, w, z in rows))
    table = spark.range(1).select(F.explode(literal).alias("t")).select("t.*")
    table = table.withColumn("shingles", F.array_distinct(_shingles(F.col("words"))))
    return table.withColumn("bands", _bands(F.col("shingles"))).drop("words")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, share: float = SHARE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, template, share, first_shingle) of each document and template that match: the best window, of equals the first.

    first_shingle counts words from 0.  Null, empty and wordless texts match
    nothing.  Rows with one id count as one document.  Templates without words
    are left out; without templates, or with an empty table, there are no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    if not any(words_of(t) for _, t in templates):
        return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("share"), F.lit(0).alias("first_shingle")).where("false")
    if len(templates) > MOST_TEMPLATES:
        passes = (scan(docs, templates[k : k + MOST_TEMPLATES], share=share, id_col=id_col, text=text).withColumn("template", F.col("template") + k) for k in range(0, len(templates), MOST_TEMPLATES))
        return reduce(DataFrame.unionByName, passes)
    table = template_table(spark, templates)
    known = table.select("window", "shingles").collect()
    seeds = sorted({h for r in known for h in r["shingles"]})
    low = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _A_Z, _LOW)
    words = sorted({a for _, t in templates for a in anchors(words_of(t), share)})
    outside = _SEPARATOR.removesuffix("+").replace("[", "[^")
    some = F.col("low").rlike(f"(?<!{outside})(?:{'|'.join(map(re.escape, words))})(?!{outside})")
    # The partition's number, not being deterministic, keeps filters above these
    # projections: below them, arrays would be built anew for each element of a lambda.
    here, stay = F.spark_partition_id().alias("here"), F.col("here") >= 0
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), low.alias("low"), here).where(some & stay)
    rows = rows.select("doc_id", F.array_remove(F.split("low", _SEPARATOR), "").alias("words"))
    rows = rows.select("doc_id", _shingles(F.col("words")).alias("h"))
    # A constant set, looked up in constant time and never built anew for a row.
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(seeds), i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.select("doc_id", "h", hits.alias("hits"), here).where((F.size("hits") > 0) & stay)
    shapes = [Shape(w) for w in sorted({r["window"] for r in known})]
    literal = F.array(*(F.struct(F.lit(s.window).alias("window"), F.lit(s.step).alias("step")) for s in shapes))
    rows = rows.withColumn("shape", F.explode_outer(literal)).select("doc_id", "h", "hits", "shape.window", "shape.step")
    starts = F.expr("array_distinct(flatten(transform(hits, p -> transform(sequence(greatest(p - window + step, 0) div step, p div step), q -> cast(q * step AS int)))))")
    rows = rows.select("doc_id", "h", "window", "step", F.explode_outer(starts).alias("start"))
    rows = rows.select("doc_id", "window", "start", F.expr("array_distinct(slice(h, start + 1, window))").alias("inner"), F.expr("slice(h, greatest(start - step, 0) + 1, window + 2 * step)").alias("around"))
    rows = rows.withColumn("band", F.explode_outer(F.array_distinct(_bands(F.col("inner")))))
    wanted = table.select("template", "license", "window", "shingles", F.explode("bands").alias("band"))
    met = rows.join(F.broadcast(wanted), ["window", "band"])
    met = met.withColumn("share", F.size(F.array_intersect("shingles", "around")) / F.size("shingles")).where(F.col("share") >= share)
    best = F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("best")
    return met.groupBy("doc_id", "license", "template").agg(best).select("doc_id", "license", "template", "best.share", (-F.col("best.back")).alias("first_shingle"))
