"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import drop, save, saved_path


def _towards_least(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: the neighbours of each node (those larger, or those smaller) point to its least neighbour.

    Two aggregations with partial sums and a join on the node, which adaptive
    execution may split where a node has very many neighbours.
    """
    if larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))
    out = both.join(least, "u")
    out = out.where("v > u").select("v", "m") if larger else out.select("v", "m").union(least.select("u", "m"))
    return out.where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the
    edges no longer change; each round is written to the shared folder.  Nulls
    and loops are no edges.  A long chain takes a number of rounds in proportion
    to the logarithm of its length.
    """
    now = save(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct(), "cc")
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()
    digest = None
    first, held = now, []
    for _ in range(most_rounds):
        step = save(_towards_least(_towards_least(now, True), False), "cc")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        held.append(step)
        now, before = step, digest
        digest = tuple(seen)
        for old in held[:-1]:
            drop(old.sparkSession, saved_path(old))
            held.remove(old)
        if digest == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
