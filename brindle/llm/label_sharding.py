"""Sharding by balanced label propagation.

Documents with equal texts are linked: each text is a hub of its copies.  Every
linked document starts on a shard given by a hash; in each round a join with the
hubs' counts tells it the shard where most of its copies are, and it moves there
as far as quotas allow.  Quotas are set for each pair of shards from the flows
asked for, so that no shard goes over its capacity; which documents move within
a quota is decided by a hash, without sorting.  Documents without links then
fill the shards up, and the law ``rows`` (counts at most one apart) is met
exactly by ranks that are counted in buckets, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.scratch import drop, save, saved_path, shuffle_partitions

ROUNDS, SLOT_ROWS, HOT = 4, 50_000, 64


def rank_within(df: DataFrame, key: str, order: Column, name: str, buckets: int) -> DataFrame:
    """df with a gapless rank from 0 within each key, in order of (hash bucket, order).

    Rows are ranked within (key, bucket) and the buckets' counts are summed, so a
    key that holds most rows is spread over all buckets.  order must be unique
    within a key, and stable if the plan is evaluated again.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select(key, "__bucket", (F.sum("__n").over(Window.partitionBy(key).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(order)) - 1
    return df.withColumn("__inner", inner).join(before, [key, "__bucket"]).withColumn(name, (F.col("__before") + F.col("__inner")).cast("bigint")).drop("__bucket", "__before", "__inner")


def _quotas(flow: dict[tuple[int, int], int], load: list[int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each asked move (from, to) that may happen, so that no load ends over its room.

    Moves that balance each other come first; what goes one way beyond that takes
    the free room of its target, dealt out in proportion.
    """
    share = {}
    shards = range(len(load))
    extra = {}
    for (a, b), n in flow.items():
        back = flow.get((b, a), 0)
        share[a, b] = min(n, back)
        if n > back:
            extra[a, b] = n - back
    for b in shards:
        wanted = sum(n for (x, y), n in extra.items() if y == b)
        free = max(0, room[b] - load[b])
        for (x, y), n in extra.items():
            if y == b and wanted:
                share[x, y] += n * min(1.0, free / wanted)
    return {k: v / flow[k] for k, v in share.items() if flow[k]}


def _with(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with one row of each group: the big ones, of a bounded number, are broadcast, so that none lands in one task."""
    own = [c for c in groups.columns if c != "big"]
    hot = rows.where("big").join(F.broadcast(groups.where("big").select(own)), "group")
    return hot.unionByName(rows.where("NOT big").join(groups.where("NOT big").select(own), "group"))


def label_propagation(docs: DataFrame, shards: int = 8, *, rounds: int = ROUNDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) of each row of docs, under the law ``rows``.

    size: bytes of the text and one more; a null text has none, is the same as an
    empty one for the digest, and null and empty texts are copies of each other.
    Repeated rows are rows each; ids may repeat or be null.  An empty table gives
    no rows.  Other columns aren't read.  The driver gets counts of shards and of
    pairs of shards only.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.sha2(t, 256).alias("group"))
    base = save(base.withColumn("uid", F.monotonically_increasing_id()), "docs")
    total = base.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    # Of groups with more rows than this there are at most HOT for each shard.
    big = F.col("n") > max(1, total // (shards * HOT))
    hubs = save(base.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", big.alias("big")), "hubs")
    hot = F.broadcast(hubs.where("big"))
    marked = base.join(hot, "group", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    linked = _with(marked, hubs).select("uid", "group", "big", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))
    linked = save(linked, "labels")
    n_linked = linked.count()
    for turn in range(rounds if n_linked else 0):
        counts = linked.groupBy("group", "big", "shard").agg(F.count("*").alias("n"))
        # Of equally good shards the one a hash prefers: else the first shards would be asked for more than others.
        liked = F.struct(F.col("n"), F.xxhash64("group", "shard").alias("by"), F.col("shard"))
        wish = counts.groupBy("group", "big").agg(F.max(liked).alias("best")).select("group", "big", F.col("best.shard").alias("to"))
        asked = save(_with(linked, wish), "asked")
        load = [0] * shards
        for s, n in asked.groupBy("shard").count().collect():
            load[s] = n
        flow = {(a, b): n for a, b, n in asked.where("shard <> to").groupBy("shard", "to").count().collect()}
        if not flow:
            drop(asked.sparkSession, saved_path(asked))
            break
        share = _quotas(flow, load, room)
        allowed = F.lit(0.0)
        for (a, b), v in share.items():
            allowed = F.when((F.col("shard") == a) & (F.col("to") == b), F.lit(float(v))).otherwise(allowed)
        # Members of a group go in one order of the hash, so what a quota lets through are whole groups rather than parts of all.
        dice = F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        small = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moves = (F.col("shard") != F.col("to")) & (F.when(F.col("big"), small).otherwise(dice) < allowed)
        before = linked
        linked = save(asked.select("uid", "group", "big", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        drop(asked.sparkSession, saved_path(asked), saved_path(before))
    labelled = base.join(linked.select("uid", "shard"), "uid", "left")
    return _filled(labelled, room, total)


def _filled(labelled: DataFrame, room: list[int], total: int) -> DataFrame:
    """Shards of exactly ``room`` rows: linked rows keep theirs as far as there is room, all others fill the rest."""
    shards, buckets = len(room), max(shuffle_partitions(labelled.sparkSession), total // SLOT_ROWS)
    kept = save(rank_within(labelled.where("shard is not null"), "shard", F.col("uid"), "rank", buckets), "kept")
    limit = F.element_at(F.array(*(F.lit(r) for r in room)), F.col("shard") + 1)
    over = kept.where(F.col("rank") >= limit)
    used = [0] * shards
    for s, n in kept.groupBy("shard").count().collect():
        used[s] = min(n, room[s])
    stay = kept.where(F.col("rank") < limit).select("doc_id", "size", "text_crc32", "group", "shard", F.col("rank").alias("slot"))
    loose = labelled.where("shard is null").drop("shard").unionByName(over.drop("shard", "rank"))
    loose = rank_within(loose.withColumn("__all", F.lit(0)), "__all", F.col("uid"), "rank", buckets)
    shard, slot, first = F.lit(None).cast("int"), F.lit(None).cast("bigint"), 0
    for s in range(shards):
        n = room[s] - used[s]
        here = (F.col("rank") >= first) & (F.col("rank") < first + n)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("rank") - first + used[s]).otherwise(slot)
        first += n
    return stay.unionByName(loose.select("doc_id", "size", "text_crc32", "group", shard.alias("shard"), slot.alias("slot")))


def cut_edges(placed: DataFrame) -> DataFrame:
    """(pairs, cut): pairs of copies, and how many of them lie on different shards; from counts, no pair is made.  placed: rows with group and shard."""
    pairs_of = lambda n: n * (n - 1) / 2
    each = placed.groupBy("group", "shard").agg(F.count("*").cast("double").alias("n"))
    of_group = each.groupBy("group").agg(pairs_of(F.sum("n")).alias("pairs"), F.sum(pairs_of(F.col("n"))).alias("together"))
    return of_group.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(F.col("pairs") - F.col("together")), F.lit(0.0)).alias("cut"))
