"""N-gram Jaccard self-join by vertical partitioning.

A text's set is its distinct word shingles, ordered by their 64-bit hashes: a
global order.  The order is cut into fragments.  Two sets that link differ in
at most H shingles, so of K > H fragments at least K - H hold equal segments;
an equal segment is what makes two sets candidates.  Fragments that are empty
in both are no evidence: with K = H + 1 + spare a set gives signatures of its
empty fragments only if it has more than spare of them, and spare is such that
few sets do.  What is left of spare are signatures that a set may do without:
those that most sets share, in an order that is the same for all sets.  Of the
spare + 1 equal segments at least one is then left to both, and a set with few
shared signatures has none left and meets nothing.  Candidates are verified
exactly: overlaps are counted separately in each fragment of the order and
summed for each pair, after a bound from bit maps has ruled out most pairs that
differ too much.

Copies are one set from the first step on.  In a few rounds
each set is compared with one other, the most central of another component that
its signatures offer; then the pairs of different components that share a
signature are looked at in blocks, by counts of shingles in parts of the order,
and only those that the counts don't rule out become rows and are verified.  So
no group gives all its pairs, and no link between different components is lost.

Set ids are 64-bit digests: two different sets among n share one with
probability n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import textbytes as tb
from brindle.llm.components import connected_components
from brindle.llm.memory import LEAST, give_back, returning
from brindle.llm.scratch import drop, free_names, release, save, saved_path, sendable, shuffle_partitions

FRAGMENTS = 8
SLICE_BYTES = 1 << 20
#: Rounds in which each set is compared with one other; sets of a block; how many are compared at once: rows of a bit matrix, its cells that become pairs, counts of pairs.
STARS, BLOCK = 3, 2048
ROWS_AT_ONCE, CELLS_AT_ONCE, COUNTS_AT_ONCE = 512, 1 << 18, 1 << 21
#: Most bytes, compressed, of ids that are broadcast: about half a million of them.
SENT_BYTES = 8 << 20
#: Bytes of sets that go to blocks at once, if a copy of each isn't more.
WAVE_BYTES = 1 << 29
U = np.uint64


class Classes:
    """Size classes: two sets that link are of one class or of two neighbouring ones."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        low, n = [1], 1
        while n < most:
            n = n * den // num + 1
            low.append(n)
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        #: Most shingles in which two linked sets, the smaller of the class, can differ; fragments for that.
        self.differ = np.array([(t + t * den // num) * (den - num) // (den + num) for t in top.tolist()], np.int64)
        #: Fragments beyond those that may differ and one: about two deviations above the empty ones of the class's least set, two at least.
        self.spare, kept = np.full(len(top), 2), self.differ + 1
        for _ in range(2):
            empty = (kept + self.spare) * np.exp(-self.low[:-1] / (kept + self.spare))
            self.spare = np.maximum(2, np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64))
        self.pieces = kept + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and offsets."""
    raw, off = tb.text_bytes(column)
    data = tb.LOWER[raw]
    s, e, first = tb.runs(data, off, tb.SPACED)
    words = tb.run_hashes(data, s, e)
    n = np.diff(first)
    h = tb.gram_hashes(words, k)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(start[-1], U)
    long = n >= k
    out[tb.ranges(start[:-1][long], count[long])] = h[tb.ranges(first[:-1][long], count[long])]
    for d in np.flatnonzero((n > 0) & ~long):
        out[start[d]] = tb.gram_hashes(words[first[d] : first[d + 1]], int(n[d]))[0]
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[start[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[start]


def set_ids(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A digest of each set."""
    total = np.concatenate([[U(0)], np.cumsum(tb.mix(values ^ U(0xA5A5A5A5DEADBEEF)), dtype=U)])
    return tb.mix(total[off[1:]] - total[off[:-1]] + (off[1:] - off[:-1]).astype(U)).astype(np.int64)


def signatures(values: np.ndarray, off: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, spare) of the segments of each set.  values: sorted sets one after another.

    The lowest bit of a signature tells a set's two groups apart; spare is how
    many signatures of the group the set may do without.
    """
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    total = np.concatenate([[U(0)], np.cumsum(tb.mix(values), dtype=U)])
    size_class = classes.of(np.maximum(n, 1))
    sets, sigs, spares = [], [], []
    for shift in (0, 1):
        group = size_class - shift
        use = (n > 0) & (group >= 0) & (classes.differ[np.maximum(group, 0)] > 0)
        pieces = np.where(use, classes.pieces[np.maximum(group, 0)], 1)
        spare, side = classes.spare[np.maximum(group, 0)], (group & 1).astype(U)
        salt = tb.mix((group + 1).astype(U) * U(0xD6E8FEB86659FD93))
        fragment = ((values >> U(32)) * pieces[owner].astype(U)) >> U(32)
        new = np.ones(len(values), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(values)]])
        of = owner[head]
        sig = tb.mix(total[tail] - total[head] + (tail - head).astype(U) + salt[of] * (fragment[head] + U(1)))
        sig = sig & ~U(1) | side[of]
        blank = pieces - np.bincount(of, minlength=len(n))
        left = np.where(blank > spare, spare, spare - blank)
        sets.append(of[use[of]])
        sigs.append(sig[use[of]])
        spares.append(left[of[use[of]]])
        for d in np.flatnonzero(use & (blank > spare)):
            lo, hi = np.searchsorted(of, [d, d + 1])
            empty = np.setdiff1d(np.arange(pieces[d], dtype=U), fragment[head[lo:hi]])
            sigs.append(tb.mix(salt[d] * (empty + U(1)) + U(0x5851F42D4C957F2D)) & ~U(1) | side[d])
            sets.append(np.full(len(empty), d))
            spares.append(np.full(len(empty), left[d]))
    return np.concatenate(sets), np.concatenate(sigs).astype(np.int64), np.concatenate(spares)


def _described(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(doc_id, hash, n, set_id) of each text; hash is the text's own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "text", SLICE_BYTES):
                values, off = shingle_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(np.diff(off), pa.int64()), pa.array(set_ids(values, off))], ["doc_id", "hash", "n", "set_id"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text).alias("hash"), F.col(f"`{text}`").alias("text")).mapInArrow(returning(run), f"doc_id {kind}, hash bigint, n bigint, set_id bigint")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _signed(docs: DataFrame, text: str, k: int, classes: Classes) -> DataFrame:
    """(sig, set_id, spare) of each text; of copies within a slice only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, text, SLICE_BYTES):
                values, off = shingle_sets(batch.column(text), k)
                ids, (sets, sigs, spares) = set_ids(values, off), signatures(values, off, classes)
                _, firsts = np.unique(ids, return_index=True)
                one = np.zeros(len(ids), bool)
                one[firsts] = True
                keep = one[sets]
                yield pa.RecordBatch.from_arrays([pa.array(sigs[keep]), pa.array(ids[sets[keep]]), pa.array(spares[keep], pa.int32())], ["sig", "set_id", "spare"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(returning(run), "sig bigint, set_id bigint, spare int")


def _sharing(rows: DataFrame) -> DataFrame:
    """(sig, set_id, spare) of signatures with two different sets or more, each once.

    The rows are dealt by signature and sorted.  Python sees a stream of them in
    which a row stays if a neighbour has its signature, so it holds one batch and
    one row more, however many sets share a signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared = None, False  # the row held back, and whether the one before it had its signature
        for batch in batches:
            sig, ids, spare = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            if last is not None:
                sig, ids, spare = (np.concatenate([[x], y]) for x, y in zip(last, (sig, ids, spare), strict=True))
            if not len(sig):
                continue
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
            sig, ids, spare = sig[new], ids[new], spare[new]
            before = np.concatenate([[shared], sig[1:] == sig[:-1]])
            keep = before[:-1] | before[1:]
            last, shared = (sig[-1], ids[-1], spare[-1]), bool(before[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep], t) for x, t in zip((sig, ids, spare), kinds, strict=True)], names)
        if shared:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, kinds, strict=True)], names)

    names, kinds = ["sig", "set_id", "spare"], [pa.int64(), pa.int64(), pa.int32()]
    dealt = rows.select(*names).repartition(shuffle_partitions(rows.sparkSession), "sig").sortWithinPartitions("sig", "set_id")
    return dealt.mapInArrow(run, "sig bigint, set_id bigint, spare int")


def _needed(groups: DataFrame) -> DataFrame:
    """(sig, set_id, degree) without the signatures that a set may do without: of each of its two groups the ``spare`` ones that most sets share.

    degree: how many signatures the set shares, those left out too.
    """
    held = groups.join(groups.groupBy("sig").agg(F.count("*").alias("sharing")), "sig")
    nth = F.row_number().over(Window.partitionBy("set_id", F.col("sig").bitwiseAND(F.lit(1))).orderBy(F.desc("sharing"), "sig"))
    told = held.withColumn("nth", nth).withColumn("degree", F.count("*").over(Window.partitionBy("set_id")))
    return told.where("nth > spare").select("sig", "set_id", "degree")


def _survivors(table: pa.Table, num: int, den: int) -> pa.Table:
    """(a, b) of the pairs of a block that share a signature, are of different components and whose counts don't rule them out.

    A count vector says how many shingles of a set fall into each part of the
    hash order; the sum of the differences is at most the number of shingles in
    which two sets differ.  Pairs are looked at here and never become rows
    unless they may link.
    """
    ids, comp, n, block = (table.column(c).to_numpy() for c in ("set_id", "comp", "n", "block"))
    low, high = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("counts").combine_chunks()]
    width = min(map(len, raw))
    counts = np.stack([np.minimum(x.reshape(-1, width).sum(0), 255).astype(np.uint8) for x in raw])
    strip, most = max(1, CELLS_AT_ONCE // len(ids)), max(1, COUNTS_AT_ONCE // width)
    lists = table.column("sigs").combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    sig = lists.flatten().to_numpy()
    by = np.argsort(sig, kind="stable")
    sig, owner = sig[by], owner[by]
    edge = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
    out_a, out_b = [], []
    for at in range(0, len(ids), ROWS_AT_ONCE):
        to = min(at + ROWS_AT_ONCE, len(ids))
        near = np.zeros((to - at, len(ids)), bool)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g = owner[lo:hi]
            mine = g[(g >= at) & (g < to)]
            if len(mine) and hi - lo > 1:
                near[np.ix_(mine - at, g)] = True
        for row in range(0, to - at, strip):
            x, y = np.nonzero(near[row : row + strip])
            x += at + row
            keep = (ids[x] < ids[y]) & (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
            if low != high:  # pairs within one block belong to that block's own task
                keep &= block[x] != block[y]
            x, y = x[keep], y[keep]
            for k in range(0, len(x), most):
                p, q = x[k : k + most], y[k : k + most]
                differ = (np.maximum(counts[p], counts[q]) - np.minimum(counts[p], counts[q])).sum(1, dtype=np.int64)
                may = differ <= (n[p] + n[q]) * (den - num) // (den + num)
                out_a.append(ids[p[may]])
                out_b.append(ids[q[may]])
    return pa.table({"a": np.concatenate(out_a or [ids[:0]]), "b": np.concatenate(out_b or [ids[:0]])})


class Join:
    """A self-join of the texts of docs; see the module."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int):
        self.docs, self.id, self.text, self.k, self.num, self.den = docs, id_col, text, k, num, den
        self.classes = Classes(num, den)
        self.described = save(_described(docs, id_col, text, k), "sets")
        self.sets = self.described.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """One text of each wanted set.  wanted: (set_id), distinct."""
        ids = save(wanted.join(self.sets, "set_id").select("set_id", "least"), "wanted")
        few = sendable(ids, SENT_BYTES)
        right = ids.select("least").distinct()
        on = F.col(f"`{self.id}`").eqNullSafe(F.col("least"))
        return self.docs.select(F.col(f"`{self.id}`"), F.col(f"`{self.text}`")).join(F.broadcast(right) if few else right, on, "left_semi")

    def _possible(self, sized: DataFrame, wanted: DataFrame) -> DataFrame:
        """Pairs that a bound doesn't rule out: bits of one set's map that the other's lacks are differences, each at least one."""
        text, k, num, den = self.text, self.k, self.num, self.den

        def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tb.slices(whole, text, SLICE_BYTES):
                    values, off = shingle_sets(batch.column(text), k)
                    out = []
                    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                        bits = np.zeros(max(64, 1 << (8 * (hi - lo) - 1).bit_length()), bool)
                        bits[(values[lo:hi] & U(len(bits) - 1)).astype(np.int64)] = True
                        out.append(np.packbits(bits, bitorder="little").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, off)), pa.array(out, pa.binary())], ["set_id", "bits"])

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                most, keep = n * (den - num) // (den + num), []
                for x, y, m in zip(batch.column("ma"), batch.column("mb"), most.tolist(), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                    size = min(len(x), len(y))
                    x, y = (v if len(v) == size else np.bitwise_or.reduce(v.reshape(-1, size), 0) for v in (x, y))
                    keep.append(int(np.bitwise_count(x ^ y).sum()) <= m)
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

        found = self._texts(wanted).mapInArrow(returning(maps), "set_id bigint, bits binary").dropDuplicates(["set_id"])
        left, right = (found.select(F.col("set_id").alias(x), F.col("bits").alias(m)) for x, m in (("a", "ma"), ("b", "mb")))
        return sized.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(returning(bound), "a bigint, b bigint, na bigint, nb bigint")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that link.  pairs: (a, b), distinct."""
        size = self.sets.select("set_id", "n")
        sized = pairs.join(size.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
        sized = save(sized.where(F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num), "pairs")
        ends = lambda p: p.select(F.col("a").alias("set_id")).union(p.select("b")).distinct()
        sized = save(self._possible(sized, ends(sized)), "possible")
        release()
        text, k = self.text, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tb.slices(whole, text, SLICE_BYTES):
                    values, off = shingle_sets(batch.column(text), k)
                    owner = np.repeat(np.arange(batch.num_rows), np.diff(off))
                    fragment = (values >> U(61)).astype(np.int64)
                    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])])) if len(values) else np.zeros(0, np.int64)
                    at = np.concatenate([head, [len(values)]])
                    segments = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, off)[owner[head]]), pa.array(fragment[head], pa.int32()), segments], ["set_id", "fragment", "segment"])

        parts = self._texts(ends(sized)).mapInArrow(returning(run), "set_id bigint, fragment int, segment array<bigint>")
        parts = save(parts.dropDuplicates(["set_id", "fragment"]), "segments")
        left = parts.select(F.col("set_id").alias("a"), "fragment", F.col("segment").alias("sa"))
        right = parts.select(F.col("set_id").alias("b"), "fragment", F.col("segment").alias("sb"))
        partial = sized.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("shared"))
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        out = save(summed.where(F.col("shared") * self.den >= (F.col("na") + F.col("nb") - F.col("shared")) * self.num).select("a", "b"), "links")
        drop(out.sparkSession, saved_path(parts))
        release()
        return out

    def _residual(self, groups: DataFrame, comp: DataFrame) -> DataFrame:
        """(a, b): pairs of different components that share a signature and may link.

        Sets are dealt out by the most central set of each signature, which the
        signatures of one family mostly agree on, so a set's counts travel a few
        times and not once a signature.  A large family is cut into blocks of
        about ``BLOCK`` sets, and each pair of blocks is a task.  A set goes to as
        many tasks as its family has blocks, which the disk needn't hold all at
        once: tasks are dealt to waves, and a wave's shuffle goes before the next.
        """
        text, k, num, den = self.text, self.k, self.num, self.den
        rows = groups.join(comp, F.col("set_id") == F.col("node"), "left").select("sig", "set_id", "degree", F.coalesce("component", "set_id").alias("comp"))
        centre = rows.groupBy("sig").agg(F.max(F.struct("degree", "set_id")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        members = rows.join(centre.select("sig", F.col("c.set_id").alias("centre")), "sig").groupBy("centre", "set_id", "comp").agg(F.collect_set("sig").alias("sigs"))
        members = save(members, "members")
        sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tb.slices(whole, text, SLICE_BYTES):
                    values, off = shingle_sets(batch.column(text), k)
                    out = []
                    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                        bits = max(6, (hi - lo - 1).bit_length())
                        out.append(np.minimum(np.bincount((values[lo:hi] & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, off)), pa.array(np.diff(off), pa.int64()), pa.array(out, pa.binary())], ["set_id", "n", "counts"])

        counts = self._texts(members.select("set_id").distinct()).mapInArrow(returning(count), "set_id bigint, n bigint, counts binary").dropDuplicates(["set_id"])
        counts = save(counts, "counts")
        dealt = members.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).join(counts, "set_id")
        size = F.length("counts") + 8 * F.size("sigs")
        sent, once = dealt.agg(F.sum(F.col("blocks") * size)).first()[0] or 0, counts.agg(F.sum(F.length("counts"))).first()[0] or 0
        waves = max(1, -(-sent // max(WAVE_BYTES, once)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        dealt = dealt.select("centre", "lo", "hi", "block", "set_id", "comp", "n", "sigs", "counts")

        def survivors(table: pa.Table) -> pa.Table:
            out = _survivors(table, num, den)
            if table.nbytes >= LEAST:
                give_back()
            return out

        found = None
        for wave in range(waves):
            now = dealt.where(F.pmod(F.xxhash64("centre", "lo", "hi"), F.lit(waves)) == wave)
            now = save(now.groupBy("centre", "lo", "hi").applyInArrow(survivors, "a bigint, b bigint").distinct(), "survivors")
            found = now if found is None else found.union(now)
            release()
        drop(found.sparkSession, saved_path(counts), saved_path(members))
        return found.distinct()

    def _stars(self, groups: DataFrame, comp: DataFrame | None, tried: DataFrame | None) -> DataFrame:
        """(a, b): for each set one other of its signatures, the most central of another component, if they weren't compared before.

        Of all partners that its signatures offer it takes the one offered most often.
        """
        rows = groups
        if comp is None:
            rows = rows.withColumn("comp", F.col("set_id"))
        else:
            rows = rows.join(comp, F.col("set_id") == F.col("node"), "left").select("sig", "set_id", "degree", F.coalesce("component", "set_id").alias("comp"))
        centre = rows.groupBy("sig").agg(F.max(F.struct("degree", "set_id", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        offers = rows.join(centre, "sig").where("comp <> c.comp").groupBy("set_id", F.col("c.set_id").alias("other")).agg(F.count("*").alias("n"))
        pairs = offers.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"), "set_id", "n")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = pairs.groupBy("set_id").agg(F.max(F.struct("n", "a", "b")).alias("p"))
        return best.select("p.a", "p.b").distinct()

    def components(self) -> DataFrame:
        """(doc_id, hash, n, comp, component): a row for each row of docs; comp names the component by its least set, component by its least id."""
        spark = self.docs.sparkSession
        groups = save(_sharing(_signed(self.docs, self.text, self.k, self.classes)), "groups")
        release()
        # A set that shares more signatures is more central: edited copies agree more with their original than with each other.
        shared, groups = groups, save(_needed(groups), "groups")
        drop(spark, saved_path(shared))
        links = tried = None
        comp = spark.createDataFrame([], "node bigint, component bigint")
        for _ in range(STARS):
            stars = save(self._stars(groups, None if links is None else comp, tried), "stars")
            if stars.isEmpty():
                break
            found = self._links(stars)
            links = found if links is None else links.union(found)
            tried = stars if tried is None else tried.union(stars)
            comp = save(connected_components(links, "a", "b"), "comp")
        if links is not None:
            rest = save(self._residual(groups, comp).join(tried, ["a", "b"], "left_anti"), "rest")
            release()
            if not rest.isEmpty():
                links = links.union(self._links(rest))
                comp = save(connected_components(links, "a", "b"), "comp")
        named = self.sets.join(comp, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("component", "set_id").alias("comp"))
        named = save(named, "named")
        least = named.groupBy("comp").agg(F.min("least").alias("component"))
        of_set = named.join(least, "comp").select("set_id", "comp", "component")
        out = self.described.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(of_set, "set_id", "left")
        return out.select("doc_id", "hash", "n", "comp", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n, component) for each row of docs: size of its set, least id that links reach.

    Two texts link if their sets have a Jaccard similarity of num / den or more.
    A null or empty text, or one of white space, has no set, links with nothing
    and is its own component.  A text of fewer than k words has its whole
    sequence as its one shingle.  Equal rows are one set, and each gets its row;
    rows with a null id take part, but a null id is never the least.  An empty
    table gives no rows.  Other columns aren't read.
    """
    return Join(docs, id_col, text, k, num, den).components().select("doc_id", "n", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, its columns unchanged, with one row of each component: that with the least id, a null id after all others.

    Rows without a set (null, empty and blank texts) stay, repeats too.  Rows go
    by id and text: of rows that agree in both one stays, whichever; where one id
    has several texts in a component, that of the least hash.  Other columns may
    be of any type and name.  An empty table stays empty.
    """
    found = save(Join(docs, id_col, text, **{"k": 5, "num": 80, "den": 100} | options).components().where("n > 0").groupBy("doc_id", "hash", "comp").count(), "found")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    placed = found.join(first, "comp").select("doc_id", "hash", "count", stays.alias("stays"))
    of, hashed, nth = free_names(docs, "of", "hashed", "nth")

    def on(keys: DataFrame) -> tuple[DataFrame, Column]:
        same = F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (text_hash(text) == F.col(hashed))
        return F.broadcast(keys) if sendable(keys, SENT_BYTES) else keys, same

    gone = save(placed.where("NOT stays").select(F.col("doc_id").alias(of), F.col("hash").alias(hashed)), "gone")
    again = save(placed.where("stays AND count > 1").select(F.col("doc_id").alias(of), F.col("hash").alias(hashed)), "again")
    kept = docs.join(*on(gone), "left_anti")
    if again.isEmpty():
        return kept
    repeated = kept.join(*on(again), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), text_hash(text)).orderBy(F.lit(1))))
    return kept.join(*on(again), "left_anti").unionByName(repeated.where(F.col(nth) == 1).drop(nth))
