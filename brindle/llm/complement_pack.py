"""Best-fit packing by exact-complement hashing.

Only lengths matter to the packing, and there are at most ``capacity`` of them,
so the plan is made from a histogram.  Single, pair and triple sums of the lengths
are indexed by sum.  For the longest length left the gap is looked up there, and a
combination that fills it exactly is consumed, as often as counts allow;
where none does, place the best-fitting length and look again.  A plan is a
list of templates (lengths, how often); each step uses up a length or a
combination, so their number depends on the capacity and not on the corpus.

The pieces are then numbered within their length without a global sort (counts
of each task, prefix sums of those) and each takes its slot.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import textbytes as tb
from brindle.llm.encoder import Encoder, byte_level_pieces
from brindle.llm.memory import returning
from brindle.llm.scratch import save

SLICE_BYTES = 2 << 20


class Complements:
    """Which lengths are left, and an index of the pairs and triples of them by their sum.

    An entry is named by its longest part: a pair's other part follows from it,
    and a triple's other two are a pair of the rest.  Counts only fall, so an
    entry that is found used up is taken out for good; a sum's list is made when
    it is first asked for.  There are at most capacity**2 / 2 entries of a kind.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, top = counts.copy(), len(counts) - 1
        lengths = np.flatnonzero(counts[1:]) + 1
        i, j = np.tril_indices(len(lengths))
        long, total = lengths[i], lengths[i] + lengths[j]
        self.pairs = self._by_sum(total[total <= top], long[total <= top], top)
        #: Of each sum the least longest part: a triple's pair must not have a longer part than the triple.
        least = np.full(top + 1, top + 1)
        np.minimum.at(least, total[total <= top], long[total <= top])
        sums = np.flatnonzero(least <= top)
        long, rest = np.repeat(lengths, len(sums)), np.tile(sums, len(lengths))
        use = (long + rest <= top) & (least[rest] <= long)
        self.triples = self._by_sum((long + rest)[use], long[use], top)

    @staticmethod
    def _by_sum(total: np.ndarray, long: np.ndarray, top: int) -> dict[int, np.ndarray | list[int]]:
        """For each sum the longest parts, ascending."""
        by = np.lexsort((long, total))
        total, long = total[by], long[by].astype(np.int32)
        edge = np.searchsorted(total, np.arange(top + 2))
        return {x: long[edge[x] : edge[x + 1]] for x in np.unique(total).tolist()}

    def _listed(self, index: dict, total: int) -> list[int]:
        found = index.get(total, [])
        if isinstance(found, np.ndarray):
            found = index[total] = found.tolist()
        return found

    def _fits(self, parts: list[int]) -> bool:
        return all(self.counts[x] >= parts.count(x) for x in set(parts))

    def exact(self, gap: int) -> list[int] | None:
        """Lengths, three at most, whose sum is the gap: one before two before three, with the longest first."""
        if self.counts[gap] > 0:
            return [gap]
        pairs = self._listed(self.pairs, gap)
        while pairs:
            if self._fits([pairs[-1], gap - pairs[-1]]):
                return [pairs[-1], gap - pairs[-1]]
            pairs.pop()
        triples = self._listed(self.triples, gap)
        while triples:
            found = self._with_pair(triples[-1], gap - triples[-1])
            if found:
                return found
            triples.pop()
        return None

    def _with_pair(self, x: int, rest: int) -> list[int] | None:
        """x and the first pair of that sum, none of it longer than x, that fits beside it."""
        if not self.counts[x]:
            return None
        pairs = self._listed(self.pairs, rest)
        for at in range(bisect.bisect_right(pairs, x) - 1, -1, -1):
            y = pairs[at]
            if self._fits([x, y, rest - y]):
                return [x, y, rest - y]
            if not self._fits([y, rest - y]):
                del pairs[at]
        return None

    def best(self, gap: int) -> int | None:
        """The longest length that fits."""
        at = np.flatnonzero(self.counts[1 : gap + 1] > 0)
        return int(at[-1]) + 1 if len(at) else None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Templates (lengths in order, sequences of it) that use up counts[1:]; the capacity is len(counts) - 1."""
    left, capacity, out = Complements(counts), len(counts) - 1, []
    for length in range(capacity, 0, -1):
        while left.counts[length] > 0:
            parts, gap = [length], capacity - length
            left.counts[length] -= 1
            taken = [length]
            while gap:
                more = left.exact(gap)
                if more is None:
                    one = left.best(gap)
                    if one is None:
                        break
                    more = [one]
                for x in more:
                    left.counts[x] -= 1
                taken += more
                parts += more
                gap -= sum(more)
            uses = {x: parts.count(x) for x in set(parts)}
            again = min(int(left.counts[x]) // u for x, u in uses.items())
            for x, u in uses.items():
                left.counts[x] -= again * u
            out.append((parts, 1 + again))
    return out


def slots(templates: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its slots as runs in order: (first number within the length, first sequence, sequences, offset)."""
    runs: dict[int, list] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for parts, times in templates:
        at = 0
        for x in parts:
            runs.setdefault(x, []).append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, task, nth): the pieces, numbered within task and length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer, byte_level_pieces), uuid.uuid4().hex
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in tb.slices(whole, text, SLICE_BYTES):
                flat, off = encoder(batch.column(text))
                sizes = np.diff(off) + 1
                joined = np.full(len(flat) + len(sizes), end_id, "<u4")
                body = np.ones(len(joined), bool)
                body[np.cumsum(sizes) - 1] = False
                joined[body] = flat
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), number)
                piece = tb.ranges(np.zeros(len(sizes), np.int64), number)
                first = sizes - (number - 1) * capacity  # only the first piece may be shorter
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                crc = [zlib.crc32(joined[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(length[by]) > 0])) if len(by) else by
                within = np.empty(len(by), np.int64)
                within[by] = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
                nth = seen[length] + within
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([task] * len(doc)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(returning(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task string, nth bigint")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    A null or empty text is one piece with the end id alone.  Repeated rows are
    packed each; ids may repeat or be null.  An empty table gives no pieces.
    Other columns aren't read.  The driver gets a histogram of at most
    ``capacity`` lengths; executors get the templates, as bounded.
    """
    cut = save(pieces_of(docs, tokenizer, capacity, end_id, id_col, text), "pieces")
    per_task = cut.groupBy("length", "task").count()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    places = slots(plan(counts), capacity)
    before = per_task.select("length", "task", (F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                first, seq, at = places[int(length[part[0]])]
                k = np.searchsorted(first, nth[part], "right") - 1
                sequence[part], offset[part] = seq[k] + nth[part] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return cut.join(before, ["length", "task"]).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
