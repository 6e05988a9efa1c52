"""Fill-in-middle transformation by a parallel automaton scan.

Units of a text (lines, words) are recognised by a small automaton over bytes.
Where a chunk of a text is entered isn't known, so for each state a chunk tells
where it ends and how many units begin in it: a transition function with counts.
Composing these is associative; a prefix composition gives each chunk's entry
state and the units before it, and the chunk in which a wanted unit begins is
the only one that is looked into again.

Texts of up to ``giant`` bytes are chunked, composed and cut where they lie, many
at a time.  Chunks of longer ones are dealt to all tasks: these emit functions,
a text's functions are composed, and the chunks that hold its cuts are joined in
once more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.llm import textbytes as tb
from brindle.llm.scratch import drop, free_names, save, saved_path

#: Bytes of a chunk within a task, of one that is dealt, of text looked at together; and from how many bytes on a text's chunks are dealt.
CHUNK, DEALT, SLICE, GIANT = 256, 256 << 10, 2 << 20, 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """Classes of bytes, and for (class, state) the next state and whether the byte begins a unit; a text starts in state 0."""

    classes: tuple[int, ...]
    next: tuple[tuple[int, ...], ...]
    begins: tuple[tuple[int, ...], ...]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three as arrays, with a last class for padding that changes nothing."""
        states = len(self.next[0])
        step = np.array([*self.next, tuple(range(states))], np.uint8)
        return np.array(self.classes, np.uint8), step, np.array([*self.begins, (0,) * states], np.uint16)


def _classes(*groups: bytes) -> tuple[int, ...]:
    return tuple(next((k + 1 for k, g in enumerate(groups) if b in g), 0) for b in range(256))


#: A line with its end: state 0 before a line, 1 within.
LINES = Automaton(_classes(b"\n"), ((1, 1), (0, 0)), ((1, 0), (1, 0)))
#: A word with the blanks after it; blanks at the start are a unit.  State 0 at the start, 1 within a word, 2 in blanks.
WORDS = Automaton(_classes(b" \t\n\x0b\x0c\r"), ((1, 1, 1), (2, 2, 2)), ((1, 0, 1), (1, 0, 0)))


def _composed(step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of rows of bytes, (rows, bytes, states), by halves: each pair becomes the first, then the second."""
    count = count.astype(np.int64) if step.shape[1] > 60_000 else count
    while step.shape[1] > 1:
        if step.shape[1] % 2:
            same = np.broadcast_to(np.arange(step.shape[2], dtype=step.dtype), (len(step), 1, step.shape[2]))
            step, count = np.concatenate([step, same], 1), np.concatenate([count, np.zeros_like(count[:, :1])], 1)
        first = step[:, 0::2].astype(np.intp)
        count = count[:, 0::2] + np.take_along_axis(count[:, 1::2], first, 2)
        step = np.take_along_axis(step[:, 1::2], first, 2)
    return step[:, 0], count[:, 0].astype(np.int64)


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray, pad: int) -> np.ndarray:
    """The byte classes of each range as a row, with padding behind."""
    width = int((ends - starts).max(initial=1))
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    return np.where(inside, classes[data[np.minimum(at, len(data) - 1)]], np.uint8(pad))


def _sought(rows: np.ndarray, state: np.ndarray, wanted: np.ndarray, step: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where in each row of classes, entered in a state, its wanted-th unit (from 1) begins."""
    state, wanted, out = state.astype(np.intp), wanted.copy(), np.full(len(rows), -1, np.int64)
    for i in range(rows.shape[1]):
        c = rows[:, i]
        wanted -= begins[c, state]
        out[(wanted == 0) & (out < 0)] = i
        state = step[c, state].astype(np.intp)
    return out


def cuts_of(column: pa.Array, low: np.ndarray, high: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the code points before its two cuts (rows, 2); low, high: numbers that, modulo units and one more, tell them."""
    classes, step, begins = automaton.tables()
    pad = len(step) - 1
    data, off = tb.text_bytes(column)
    n_chunks = -(-(off[1:] - off[:-1]) // CHUNK)
    starts = tb.ranges(np.zeros(len(n_chunks), np.int64), n_chunks) * CHUNK + np.repeat(off[:-1], n_chunks)
    ends = np.minimum(starts + CHUNK, np.repeat(off[1:], n_chunks))
    cuts, units = np.zeros((len(n_chunks), 2), np.int64), np.zeros(len(n_chunks), np.int64)
    if not len(starts):
        return units, cuts
    rows = _padded(data, starts, ends, classes, pad)
    ending, count = _composed(step[rows], begins[rows])
    ending, count = ending.tolist(), count.tolist()
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    seek: list[tuple[int, int, int, int, int]] = []
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        state, total, entry, before = 0, 0, [], []
        for c in range(a, b):
            entry.append(state)
            before.append(total)
            total += count[c][state]
            state = ending[c][state]
        units[row] = total
        for side, at in enumerate(sorted((int(low[row]) % (total + 1), int(high[row]) % (total + 1)))):
            if at == total:
                cuts[row, side] = off[row + 1]
            else:
                c = bisect_right(before, at) - 1
                seek.append((row, side, a + c, entry[c], at - before[c] + 1))
    if seek:
        who, side, chunk, state, wanted = np.array(seek, np.int64).T
        cuts[who, side] = starts[chunk] + _sought(rows[chunk], state, wanted, step, begins)
    cuts[units == 0] = off[:-1][units == 0][:, None]
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return units, leads[cuts] - leads[off[:-1]][:, None]


def chunk_function(text: bytes, automaton: Automaton) -> tuple[list[int], list[int], int]:
    """Of a chunk: the state that each state leads to, the units that begin on the way, and its code points."""
    classes, step, begins = automaton.tables()
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return list(range(step.shape[1])), [0] * step.shape[1], 0
    at = np.arange(0, len(data), CHUNK, dtype=np.int64)
    rows = _padded(data, at, np.minimum(at + CHUNK, len(data)), classes, len(step) - 1)
    ending, count = _composed(step[rows], begins[rows])
    ending, count = _composed(ending[None], count[None])
    return ending[0].tolist(), count[0].tolist(), int(((data & 0xC0) != 0x80).sum())


def _chunk_cut(text: bytes, state: int, wanted: int, automaton: Automaton) -> int:
    """Code points of a chunk, entered in a state, before its wanted-th unit."""
    classes, step, begins = automaton.tables()
    data = np.frombuffer(text, np.uint8)
    at = np.arange(0, len(data), CHUNK, dtype=np.int64)
    rows = _padded(data, at, np.minimum(at + CHUNK, len(data)), classes, len(step) - 1)
    ending, count = _composed(step[rows], begins[rows])
    for k in range(len(rows)):
        if count[k][state] >= wanted:
            to = int(at[k]) + int(_sought(rows[k : k + 1], np.array([state]), np.array([wanted]), step, begins)[0])
            return int(((data[:to] & 0xC0) != 0x80).sum())
        wanted -= int(count[k][state])
        state = int(ending[k][state])
    raise ValueError("a chunk has fewer units than its function says")


def _small_cuts(docs: DataFrame, text: str, low: str, high: str, names: list[str], automaton: Automaton) -> DataFrame:
    """docs with units and cuts, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, text, SLICE):
                a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (low, high))
                units, cuts = cuts_of(batch.column(text), a, b, automaton)
                more = [pa.array(x, pa.int64()) for x in (units, cuts[:, 0], cuts[:, 1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))


def _giant_cuts(docs: DataFrame, text: str, low: str, high: str, names: list[str], automaton: Automaton, dealt: int) -> DataFrame:
    """docs with units and cuts, each text's chunks dealt to all tasks.

    A row of Spark holds 2 GB at most, so a text has at most 2**31 / dealt
    functions; these meet in one group, their texts don't.
    """
    (row,) = free_names(docs, "row")
    kept = save(docs.withColumn(row, F.monotonically_increasing_id()), "giants")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view, at, k = memoryview(batch.column(0)[i].as_buffer()), 0, 0
                told = [batch.column(c)[i].as_py() for c in (1, 2, 3)]
                while at < len(view):
                    to = min(at + dealt, len(view))
                    while to < len(view) and view[to] & 0xC0 == 0x80:
                        to += 1
                    yield pa.RecordBatch.from_pylist([dict(zip(("row", "low", "high"), told, strict=True)) | {"k": k, "bytes": bytes(view[at:to])}], chunk_schema)
                    at, k = to, k + 1

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk_function(x.as_py(), automaton) for x in batch.column("bytes")]
            ending, count, chars = ([f[i] for f in found] for i in range(3))
            more = [pa.array(ending, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int64())), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "low", "high", "k")), *more], ["row", "low", "high", "k", "ending", "count", "chars"])

    def composed(group: pa.Table) -> pa.Table:
        """A text's functions composed in order: what stands before each chunk, and in which chunk each cut lies."""
        state, units, chars, before = 0, 0, 0, []
        told = sorted(group.to_pylist(), key=lambda r: r["k"])
        for r in told:
            before.append((units, r["k"], state, chars))
            state, units, chars = r["ending"][state], units + r["count"][state], chars + r["chars"]
        out = []
        for side, at in enumerate(sorted(told[0][c] % (units + 1) for c in ("low", "high"))):
            n, k, entry, ahead = before[bisect_right(before, at, key=lambda x: x[0]) - 1]
            ended = at == units
            out.append((told[0]["row"], side, units, None if ended else k, entry, at - n + 1, chars if ended else ahead))
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(cut_types.items(), zip(*out, strict=True), strict=True)})

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["bytes", "state", "wanted", "ahead"]).to_pylist()
            at = [r["ahead"] + (_chunk_cut(r["bytes"], r["state"], r["wanted"], automaton) if r["bytes"] else 0) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("side"), batch.column("units"), pa.array(at, pa.int64())], ["row", "side", "units", "at"])

    chunk_schema = pa.schema({"row": pa.int64(), "low": pa.int64(), "high": pa.int64(), "k": pa.int32(), "bytes": pa.binary()})
    cut_types = {"row": pa.int64(), "side": pa.int32(), "units": pa.int64(), "k": pa.int32(), "state": pa.int32(), "wanted": pa.int64(), "ahead": pa.int64()}
    parts = kept.select(F.col(f"`{text}`").cast("binary"), row, low, high).mapInArrow(chunked, "row bigint, low bigint, high bigint, k int, bytes binary")
    chunks = save(parts.repartition("row", "k"), "chunks")
    each = chunks.mapInArrow(functions, "row bigint, low bigint, high bigint, k int, ending array<int>, count array<bigint>, chars bigint")
    wanted = save(each.groupBy("row").applyInArrow(composed, "row bigint, side int, units bigint, k int, state int, wanted bigint, ahead bigint"), "wanted")
    inside = wanted.join(chunks.select("row", "k", "bytes"), ["row", "k"], "left")
    at = inside.mapInArrow(located, "row bigint, side int, units bigint, at bigint")
    told = at.groupBy("row").agg(F.max("units").alias(names[0]), F.min("at").alias(names[1]), F.max("at").alias(names[2]))
    told = save(told.withColumnRenamed("row", row), "cuts")
    drop(kept.sparkSession, saved_path(chunks), saved_path(wanted))
    return kept.join(told, row).drop(row)


def transform(
    docs: DataFrame, *, automaton: Automaton = LINES, rate: float = 1.0, spm: float = 0.5, seed: int = 7, id_col: str = "doc_id", text: str = "text", giant: int = GIANT, dealt: int = DEALT, found: str = "fim"
) -> DataFrame:
    """docs with a struct ``fim`` of n, form, prefix_chars, middle_chars and output.

    A text is cut before two of its n units, or at its end, as a hash of seed
    and id says, and put in the order prefix, suffix, middle (psm) or suffix,
    prefix, middle (spm).  It stays plain, with null lengths, if it is empty or
    null (the output is then empty), if it holds one of the markers, or if the
    hash keeps it out of ``rate``.  A null id counts as an empty one.  Repeated
    rows are rows each, columns of any name stay (``fim`` is replaced, under
    that name), and an empty table gives no rows.
    """
    docs = docs.drop(found)
    low, high, kind, order, units, first, second = names = free_names(docs, "low", "high", "kind", "order", "units", "first", "second")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
    dealt_out = docs.withColumns({low: number(0), high: number(1), kind: number(2), order: number(3)})
    size, giant = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)), max(0, giant)
    cut = _small_cuts(dealt_out.where(size <= giant), text, low, high, [units, first, second], automaton)
    cut = cut.unionByName(_giant_cuts(dealt_out.where(size > giant), text, low, high, [units, first, second], automaton, dealt))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = (body == "") | body.rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (F.col(kind) % 100 >= round(100 * rate))
    form = F.when(plain, "plain").when(F.col(order) % 100 < round(100 * spm), "spm").otherwise("psm")
    cut = cut.withColumn(kind, form)
    shaped = F.col(kind) != "plain"
    part = lambda a, b: F.substring(body, (a + 1).cast("int"), (b - a).cast("int"))
    head, mid, tail = part(F.lit(0), F.col(first)), part(F.col(first), F.col(second)), part(F.col(second), F.length(body))
    output = (
        F.when(F.col(kind) == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), mid))
        .when(F.col(kind) == "spm", F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), mid))
        .otherwise(body)
    )
    lengths = F.when(shaped, F.col(first)).alias("prefix_chars"), F.when(shaped, F.col(second) - F.col(first)).alias("middle_chars")
    return cut.withColumn(found, F.struct(F.col(units).alias("n"), F.col(kind).alias("form"), *lengths, output.alias("output"))).drop(*names)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of: its parts lie between the markers, of which it holds each once."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    a, b, c = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)
