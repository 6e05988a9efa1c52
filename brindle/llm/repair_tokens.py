"""Token-id archives compressed by a Re-Pair grammar.

Texts are encoded in ascending id order and written in shards.  Within a shard
frequent pairs of symbols are replaced by new nonterminals, round after round,
until no pair is frequent enough or the symbols run out of 16 bits; pairs never
span two texts.  The rules and the length that each nonterminal expands to are
stored, so a text, or any stretch of ids, is decoded without the rest.

File format (little endian), one shard after another:

    magic "RPG1", then six uint32: symbols of the base vocabulary, rules,
    symbols, texts, bytes of a symbol (2 or 4), 0
    rules        uint32[rules][2]   the pair behind each nonterminal
    lengths      uint32[rules]      ids that it expands to
    text ends    uint32[texts]      in symbols
    symbols      uint16 or uint32

Writers name files by attempt, and only those in the committed manifest count:
a task that runs twice leaves no wrong file behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import arrowfs
from brindle.llm import textbytes as tb
from brindle.llm.encoder import shared_encoder, spaced_pieces
from brindle.llm.scratch import new_path, save, shuffle_partitions

MAGIC, HEAD = b"RPG1", struct.Struct("<4s6I")
SHARD_IDS, SLICE_BYTES = 1 << 20, 2 << 20
LEAST = 8
SLOT_BITS = 20


# --- grammar -----------------------------------------------------------------


def _numbers(code: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are among the sorted pairs, and the number of the pair for each of those.

    A table of hashes answers for nearly all; only where two pairs share a slot
    is the pair searched for.
    """
    slot = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    k = table[slot(code)]
    at = np.flatnonzero(k >= 0)
    k = k[at].astype(np.int64)
    other = np.flatnonzero(pairs[k] != code[at])
    k[other] = np.minimum(np.searchsorted(pairs, code[at[other]]), len(pairs) - 1)
    same = pairs[k] == code[at]
    return at[same], k[same]


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes seen so often, ascending, and how often each."""
    ordered = np.sort(code)
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(head, len(ordered)))
    often = count >= least
    return ordered[head[often]], count[often]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, *, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, ends in symbols) of a shard; ends: where texts end.

    In a round all pairs seen ``least`` times or more, the most frequent first as
    far as symbols last, get nonterminals; of overlapping occurrences the left
    ones are replaced.  Rounds go on until no pair is so frequent or symbols run out.

    A pair that wasn't frequent stays so, as its occurrences only get fewer.
    So after the first round only places are looked at whose pair was frequent
    or holds a new nonterminal.
    """
    room = max(0, (1 << 16) - base) if base <= 1 << 16 else (1 << 31) - base
    seq, last = ids.astype(np.int32), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(base, np.int64)
    may = ~last
    while len(seq) > 1 and room:
        places = np.flatnonzero(may[:-1])
        if not len(places):
            break
        code = seq[places].astype(np.int64) << 32
        code |= seq[places + 1]
        pairs, count = _frequent(code, least)
        if not len(pairs):
            break
        found, k = _numbers(code, pairs)
        del code
        places = frequent = places[found]
        if len(pairs) > room:
            chosen = np.zeros(len(pairs), bool)
            chosen[np.lexsort((pairs, -count))[:room]] = True
            places, k = places[chosen[k]], (np.cumsum(chosen) - 1)[k[chosen[k]]]
            pairs = pairs[chosen]
        # Of a run of overlapping occurrences every second one, from the left.
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1] + 1
        start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        hit = (np.arange(len(places)) - start) % 2 == 0
        at, k = places[hit], k[hit]
        met = np.bincount(k, minlength=len(pairs)) > 0
        used, symbol = np.flatnonzero(met), (np.cumsum(met) - 1)[k]
        n = len(lengths)
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        lengths = np.concatenate([lengths, lengths[rules[-1]].sum(1)])
        may[:] = False
        may[frequent] = True
        seq[at] = n + symbol
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last, may = seq[keep], last[keep], may[keep]
        fresh = np.flatnonzero(seq >= n)
        may[fresh] = True
        may[fresh[fresh > 0] - 1] = True
        may &= ~last
        room -= len(used)
    inner = np.flatnonzero(last) + 1
    out_ends = np.zeros(len(ends), np.int64)
    full = np.diff(np.concatenate([[0], ends])) > 0
    out_ends[full] = inner
    out_ends = np.maximum.accumulate(out_ends) if len(out_ends) else out_ends
    return np.concatenate(rules), lengths[base:], seq, out_ends


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids behind symbols."""
    while (deep := symbols >= base).any():
        out = np.repeat(symbols, 1 + deep)
        at = np.flatnonzero(deep) + np.arange(int(deep.sum()))
        pair = rules[symbols[deep] - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


class Shard:
    """A shard as read back; nothing is expanded before it is asked for."""

    def __init__(self, raw: bytes):
        magic, self.base, n_rules, n_symbols, n_texts, width, _ = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size
        take = lambda n, kind: np.frombuffer(raw, kind, n, at)
        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        self.lengths = take(n_rules, "<u4").astype(np.int64)
        at += 4 * n_rules
        self.ends = take(n_texts, "<u4").astype(np.int64)
        at += 4 * n_texts
        self.symbols = take(n_symbols, f"<u{width}")
        sizes = np.ones(n_symbols, np.int64)
        deep = self.symbols >= self.base
        sizes[deep] = self.lengths[self.symbols[deep].astype(np.int64) - self.base]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.text_offsets = self.offsets[np.concatenate([[0], self.ends])]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, by expanding only the symbols that cover them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        lo = int(np.searchsorted(self.offsets, start, "right")) - 1
        hi = int(np.searchsorted(self.offsets, stop, "left"))
        out = expand(self.symbols[lo:hi].astype(np.int64), self.rules, self.base)
        return out[start - self.offsets[lo] : stop - self.offsets[lo]].astype("<u4")

    def text(self, k: int) -> np.ndarray:
        return self.ids(int(self.text_offsets[k]), int(self.text_offsets[k + 1]))


def shard_bytes(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    rules, lengths, symbols, out = compress(ids, ends, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, base, len(rules), len(symbols), len(ends), width, 0)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), out.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


# --- files -------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", end_id: int = 2, pieces=spaced_pieces) -> DataFrame:
    """Writes the ids of all texts under path; the manifest: (part, shard, file, at, size, n_texts, n_ids, ids).

    Rows are dealt out by ranges of the id and written in ascending order of it;
    nulls come first and rows of one id go by their texts' hash.  A null text is
    empty.  Each text gets ``end_id`` after its ids.  Other columns aren't read.
    An empty table gives an empty manifest.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(tokenizer, pieces), TaskContext.get().partitionId()
        base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        uri = f"{path}/{part:06d}-{uuid.uuid4().hex}.rpg"
        where, name = arrowfs.at(uri)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        out, held, ids, place, shard = None, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal out, place, held, ids, shard
            out = out or where.open_output_stream(name, compression=None)
            sizes = np.concatenate([s for _, s in held])
            raw = shard_bytes(np.concatenate([x for x, _ in held]), np.cumsum(sizes), base)
            out.write(raw)
            rows = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([uri]), pa.array([place], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids))]
            place, shard, held, ids = place + len(raw), shard + 1, [], []
            return pa.RecordBatch.from_arrays(rows, ["part", "shard", "file", "at", "size", "n_texts", "n_ids", "ids"])

        full = 0
        for whole in batches:
            for batch in tb.slices(whole, text, SLICE_BYTES):
                flat, off = encoder(batch.column(text))
                sizes = np.diff(off) + 1
                stop = np.cumsum(sizes) - 1
                joined = np.full(len(flat) + len(sizes), end_id, np.uint32)
                body = np.ones(len(joined), bool)
                body[stop] = False
                joined[body] = flat
                held.append((joined, sizes))
                ids.append(batch.column(id_col))
                full += len(joined)
                if full >= SHARD_IDS:
                    full = 0
                    yield flush()
        if held:
            yield flush()
        if out:
            out.close()

    n = shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).repartitionByRange(n, F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text}`")))
    dealt = dealt.sortWithinPartitions(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text}`")))
    return save(dealt.mapInArrow(run, f"part int, shard int, file string, at bigint, size bigint, n_texts bigint, n_ids bigint, ids array<{kind}>"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each text, from the files; start: ids of all texts before it."""
    spark: SparkSession = manifest.sparkSession
    kind = manifest.schema["ids"].dataType.elementType.simpleString()
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    placed = manifest.withColumn("inner", inner).join(before, "part").select("file", "at", "size", "ids", (F.col("before") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = arrowfs.Reader()
        for batch in batches:
            names = batch.column("ids")
            for k, (file, at, size, base) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size", "base")), strict=True)):
                shard = Shard(reader.read(file, at, size))
                crc = [zlib.crc32(shard.text(i).tobytes()) for i in range(len(shard.ends))]
                off = shard.text_offsets
                yield pa.RecordBatch.from_arrays([names[k].values, pa.array(base + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        reader.close()

    return placed.repartition(shuffle_partitions(spark), "file", "at").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def archive(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The texts written into the shared folder and read back."""
    return read(write(docs, new_path(docs.sparkSession, "ids"), tokenizer, **options))
