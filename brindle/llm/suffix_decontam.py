"""Benchmark decontamination by suffix arrays over training shards.

Training documents are read in shards of bounded size.  For each shard the
word suffixes that can match at all (those that start with a k-word sequence
of the benchmark, k being the shortest window) are sorted into a suffix array
by prefix doubling; every test suffix of the benchmark is binary-searched in
it.  That gives every verbatim match with its place; matches one word apart on
one diagonal are chained into the longest ones.  Leaving out suffixes that
start with no benchmark sequence loses no match and keeps the arrays small.

The benchmark is a stated query set.  Tasks write it into the shared folder in
blocks of ``block_bytes`` of text; the driver gets their names.  One narrow pass
over the documents reads them: a task holds some shards (``HELD_BYTES``) and one
block at a time, so neither plan nor memory grows with the benchmark.

Words and windows are compared by 64-bit hashes: two different ones among n meet
with probability n**2 / 2**65.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import arrowfs
from brindle.llm import textbytes as tb
from brindle.llm.memory import returning
from brindle.llm.scratch import new_path

WINDOW, RATIO = 13, 20
SHARD_BYTES, BLOCK_BYTES, HELD_BYTES = 3 << 20, 8 << 20, 64 << 20
FOUND = "__found"
_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())), T.StructField("longest", T.ArrayType(_MATCH)),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ("items", pa.list_(pa.string())), ("hit_from", pa.list_(pa.int64())), ("hit_to", pa.list_(pa.int64())),
    ("longest", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
])


class Block:
    """The windows of a block of benchmark items, each different one once, as test suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw, off = tb.text_bytes(pa.array([t for _, t in items], pa.large_string()))
        data = tb.LOWER[raw]
        s, e, first = tb.runs(data, off, tb.ALNUM)
        self.words = tb.run_hashes(data, s, e)
        self.names = [n for n, _ in items]
        n = np.diff(first)
        size = np.minimum(n, window)
        per = np.where(n > 0, n - size + 1, 0)
        #: One entry for each window of each item: item, first word within it, place among all words.
        item = np.repeat(np.arange(len(items)), per)
        within = tb.ranges(np.zeros(len(items), np.int64), per)
        at, length = first[:-1][item] + within, size[item]
        self.shortest = int(size[size > 0].min()) if len(at) else 0
        self.longest = int(size.max()) if len(at) else 0
        if not len(at):
            return
        key = np.zeros(len(at), np.uint64)
        for k in np.unique(length):
            of = length == k
            key[of] = tb.gram_hashes(self.words, int(k))[at[of]]
        order = np.argsort(key, kind="stable")
        _, start, count = np.unique(key[order], return_index=True, return_counts=True)
        self.item, self.within = item[order], within[order]
        self.start, self.count = start, count
        self.at, self.length = at[order][start], length[order][start]
        head = tb.gram_hashes(self.words, self.shortest)
        self.head = head[self.at]
        self.heads = np.unique(self.head)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.heads >> np.uint64(48)).astype(np.int64)] = True


def suffix_array(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``values``, right to ``depth`` values at least, by prefix doubling; and the values' ranks."""
    distinct, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    n, k = len(values), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        key = rank * np.int64(n + len(distinct) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        rank, k = new, 2 * k
        if k >= min(depth, n) or rank.max() == n:
            return order, distinct


def search(values: np.ndarray, order: np.ndarray, query: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in ``order`` of the suffixes of ``values`` that start with ``length`` values of ``query`` from ``at``: a binary search for all test suffixes at once.

    Values are compared as unsigned numbers, the order of ``suffix_array``; an end sorts before any value.
    """
    n, bounds = len(values), []
    for upper in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            p = order[np.minimum(mid, len(order) - 1)]
            less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
            for j in range(int(length.max())):
                live = equal & (j < length)
                if not live.any():
                    break
                ended = p + j >= n
                x, y = values[np.minimum(p + j, n - 1)], query[np.minimum(at + j, len(query) - 1)]
                less |= live & (ended | (x < y))
                equal &= ~live | (~ended & (x == y))
            right = less | (equal if upper else False)
            lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def shard_matches(block: Block, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word) of every occurrence of a window of the block in a shard; first: each document's first word."""
    k = block.shortest
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = tb.gram_hashes(words, k)
    if not len(head):
        return none
    maybe = np.flatnonzero(block.seen[(head >> np.uint64(48)).astype(np.int64)])
    maybe = maybe[np.isin(head[maybe], block.heads)]
    doc_of = np.searchsorted(first, maybe, "right") - 1
    maybe = maybe[maybe + k <= first[doc_of + 1]]
    if not len(maybe):
        return none
    # What is covered by such sequences, with a value that no word has between stretches that aren't neighbours.
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, maybe, 1)
    np.add.at(cover, maybe + k, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]))
    apart = np.zeros(len(words) + 1, bool)
    apart[first] = True
    cut = np.concatenate([[True], (kept[1:] != kept[:-1] + 1) | apart[kept[1:]]])
    place = np.arange(len(kept)) + np.cumsum(cut) - 1
    stretch = np.zeros(place[-1] + 1, np.uint64)
    back = np.full(len(stretch), -1, np.int64)
    stretch[place], back[place] = np.maximum(words[kept], np.uint64(1)), kept
    order, _ = suffix_array(stretch, block.longest + 1)
    starts = np.zeros(len(words), bool)
    starts[maybe] = True
    order = order[(back[order] >= 0) & starts[back[order]]]
    asked = np.flatnonzero(np.isin(block.head, head[maybe]))
    lo, hi = search(stretch, order, np.maximum(block.words, np.uint64(1)), block.at[asked], block.length[asked])
    return np.repeat(asked, hi - lo), back[order[tb.ranges(lo, hi - lo)]]


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint stretches that cover the same words as the stretches from a to b."""
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]


def _longest(block: Block, item: np.ndarray, word: np.ndarray, within: np.ndarray, length: np.ndarray) -> list[dict]:
    """For each item the longest chain of matches along one diagonal, the first of equals."""
    by = np.lexsort((word, word - within, item))
    i, w, j, n = item[by], word[by], within[by], length[by]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (w[1:] - j[1:] != w[:-1] - j[:-1]) | (w[1:] != w[:-1] + 1)])
    head = np.flatnonzero(new)
    size = np.concatenate([head[1:], [len(i)]]) - head - 1 + n[head]
    best: dict[str, dict] = {}
    for h, z in zip(head.tolist(), size.tolist(), strict=True):
        name = block.names[i[h]]
        if name not in best or z > best[name]["n_words"]:
            best[name] = {"item_id": name, "item_word": int(j[h]), "doc_word": int(w[h]), "n_words": z}
    return [best[x] for x in sorted(best)]


def _shard(block: Block | None, batch: pa.RecordBatch, text: str, ratio: int, found: pa.Array | None = None) -> pa.Array:
    """What a block finds in a shard, with what earlier blocks found."""
    raw, off = tb.text_bytes(batch.column(text))
    data = tb.LOWER[raw]
    s, e, first = tb.runs(data, off, tb.ALNUM)
    counts = np.diff(first)
    old = [None] * batch.num_rows if found is None else found.to_pylist()
    nothing = hashlib.sha256(b"").hexdigest()
    out = [x or {"n_words": int(n), "n_hit": 0, "n_items": 0, "items_sha256": nothing, "contaminated": False, "items": [], "hit_from": [], "hit_to": [], "longest": []} for x, n in zip(old, counts.tolist(), strict=True)]
    window, word = shard_matches(block, tb.run_hashes(data, s, e), first) if block else (np.zeros(0, np.int64),) * 2
    if len(word):
        doc = np.searchsorted(first, word, "right") - 1
        by = np.argsort(doc, kind="stable")
        window, word, doc = window[by], word[by], doc[by]
        for d, lo, hi in zip(*np.unique(doc, return_index=True), [*np.flatnonzero(np.diff(doc)) + 1, len(doc)], strict=True):
            row, win, w = out[d], window[lo:hi], word[lo:hi] - first[d]
            a, b = _merged(np.concatenate([row["hit_from"], w]).astype(np.int64), np.concatenate([row["hit_to"], w + block.length[win]]).astype(np.int64))
            each = tb.ranges(block.start[win], block.count[win])
            items = sorted({block.names[i] for i in np.unique(block.item[each]).tolist()} | set(row["items"]))
            chains = _longest(block, block.item[each], np.repeat(w, block.count[win]), block.within[each], np.repeat(block.length[win], block.count[win]))
            best = {x["item_id"]: x for x in row["longest"]}
            for x in chains:
                if x["item_id"] not in best or x["n_words"] > best[x["item_id"]]["n_words"]:
                    best[x["item_id"]] = x
            hit = int((b - a).sum())
            out[d] = {"n_words": row["n_words"], "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": hit > 0 and ratio * hit >= row["n_words"], "items": items, "hit_from": a.tolist(), "hit_to": b.tolist(), "longest": [best[x] for x in sorted(best)]}
    return pa.array(out, _ARROW)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int) -> list[str]:
    """Writes the items as blocks of bounded size into the shared folder, from tasks; the files' names."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("name"), F.col(f"`{item_text}`").cast("string").alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = new_path(benchmark.sparkSession, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(items: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            block = Block(items, window)
            if block.shortest:
                uri = f"{folder}/{uuid.uuid4().hex}.block"  # an attempt's own; only names that arrive are read
                where, name = arrowfs.at(uri)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                with where.open_output_stream(name, compression=None) as out:
                    out.write(pickle.dumps(block))
                yield pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

        held, n = [], 0
        for batch in batches:
            for item in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append(item)
                n += len(item[1])
                if n >= most:
                    yield from written(held)
                    held, n = [], 0
        if held:
            yield from written(held)

    return sorted(r["file"] for r in rows.repartition(max(1, -(-size // most))).mapInArrow(run, "file string").collect())


def _read_block(uri: str) -> Block:
    where, name = arrowfs.at(uri)
    with where.open_input_file(name) as f:
        return pickle.loads(f.read())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, ratio: int = RATIO, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with a struct column ``__found``: words, hit words, items with occurring windows, verdict, hit stretches and longest matches.

    Each row is judged for itself, so repeated rows and equal or null ids each
    get a row.  A null or empty text has no words and is clean; an empty
    benchmark hits nothing; benchmark rows with a null id or text are no items,
    and rows of one id are one item.  Other columns, whatever their names, pass
    through (``__found`` alone is reserved).
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(FOUND, _FOUND)])
    names = docs.columns

    files = _blocks(benchmark, item_id, item_text, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _read_block(files[0]) if len(files) == 1 else None

        def judged(shards: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [None] * len(shards) if files else [_shard(None, x, text, ratio) for x in shards]
            for uri in files:
                block = only or _read_block(uri)
                found = [_shard(block, x, text, ratio, old) for x, old in zip(shards, found, strict=True)]
            for x, each in zip(shards, found, strict=True):
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), each], [*names, FOUND])

        held, size = [], 0
        for whole in batches:
            for batch in tb.slices(whole, text, shard_bytes):
                held.append(batch)
                size += batch.nbytes
                if len(files) < 2 or size >= HELD_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        if held:
            yield from judged(held)

    return docs.mapInArrow(returning(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, its columns unchanged, without the contaminated ones."""
    return find_contamination(docs, benchmark, **options).where(~F.col(f"{FOUND}.contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))
