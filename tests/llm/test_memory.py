"""What a Python worker keeps between tasks."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import ngram_join

#: Three tasks of one worker over two megabytes of text each, by the function that mapInArrow gets; the private MB after each.
WORKER = """
import random, re, sys, types
import numpy, pyarrow as pa, public_tokenizers
from pyspark.sql import types as T
from brindle.llm import complement_pack, ngram_join

class Docs:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    select = lambda self, *_: self
    mapInArrow = lambda self, run, _: run

for m in (complement_pack, ngram_join):
    m.F = types.SimpleNamespace(col=lambda _: None)
run = {"pack": lambda: complement_pack.pieces_of(Docs(), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, "doc_id", "text"), "sign": lambda: ngram_join._signed(Docs(), "text", 5, ngram_join.Classes(80, 100))}[sys.argv[1]]()
rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(60_000)]

def task(k):
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k * 1000 + i for i in range(1000)], "text": [" ".join(rng.choices(words, k=600)) for _ in range(1000)]}) for _ in range(1)]
    rows = sum(x.num_rows for x in run(iter(batches)))
    assert rows
    del batches
    print(sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024, end=" ")

for k in range(3):
    task(k)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
@pytest.mark.parametrize(("what", "most"), [("pack", 130), ("sign", 100)])
def test_worker_gives_memory_back(what, most):
    """A worker between tasks holds little beside its modules; the freed arrays of a task would be half as much again or more."""
    got = list(map(int, subprocess.run([sys.executable, "-c", WORKER, what], capture_output=True, text=True, check=True, timeout=300).stdout.split()))
    assert len(got) == 3 and max(got) <= most, got


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
@pytest.mark.parametrize(("what", "most"), [("pack", 110), ("sign", 88)])
def test_worker_stays_small_over_many_short_tasks(what, most):
    """Tasks of less than a megabyte, one after another, add nothing to what a worker holds between them."""
    short = WORKER.replace("range(1000)", "range(200)").replace("range(3)", "range(9)")
    got = list(map(int, subprocess.run([sys.executable, "-c", short, what], capture_output=True, text=True, check=True, timeout=300).stdout.split()))
    assert len(got) == 9 and max(got) <= most, got


def test_blocks_are_compared_in_bounded_memory():
    """Long texts, many signatures in common: the pairs are those of one comparison each, in few megabytes beside the counts."""
    rng, rows, width = np.random.default_rng(3), 600, 4096
    base = rng.integers(0, 3, width)
    counts = [(base + (rng.random(width) < share)).astype(np.uint8) for share in rng.random(rows)]
    sigs = [sorted(rng.choice(100, 20, replace=False).tolist()) for _ in range(rows)]
    n, ids, comp, block = np.array([int(c.sum()) for c in counts]), rng.permutation(rows) * 7, rng.integers(0, rows // 2, rows), rng.integers(0, 2, rows)
    table = pa.table({"lo": [0] * rows, "hi": [1] * rows, "block": block, "set_id": ids, "comp": comp, "n": n, "sigs": pa.array(sigs, pa.list_(pa.int64())), "counts": pa.array([c.tobytes() for c in counts], pa.binary())})
    tracemalloc.start()
    out = ngram_join._survivors(table, 80, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = set()
    for x in range(rows):
        for y in range(rows):
            if ids[x] < ids[y] and comp[x] != comp[y] and block[x] != block[y] and min(n[x], n[y]) * 100 >= max(n[x], n[y]) * 80 and set(sigs[x]) & set(sigs[y]):
                if int(np.abs(counts[x].astype(int) - counts[y]).sum()) <= (n[x] + n[y]) * 20 // 180:
                    wanted.add((int(ids[x]), int(ids[y])))
    got = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    assert wanted and len(got) == len(set(got)) and set(got) == wanted
    assert most < 40 << 20, most
