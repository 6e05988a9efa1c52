"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of input from which a task has left enough behind for its return to be worth a millisecond.
LEAST = 1 << 16


def give_back() -> None:
    """Returns freed memory to the system, Arrow's and, where it can, the C library's: an idle worker holds it else, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, as ``mapInArrow`` takes it; when it has ended, and its own objects are gone, freed memory is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for batch in batches:
                size += batch.nbytes
                yield batch

        yield from run(counted())
        if size >= LEAST:
            give_back()

    return whole
