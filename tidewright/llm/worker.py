"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that are held as Python objects at once.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that few texts are held as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def trim() -> None:
    """Give freed memory back to the system; reused workers would keep it from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop() -> None:
    """Forget what ``kept`` holds."""
    store = sys.modules.get("_tidewright_worker")
    if store is not None and store.__dict__.pop("kept", None) is not None:
        trim()


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()``, or what it returned for ``key`` in an earlier task of this worker.

    One object is kept in all, the last used: what an earlier operator kept is
    freed before the next is made.
    """
    store = sys.modules.setdefault("_tidewright_worker", types.ModuleType("_tidewright_worker")).__dict__
    if store.get("kept", (None,))[0] != key:
        drop()
        store["kept"] = (key, make())
    return store["kept"][1]


class Generations(dict):
    """A memo of ``compute(key)`` with at most about two times ``limit`` entries.

    Reading ``memo[key]`` computes what is missing. When the young generation is
    full it becomes the old one; entries used again move back.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
