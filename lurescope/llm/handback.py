"""Memory of Python workers between tasks.

A worker serves one task after another and stays when a stage ends. What a task freed stays with the worker, as free
space of its allocators, beside the workers of the next stage; here it goes back to the machine when the task is done.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return free memory of Arrow and of the C library, where that can be asked for, to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Run) -> Run:
    """A ``mapInArrow`` function that gives free memory back at the end of its task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
