"""What a Python worker holds once its task is over.

Spark keeps a worker and hands it to later tasks, also those of other operators: what one
task leaves behind is added to what the next ones need, beside the executor's heap.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system; the C library and Arrow keep it for themselves
    otherwise. Other C libraries than glibc have no such call and are left as they are."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def handing_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, after which the worker hands back what the task had."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
