"""Memory of Python workers, which Spark keeps for the tasks of later stages."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to return free memory to the system, where there is one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    """Return what is free to the system, so that idle workers do not add up beside the executor."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back when the task ends."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
