"""Memory that Python workers give back between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _trim = None


def give_back() -> None:
    """Return unused memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, giving what its task no longer uses back to the system at its end.

    Spark keeps workers for later tasks, other queries' too; without this, an idle one
    holds the most that any task needed.
    """

    def task(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            give_back()

    return task
