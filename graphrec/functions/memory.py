"""Memory of Python workers, which go on from stage to stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns to the system what this process no longer uses: the next stage's task in the same process would find it taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches, with give_back() once it has ended: its last batch and all else it held are free by then, which inside run they are not."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole
