"""Memory that Python workers give back between tasks. Spark reuses workers, so what one operator leaves stays beside the next."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def trim() -> None:
    """Returns free memory of Python, Arrow and the C library to the system."""
    gc.collect()
    release()


def release() -> None:
    """Returns free memory of Arrow and the C library to the system; cheap enough for every batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that drops the encoders' caches of earlier tasks, and trims memory after each of its batches and when it ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        from brindle.llm import bpe

        if bpe.encoder.cache_info().currsize or bpe.merge_counter.cache_info().currsize:
            bpe.encoder.cache_clear()
            bpe.merge_counter.cache_clear()
            trim()
        yield from run(_released(batches))
        trim()

    return task


def _released(batches: Iterator) -> Iterator:
    for batch in batches:
        yield batch
        del batch
        release()
