"""What a worker keeps between tasks, and how it gives memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

_holders: dict[str, Callable[[], None]] = {}
_entered = [""]


def holder(name: str, empty: Callable[[], None]) -> None:
    """Something of that name is kept by this worker; `empty` drops it."""
    _holders[name] = empty


def enter(name: str) -> None:
    """From now on only the holder of that name keeps anything; a worker that goes on to other work empties the rest."""
    if _entered[0] != name:
        _entered[0] = name
        release(keep=name)


def release(keep: str = "") -> None:
    """Empties holders and returns free memory to the system."""
    import pyarrow as pa

    for name, empty in _holders.items():
        if name != keep:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library trims by itself
        pass


ROWS = 2_000  # of a batch, where the session has Spark's default of 10,000


def bounded(spark) -> None:
    """Makes batches to and from workers smaller for this session: whole texts in them lie in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))


def task(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run, after which the worker keeps nothing: it may idle beside workers of the next stage."""

    def ending(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return ending
