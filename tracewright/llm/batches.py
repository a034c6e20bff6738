"""Batches of rows in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa


def joined(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to some ``rows`` each, whatever size the session hands over."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


#: What workers keep from task to task, by module.
_KEPT = {"encoding": "_encoders", "words": "_encoders", "token_counts": "_models", "line_dedup": "_tables"}


def give_back(owner: str) -> None:
    """At the start of a task of module ``owner``: let go of what this worker keeps for other modules' tasks, and return what is free to the system.

    A worker outlives many stages, and what it keeps of one would lie beside the work of the next; allocators keep freed memory otherwise.
    """
    for name, table in _KEPT.items():
        module = sys.modules.get(f"tracewright.llm.{name}")
        if module is not None and name != owner:
            getattr(module, table).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
