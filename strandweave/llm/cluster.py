"""Storage and shipping, shared with the rest of the package; workers that give memory back; the tokenizers' threads, one a worker."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..storage import Workspace, shared_dir, ship, shuffle_partitions

__all__ = ["Workspace", "shared_dir", "ship", "shuffle_partitions", "trimmed"]

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def trimmed(work: Callable) -> Callable:
    """The same work, after which the worker gives free memory back: it idles next to the executor's JVM, or does other work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
