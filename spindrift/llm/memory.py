"""Memory of the Python workers, which Spark reuses from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give memory that is free back to the system, so that a worker's peaks don't add up over the stages it serves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
