"""What functions in Python workers share."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their task, and what
    they hold meanwhile counts for the executor that runs the next one. Only the GNU C
    library can trim; elsewhere only Arrow's pool is released."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
