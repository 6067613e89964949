"""Matrix products of a task on the task's own core."""

from __future__ import annotations

import ctypes
from functools import lru_cache

# Names that builds of the library give the function.
_NAMES = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_")


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Products in this process use one thread from now on: Spark runs a task on every core already.

    Else the library's threads spin between short products, which doubles the CPU time
    or worse.  Without a known library nothing changes and the answer is False.
    """
    try:
        with open("/proc/self/maps", encoding="utf-8", errors="replace") as f:
            paths = {line.split(maxsplit=5)[5].strip() for line in f if "openblas" in line.lower()}
    except OSError:
        return False
    done = False
    for path in paths:
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for name in _NAMES:
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
    return done
