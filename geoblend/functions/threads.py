"""One thread for the linear-algebra library under numpy.

The driver's solves are small. The library's thread pool does not survive the fork that starts Spark's JVM: a solve
large enough to use it then waits for ever. An environment variable would come too late where numpy is loaded already.
"""

from __future__ import annotations

import ctypes

import numpy as np  # noqa: F401  (loads the library)

SETTERS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads")


def use_one_thread() -> bool:
    """Whether such a library was found; elsewhere (no /proc, another library) nothing is done."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return False
    done = False
    for path in paths:
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for name in SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
                break
    return done
