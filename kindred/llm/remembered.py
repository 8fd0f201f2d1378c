"""One memory of past results per worker process.

Codecs remember what they have encoded. Workers are reused from stage to stage, so whoever starts to remember makes
the one before forget, and operators that remember nothing make all forget before they begin: what a process holds is
bounded by one memory, not by their number.
"""

from __future__ import annotations

import ctypes
import gc

_owner = None


def claim(owner) -> None:
    """owner has forget(); it is called once another owner claims."""
    global _owner
    if _owner is not owner:
        forget()
        _owner = owner


def forget() -> None:
    """The memory there is goes, and what it took returns to the machine."""
    global _owner
    if _owner is not None:
        _owner.forget()
        _owner = None
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what it has for later use
            return
