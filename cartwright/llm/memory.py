"""Memory of Python workers, which live on after a task and share an executor's memory with its JVM."""

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Blocks of this size and more go back to the system as soon as they are freed.
MAPPED_BYTES = 1 << 18
_MMAP_THRESHOLD = -3  # fixed value: the C library's number for this setting


@functools.cache
def _c_library():
    """The C library, set to map large blocks one by one; None where it isn't GNU's."""
    if not sys.platform.startswith("linux"):
        return None
    library = ctypes.CDLL(None)
    if not hasattr(library, "malloc_trim"):
        return None
    library.mallopt(_MMAP_THRESHOLD, MAPPED_BYTES)
    return library


def release() -> None:
    """Give back what was freed but is kept for later."""
    pa.default_memory_pool().release_unused()
    library = _c_library()
    if library is not None:
        library.malloc_trim(0)


def _held(work: Callable, *arguments):
    _c_library()
    try:
        return work(*arguments)
    finally:
        release()


def released(work: Callable) -> Callable:
    """A group's function that gives back its memory when it is done."""
    return lambda group: _held(work, group)


def released_pair(work: Callable) -> Callable:
    """The same for a function of two groups."""
    return lambda left, right: _held(work, left, right)


def released_batches(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a function from batches to batches, at the end of its task."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        _c_library()
        try:
            yield from work(batches)
        finally:
            release()

    return run
