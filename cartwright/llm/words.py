"""Words of whole texts as arrays of 64-bit hashes.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes come from prefix sums over the bytes, so their cost does not depend on the
number of Python objects, and a text of any length is read in pieces.
"""

import re

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = re.compile(rb"[\t-\r ]")
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * _MIX_1
    h = (h ^ (h >> np.uint64(33))) * _MIX_2
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_PIECE * 2, 1 << max(n - 1, 1).bit_length())
    if size not in _powers:
        ups = np.full(size, _BASE, np.uint64)
        downs = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        ups[0] = downs[0] = 1
        tables = np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)
        if size > _PIECE * 2:
            return tables  # for one word of megabytes; not kept
        _powers[size] = tables
    return _powers[size]


def _piece_words(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a piece that ends at a word's end."""
    codes = np.frombuffer(piece, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_BLANK[codes]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[0::2], turns[1::2]
    up, down = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[codes] * up[: len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * _STEP), starts, ends


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of ``hashed_words``, in a third of its memory."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    joined, texts = b"\n".join(texts), None
    counts = np.zeros(len(ends), np.int64)
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(joined):
        cut = _BLANKS.search(joined, min(at + _PIECE, len(joined)))
        to = cut.start() if cut else len(joined)
        hashes, starts, _ = _piece_words(joined[at:to])
        parts.append(hashes)
        low = np.searchsorted(ends, at, "right")  # the texts of this piece
        high = np.searchsorted(ends, to, "right") + 1
        counts[low:high] += np.diff(np.searchsorted(starts, ends[low:high] - at), prepend=0)
        at = to + 1
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, starts, ends): text i has the words offsets[i] to offsets[i + 1]; starts
    and ends are byte positions in the texts joined by one line feed."""
    joined = b"\n".join(texts)
    parts, at = [], 0
    while at < len(joined):
        cut = _BLANKS.search(joined, min(at + _PIECE, len(joined)))
        to = cut.start() if cut else len(joined)
        h, s, e = _piece_words(joined[at:to])
        parts.append((h, s + at, e + at))
        at = to + 1
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return hashes, np.searchsorted(starts, begins).astype(np.int64), starts, ends


def text_of_word(offsets: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for all positions with n words to come."""
    count = max(len(hashes) - n + 1, 0)
    h = np.full(count, n, np.uint64)
    for j in range(n):
        h = h * _STEP + hashes[j : j + count]
    return mixed(h)


def encoded(texts, lower: bool = False) -> list[bytes]:
    """UTF-8 of the texts, nulls as empty ones; ``lower`` changes A to Z only."""
    out = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    return [t.lower() for t in out] if lower else out
