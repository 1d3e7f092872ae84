"""Vectorised tokenising over Arrow string columns.

Texts are joined into one byte buffer (a newline between neighbours), classified
through a 256-entry table, and every token gets a 64-bit hash from prefix sums,
so no Python object is made per token.  Memory is bounded by ``CHUNK_BYTES`` or
one text, whichever is larger, and given back after each batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .runtime import arrow_strings

CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93 | 1

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits and every byte of a non-ASCII character.
WORDY = np.zeros(256, dtype=bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = True
WORDY[128:] = True

#: Everything but the space and bytes 9 to 13.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the hash is usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    size = 1 << max(21, int(n).bit_length())
    return _powers(size, base)[:n]


@dataclass
class Chunk:
    """Some neighbouring texts of a batch, joined by newlines."""

    first: int
    data: np.ndarray
    #: byte offset of each text in ``data``, and one past the last newline
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back: workers live on between stages and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    column = arrow_strings(column)
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, side="right")) - 1)
        j = min(j, n)
        buf = b"\n".join([view[o[k] : o[k + 1]] for k in range(i, j)]) + b"\n"
        yield Chunk(i, np.frombuffer(buf, dtype=np.uint8), o[i : j + 1] - o[i] + np.arange(j - i + 1))
        i = j
    release()


def spans(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of member bytes."""
    inside = member[data].view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    # byte + 1: a run of zero bytes differs from a shorter one
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, _P), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n, _PINV)[starts])


def owners(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """Index within the chunk of the text that holds each span."""
    return np.searchsorted(chunk.offsets, starts, side="right") - 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte offset (one longer than ``data``)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the text of each.

    A text of fewer than ``k`` words, but at least one, has its whole word
    sequence as its only shingle.  Shingles are in text order, not distinct.
    """
    counts = np.bincount(owner, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)))
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(_Q) + words[i : len(words) - k + 1 + i]
        whole = owner[: len(h)] == owner[k - 1 :]
        h, own = mix(h + np.uint64(k))[whole], owner[: len(whole)][whole]
    else:
        h, own = np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            more = counts[short] > i
            at = first[short[more]] + i
            extra[more] = extra[more] * np.uint64(_Q) + words[at]
        h = np.concatenate((h, mix(extra + counts[short].astype(np.uint64))))
        own = np.concatenate((own, short.astype(own.dtype)))
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return h, own


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) over the pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
