"""Vectorised text primitives: one pass of numpy over the bytes of many texts.

Every operator of this package that looks at words does it here, so that no
Python loop runs per word. A *word* is a maximal run of letters, digits and
non-ASCII bytes; ASCII letters are folded to lower case. Word hashes are
64-bit and depend on content only, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
ROWS = 1 << 16
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 2**64))
_POW = {"n": 0, "up": None, "down": None}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
        _POW["n"] = size
    return _POW["up"][:n], _POW["down"][:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, by prefix sums modulo 2**64."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, rows) slices of about `most` bytes and ROWS rows at most; a longer text is a slice of its own."""
    _, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1), i + ROWS, n)
        yield i, j - i
        i = j


class Words:
    """The words of some texts: hash, byte span, and each text's range of words."""

    def __init__(self, column: pa.Array, fold: bool = True) -> None:
        self.raw, self.offsets = raw, offsets = buffers(column)
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = _WORD[raw]
        first = np.empty(len(raw), dtype=bool)
        if len(raw):
            first[0] = inside[0]
            np.greater(inside[1:-1], inside[:-2], out=first[1:])
            cut = offsets[1:-1]
            cut = cut[cut < len(raw)]
            first[cut] = inside[cut]
            last = np.greater(inside[:-1], inside[1:])
            ends_at = offsets[1:-1] - 1
            ends_at = ends_at[ends_at >= 0]
            last[ends_at] = inside[ends_at]
            self.starts = np.flatnonzero(first)
            self.ends = np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.hash = span_hash((_BYTE_LOWER if fold else _BYTE)[raw], self.starts, self.ends)
        #: Text i has the words bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix_sums(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(sums, factors), from which the hash of the bytes from a to b is mix((sums[b] - sums[a]) * factors[a] + b - a)."""
    up, down = _powers(len(w.raw) + 1)
    total = np.zeros(len(w.raw) + 1, dtype=U64)
    np.cumsum(_BYTE_LOWER[w.raw] * up[:-1], out=total[1:])
    return total, down


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; one entry per position, the last n - 1 meaningless."""
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    out = np.zeros(len(hashes), dtype=U64)
    if len(hashes) >= n:
        m = len(hashes) - n + 1
        out[:m] = mix((total[n:] - total[:m]) * down[:m])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = counts > 0
    starts, counts = np.asarray(starts, dtype=np.int64)[keep], counts[keep]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    step[np.cumsum(counts)[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(step)


def release() -> None:
    """Gives memory that this worker has no more use for back to the system; idle workers live on beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function over batches that releases memory when it ends."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped
