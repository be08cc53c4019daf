"""Words of texts as 64-bit hashes: A-Z in lower case, parted by space and the bytes 9 to 13."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts are held as Python objects at a time. At the end of a task the worker, which
    lives on, gives back what it does not use."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    batch = None
    give_back()


def give_back() -> None:
    """Free memory that Arrow and the C library hold for later goes to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, for each worker process."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_WORDS = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the definition of a word asks for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix64(out * _STEP + hashes[k : k + n])
    return mix64(out + np.uint64(width))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; a text with fewer words is one shingle, one without words none."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(width, len(hashes))))
