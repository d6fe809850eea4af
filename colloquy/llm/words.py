"""Words of a text as 64-bit numbers, for the operators that compare word sequences."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Distinct words a worker remembers before it starts over (numbers never change by that).
CACHE_WORDS = 500_000


_HELD: dict = {}
#: The C library's own way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what this worker has freed back to the system: the allocators keep it for the worker's life otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Let go of what another operator remembers in this worker: one at a time does, whatever a worker has run before."""
    if _HELD.get("owner") != owner:
        if _HELD:
            _HELD["drop"]()
            release()
        _HELD.update(owner=owner, drop=drop)


class WordIds(dict):
    """word -> 64-bit number, drawn from the word's bytes alone; remembers what it has seen."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(blake2b(self.form(word), digest_size=8).digest(), "little")
        return value

    def form(self, word: bytes) -> bytes:
        """What of a word counts."""
        return word

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all runs of ``n`` words; of the whole sequence if it is shorter, none if it is empty."""
    k = min(n, len(ids))
    if k == 0:
        return np.zeros(0, np.uint64)
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i]
    return mix(h)
