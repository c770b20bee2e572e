"""Word and shingle hashes of whole Arrow string columns in numpy, without a Python string per word.

A word is a run of bytes other than the ASCII white space ``\\x20`` and ``\\x09`` to ``\\x0D``. Its hash covers its bytes unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from fleetlens.llm.common import mix64

#: bytes of text that are hashed together; a longer text is hashed alone
CHUNK = 1 << 20
#: odd multipliers for the bytes of a word and the words of a shingle
BYTE_STEP, WORD_STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = mix64(np.arange(256, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)


def powers(step: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, step & 0xFFFFFFFFFFFFFFFF, np.uint64)], dtype=np.uint64)


@dataclass
class Words:
    """Words of the documents ``first`` to ``first + len(counts) - 1`` of a column: hashes, byte spans in ``raw`` and words per document."""

    first: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.counts)]


def hashed_words(column: pa.Array) -> Iterator[Words]:
    """Chunks of a string column without nulls."""
    global _POWERS
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        raw, edges = data[at[first]:at[last]], at[first:last + 1] - at[first]
        inner = (raw != 32) & ((raw < 9) | (raw > 13))
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        cut = edges[:-1][edges[:-1] < len(raw)]
        begins[cut] = inner[cut]  # a document's first byte never continues a word
        starts = np.flatnonzero(begins)
        if len(starts):
            ending = inner.copy()
            ending[:-1] &= ~inner[1:] | begins[1:]
            ends = np.flatnonzero(ending) + 1
            place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)])) if starts[0] == 0 else np.arange(len(raw)) - np.r_[np.zeros(starts[0], int), np.repeat(starts, np.diff(np.r_[starts, len(raw)]))]
            longest = int((ends - starts).max())
            if len(_POWERS) <= longest:
                _POWERS = powers(BYTE_STEP, longest)
            with np.errstate(over="ignore"):
                value = np.where(inner, _BYTES[raw] * _POWERS[np.minimum(place, longest)], np.uint64(0))
                hashes = mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
        else:
            ends, hashes = starts, np.zeros(0, np.uint64)
        counts = np.diff(np.searchsorted(starts, edges))
        yield Words(first, counts, hashes, starts, ends, raw)
        first = last


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words; of all words together, if there are fewer."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(powers(WORD_STEP, n)[:n]):
            total += hashes[k:k + len(total)] * p
    return mix64(total)
