"""Digests of the words of a text, a whole text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes that are cut into words at a time, if words allow, as a word is an object of its own.
PART = 1 << 18


def parts(data: bytes) -> Iterator[bytes]:
    """A text in parts that end before white space."""
    at = 0
    while at < len(data):
        stop = at + PART
        while stop < len(data) and not _WHITE[data[stop]]:
            stop += 1
        yield data[at:stop]
        at = stop


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and the end of each word: a run of bytes other than the six white-space ones."""
    edges = np.diff((~_WHITE[np.frombuffer(data, np.uint8)]).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest, start and end of each word. Words are digested one by one by a hash without algebra: a polynomial of their bytes would
    give some pairs of words the same digest, whatever its base."""
    starts, ends = word_places(data)
    out, n = np.empty(len(starts), np.uint64), 0
    for part in parts(data):
        words = part.split()
        out[n : n + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n += len(words)
    return out, starts, ends


def word_digests(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with digests of 128 bits, as two numbers for each word."""
    starts, ends = word_places(data)
    out, n = np.empty((2, len(starts)), np.uint64), 0
    for part in parts(data):
        words = part.split()
        out[:, n : n + len(words)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T
        n += len(words)
    return out[0], out[1], starts, ends


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The digest of each run of n words; none if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out
