r"""Word shingles as sets of 64-bit hashes.

Words are runs of bytes outside ``\x20\x09-\x0D`` with A-Z lower-cased; a text's set holds a hash for each distinct run
of ``width`` words, one for all its words if there are fewer, and none if there are no words. A word's hash is 64 bits of
BLAKE2b over all of its bytes, so that no pattern in a text makes hashes meet; a run's hash mixes those of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Word -> hash, remembered for short words."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found


class Shingler:
    def __init__(self, width: int = 5, memory: int = 400_000):
        self.width, self.memory, self.known = width, memory, _Words()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted set of each text."""
        hashed, lengths = [], []
        for text in texts:
            words = text.lower().split()  # splits at ASCII white space
            hashed.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
            lengths.append(len(words))
            if len(self.known) > self.memory:
                self.known.clear()
        words, w = np.concatenate(hashed) if hashed else np.empty(0, np.uint64), self.width
        runs = np.zeros(max(0, len(words) - w + 1), np.uint64)
        for k in range(w):
            runs = runs * np.uint64(_BASE) + words[k : k + len(runs)]
        runs = mixed(runs)
        out, a = [], 0
        for n in lengths:
            if n >= w:
                out.append(np.unique(runs[a : a + n - w + 1]))
            elif n:
                short = np.array([n], np.uint64)
                for k in range(a, a + n):
                    short = mixed(short * np.uint64(_BASE) + words[k : k + 1])
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
            a += n
        return out


def signature(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def blocks(batches: Iterator, size: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes; null: empty) of Arrow batches (id, text, ...), about ``size`` bytes at a time; a longer text alone."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            if ids and held + len(raw) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield ids, texts
