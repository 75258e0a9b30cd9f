"""Hashed word shingles and MinHash signatures of whole texts, with numpy over the bytes."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of words (anything but 0x20 and 0x09 to 0x0D), and A-Z in lower case.
IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
LOWERED = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)

_BASE = 0x9E6C63D0876A9A47
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far has bytes."""

    up = _powers(_BASE, _STEP)
    down = _powers(pow(_BASE, -1, 2**64), _STEP)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = -(-n // _STEP) * _STEP
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word of the lower-cased text, in order."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.of(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LOWERED[data] * up[: len(data)], dtype=np.uint64)])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; with fewer words the whole sequence is the only one."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        found = mix(found * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i])
    return np.unique(found)


def set_key(found: np.ndarray) -> bytes:
    """128-bit name of a shingle set; equal sets have equal names."""
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


class Signer:
    """``coordinates`` hash functions; a signature holds the 32-bit minimum of each over a set."""

    def __init__(self, coordinates: int, seed: int = 20240229) -> None:
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 2**63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 2**63, coordinates, np.uint64)

    def sign(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), 2**64 - 1, np.uint64)
        for at in range(0, len(found), 1024):
            np.minimum(least, (found[at : at + 1024, None] * self.factor + self.shift).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)
