"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, step in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            table = np.ones(size, np.uint64)
            table[1:] = np.multiply.accumulate(np.full(size - 1, step, np.uint64))
            _POWERS[name] = table
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    """Sums of ``byte * BASE ** place`` before every place; span hashes follow by one subtraction."""
    up, _ = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span of bytes, the same wherever it stands."""
    _, down = _powers(len(sums))
    own = (sums[ends] - sums[begins]) * down[begins]
    return mixed(own + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the number of words of each text."""
    raw = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    stops = np.cumsum([len(r) + 1 for r in raw]) if raw else np.array([], int)
    counts = np.diff(np.searchsorted(begins, np.concatenate([[0], stops])))
    return span_hashes(prefix_sums(buffer), begins, ends), counts


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words make one shingle, no words make none."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    weights = [np.uint64(pow(int(BASE) ^ 0x5DEECE66D, 2 * k + 1, 1 << 64)) for k in range(words)]
    for count in counts.tolist():
        own = hashes[at : at + count]
        at += count
        width = min(words, count)
        if not width:
            out.append(np.array([], np.uint64))
            continue
        sums = np.zeros(count - width + 1, np.uint64)
        for k in range(width):
            sums += own[k : k + len(sums)] * weights[k]
        out.append(np.unique(mixed(sums + np.uint64(width))))
    return out
