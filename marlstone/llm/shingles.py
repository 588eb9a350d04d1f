"""Hashes of words and of runs of five words, for whole texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_CHUNK = 1 << 18
_MULT = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(x: int) -> np.ndarray:
    a = np.full(_CHUNK + 2, x, dtype=np.uint64)
    a[0] = 1
    return np.cumprod(a, dtype=np.uint64)


_UP, _DOWN = _powers(_MULT), _powers(pow(_MULT, -1, 1 << 64))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of data, of at most _CHUNK bytes."""
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    a, b = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)))
    return a, mix((total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64))


def _long(raw: bytes) -> np.ndarray:
    """The words' hashes of a text over _CHUNK bytes: cut at white space; a longer word is hashed apart."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[np.frombuffer(raw[at:end], np.uint8)])
            if not len(gaps):
                tail = np.flatnonzero(_SPACE[np.frombuffer(raw[end:], np.uint8)])
                end = end + int(tail[0]) if len(tail) else len(raw)
                # No white space before `end`, but for the byte at `at` perhaps.
                digest = hashlib.blake2b(raw[at:end], digest_size=8).digest()
                out.append(np.frombuffer(digest, np.uint64))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        out.append(_hashed(np.frombuffer(raw[at:end], np.uint8))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of its and the following texts' words, where each text's words end)."""
    i = 0
    raw: list[bytes] = []
    size = 0

    def flush(first: int) -> tuple[int, np.ndarray, np.ndarray]:
        a, h = _hashed(np.frombuffer(b" ".join(raw), np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raw])
        return first, h, np.searchsorted(a, ends)

    for k, text in enumerate(texts):
        b = text.encode("utf-8", "replace")
        if raw and size + len(b) + 1 > _CHUNK:
            yield flush(i)
            raw, size = [], 0
        if len(b) + 1 > _CHUNK:
            h = _long(b)
            yield k, h, np.array([len(h)])
            continue
        if not raw:
            i = k
        raw.append(b)
        size += len(b) + 1
    if raw:
        yield flush(i)


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def multiset(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count) of one text's word hashes, sorted; of fewer than five words all make one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(n, WORDS)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h += words[k : n - width + 1 + k] * _STEP[k]
    h = mix(h)
    h.sort()
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    return h[first], np.diff(first, append=len(h))


def multisets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """multiset() of each text, in order."""
    for _, h, ends in word_hashes(texts):
        start = 0
        for end in ends.tolist():
            yield multiset(h[start:end])
            start = end


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two multisets; 0 if either is empty."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (total - common)
