"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed over many texts at once.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    codes = np.frombuffer(data.translate(LOWER), np.uint8)
    space = np.r_[True, IS_SPACE[codes], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    h = sizes.astype(np.uint64)
    live, k = np.arange(len(starts)), 0
    while len(live):
        h[live] = (h[live] ^ BYTE[codes[starts[live] + k]]) * ODD[0]
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        live = live[sizes[live] > k]
    return starts, mix(h)


def _pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of bounded size that end at white space (or later, within a longer word)."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not IS_SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _join(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        h = h + words[i : i + n] * ODD[i % 5] + ODD[(i + 2) % 5]
    return mix(h)


def _set(words: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    if len(words) >= size:
        return np.unique(windows)
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    h = np.array([len(words)], np.uint64) * ODD[4]
    for i in range(len(words)):
        h = mix(h * ODD[1] + words[i : i + 1])
    return h


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words; with fewer words, of the whole; empty without words."""
    held: list[bytes] = []

    def solve() -> Iterator[np.ndarray]:
        begins = np.cumsum([0, *(len(x) + 1 for x in held)])
        starts, words = _words(b" ".join(held))
        windows = _join(words, size)
        cuts = np.searchsorted(starts, begins)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _set(words[a:b], windows[a : b - size + 1] if b - a >= size else windows[:0], size)

    total = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            yield from solve() if held else ()
            held, total = [], 0
            words = np.concatenate([_words(x)[1] for x in _pieces(data)])
            yield _set(words, _join(words, size), size)
            continue
        held.append(data)
        total += len(data)
        if total > PIECE:
            yield from solve()
            held, total = [], 0
    if held:
        yield from solve()


def fingerprint(shingles: np.ndarray) -> int:
    """One 64-bit number for a set; equal sets have equal ones."""
    h = np.array([len(shingles)], np.uint64) * ODD[2] + np.add.reduce(mix(shingles ^ ODD[3]), dtype=np.uint64)
    return int(mix(h).view(np.int64)[0])
