"""Words and word shingles of texts as 64-bit hashes, computed with numpy over bytes."""

from __future__ import annotations

import numpy as np

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = 1 << 20  # bytes hashed at once
_R = 0x9E3779B97F4A7C55
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None, spans: bool = False):
    """64-bit hashes of the words between ASCII blanks, A-Z lower-cased; with ``spans`` also their byte starts and ends."""
    raw = (text or "").encode().lower()
    out, starts, ends, at = [], [], [], 0
    while at < len(raw):
        to = at + _STEP
        while to < len(raw) and not BLANKS[raw[to]]:
            to += 1
        a = np.frombuffer(raw, np.uint8, count=min(to, len(raw)) - at, offset=at)
        blank = BLANKS[a]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        if len(s):
            power, inverse = _tables(len(a) + 1)
            v = (a.astype(np.uint64) + np.uint64(1)) * power[: len(a)]
            v[blank] = 0
            out.append(mix(np.add.reduceat(v, s) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    if not spans:
        return h
    none = np.zeros(0, np.int64)
    return h, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in order; of fewer words, the whole sequence as one."""
    n = len(words)
    size = min(n, k)
    if not n:
        return words
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h += words[i : n - size + 1 + i] * np.uint64(pow(_R, i + 1, 1 << 64))
    return mix(h)


def run_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at ``at``, whatever k costs: from running sums."""
    power, inverse = _tables(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])
    return mix((total[at + k] - total[at]) * inverse[at])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def parity_bits(n: int, least: int = 256, most: int = 1 << 15) -> int:
    """Bits of the parity sketch of a set of ``n``: a power of two about n."""
    return min(most, max(least, 1 << (n - 1).bit_length() if n > 1 else 0))


def parity(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles fall on i.

    Two sketches, folded to one size, differ in at most as many bits as the sets differ in
    members: a lower bound for the difference.
    """
    m = parity_bits(len(shingles))
    odd = np.bincount((shingles >> np.uint64(7)) % np.uint64(m), minlength=m).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to ``words`` words: as if made with fewer bits."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch
