"""64-bit hashes of words and of word shingles, for many texts at a time.

Words are runs of characters other than white space (space, tab to carriage
return), with A-Z lower-cased. A word's hash is a polynomial over random values
of its bytes modulo 2**64, computed for all words at once from prefix sums, and
then mixed. Texts of any length are hashed whole.
"""

from __future__ import annotations

import functools

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _values() -> np.ndarray:
    """A random value for each byte; capitals have their small letters' values."""
    v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v[65:91] = v[97:123]
    v[BLANK] = 0
    return v


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            p = np.full(n, base)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at a time; longer texts are cut between words.
BYTES = 1 << 20


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each has."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    begins = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return h, np.diff(np.searchsorted(starts, begins))


def _cut(raw: bytes) -> list[bytes]:
    """Pieces of about BYTES that end between words."""
    out = []
    while len(raw) > BYTES:
        at = BYTES
        while at < len(raw) and not BLANK[raw[at]]:
            at += 1
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's begin (one more than texts)."""
    parts = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    of: list[int] = []
    size = 0

    def flush():
        h, n = _hashed(group)
        parts.append(h)
        np.add.at(counts, of, n)
        group.clear()
        of.clear()

    for i, t in enumerate(texts):
        for piece in _cut((t or "").encode("utf-8", "surrogatepass")):
            group.append(piece)
            of.append(i)
            size += len(piece)
            if size >= BYTES:
                flush()
                size = 0
    if group:
        flush()
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Of each text its distinct ``k``-word shingles, sorted; fewer words are one shingle, none are no shingle."""
    h, at = word_hashes(texts)
    all_grams = grams(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        else:
            out.append(grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
