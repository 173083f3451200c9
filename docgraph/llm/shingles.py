"""Words and word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed odd multipliers.
R, A, B, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

def powers_of(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    line = np.full(n, U(base))
    line[:1] = U(1)
    return np.cumprod(line)


#: Kept for words; longer runs are made when they are needed.
SOME_POWERS = powers_of(int(R), 1 << 12)


def powers(n: int) -> np.ndarray:
    """R**0 ... R**(n-1)."""
    return SOME_POWERS[:n] if n <= len(SOME_POWERS) else powers_of(int(R), n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * A
    x ^= x >> U(29)
    x *= B
    x ^= x >> U(32)
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text: runs without ASCII white space, A-Z folded."""
    b = FOLD[np.frombuffer(text, np.uint8)]
    ink = ~BLANK[b]
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U)
    lengths = stop - start
    at = np.flatnonzero(ink)
    place = at - np.repeat(start, lengths)
    terms = (b[at].astype(U) + U(1)) * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(U) * C)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = w[: len(w) - n + 1]
    for i in range(1, n):
        h = mixed(h * C + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def batch_shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """``shingle_set`` of each text; words are hashed for all texts at once."""
    joined = b"\n".join(t or b"" for t in texts)
    b = FOLD[np.frombuffer(joined, np.uint8)]
    ink = np.zeros(len(b) + 2, bool)
    np.logical_not(BLANK[b], out=ink[1:-1])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return [np.empty(0, U)] * len(texts)
    lengths = stop - start
    at = np.flatnonzero(ink[1:-1])
    place = at - np.repeat(start, lengths)
    terms = (b[at].astype(U) + U(1)) * powers(int(lengths.max()))[place]
    w = mixed(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(U) * C)
    h = w.copy()  # hashes of the n words from each place, good where they are of one text
    for i in range(1, n):
        h[: len(w) - i] = mixed(h[: len(w) - i] * C + w[i:])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    cut = np.searchsorted(start, ends).tolist()
    out, a = [], 0
    for z in cut:
        if z - a >= n:
            out.append(np.unique(h[a : z - n + 1]))
        else:
            s = w[a : min(a + 1, z)]
            for i in range(a + 1, z):
                s = mixed(s * C + w[i : i + 1])
            out.append(s)
        a = z
    return out
