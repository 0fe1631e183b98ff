"""Vectorised 64-bit hashing of words and substrings with numpy.

The substring hash is a polynomial modulo 2^64 in an odd base, read from prefix
sums and put at position 0 by the inverse power, then mixed; it depends on the
bytes alone, never on process seeds, so all executors agree.
"""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_pow = _inv = np.ones(1, dtype=U)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but 0-9, A-Z, a-z and bytes of non-ASCII characters.
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CUT = {True: re.compile(rb"[\x20\x09-\x0d]"), False: re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")}
PIECE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([[U(1)], np.cumprod(np.full(size, BASE, dtype=U))])
            _inv = np.concatenate([[U(1)], np.cumprod(np.full(size, INVERSE, dtype=U))])
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(b: np.ndarray) -> np.ndarray:
    """prefix[i]: the weighted sum of the first i bytes."""
    p, _ = powers(len(b) + 1)
    out = np.empty(len(b) + 1, dtype=U)
    out[0] = 0
    x = b.astype(U)
    x += U(1)
    x *= p[: len(b)]
    np.cumsum(x, out=out[1:])
    return out


def substr(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of bytes lo..hi, unmixed."""
    _, inv = powers(len(pre))
    return (pre[hi] - pre[lo]) * inv[lo]


def _words(b: bytes, delim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b, dtype=np.uint8)
    word = np.empty(len(a) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    np.logical_not(delim[a], out=word[1:-1].view(bool))
    d = np.diff(word)
    lo, hi = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return lo, mix(substr(prefix(a), lo, hi) + (hi - lo).astype(U) * U(0xD6E8FEB86659FD93))


def words(texts: list[bytes], space_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and each text's end in them.

    space_only: words are split at ASCII white space, else also at ASCII punctuation.
    """
    delim = SPACE if space_only else PUNCT
    if len(texts) == 1 and len(texts[0]) > PIECE:  # long texts in pieces, cut at a delimiter
        b, at, out = texts[0].lower(), 0, []
        while at < len(b):
            m = _CUT[space_only].search(b, min(at + PIECE, len(b)))
            end = m.end() if m else len(b)
            out.append(_words(b[at:end], delim)[1])
            at = end
        h = np.concatenate(out)
        return h, np.array([len(h)])
    lo, h = _words(b" ".join(texts).lower(), delim)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(lo, ends)
