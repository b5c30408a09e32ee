"""The perfect binary Golay code [23, 12, 7] on numpy arrays.

Every 23-bit word lies within distance 3 of exactly one codeword, whose 12
information bits are its index.  A word at distance 3 from its codeword has
five more codewords at distance 4, any other word has none.  So two words
that differ in at most one bit share an index: the codeword of the one is
within distance 4 of the other.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

BITS = 23
INFO = 12
# Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word modulo the generator polynomial (0 to 2047)."""
    r = words.astype(np.int64, copy=True)
    for bit in range(BITS - 1, BITS - INFO - 1, -1):
        r ^= ((r >> bit) & 1) * (GENERATOR << (bit - (BITS - INFO)))
    return r


@functools.cache
def error_patterns() -> np.ndarray:
    """(2048, 6): by syndrome, the error pattern of weight <= 3, then those of weight 4 (0 pads with the first)."""
    light = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)]
    leader = np.zeros(2048, np.int64)
    leader[syndrome(np.array(light))] = light
    out = np.repeat(leader[:, None], 6, axis=1)
    for s in range(2048):
        flips = 1 << np.arange(BITS)
        near = leader[s ^ syndrome(flips)] ^ flips  # differs from the word's codeword by one more bit
        heavy = np.unique(near[np.bitwise_count(near) == 4])
        out[s, 1:1 + len(heavy)] = heavy
    return out


def home(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword."""
    return (words ^ error_patterns()[syndrome(words), 0]) >> (BITS - INFO)


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of all codewords within distance 4, and which of them are no padding."""
    patterns = error_patterns()[syndrome(words)]
    real = np.ones(patterns.shape, bool)
    real[:, 1:] = patterns[:, 1:] != patterns[:, :1]
    return (words[:, None] ^ patterns) >> (BITS - INFO), real
