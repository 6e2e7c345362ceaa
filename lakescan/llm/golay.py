"""The binary Golay code (23, 12, 7): nearest codeword of any 23-bit word.

The code is perfect: every word lies within three bits of exactly one codeword.  Two
words that differ in at most one bit therefore meet: the nearest codeword of the one
lies within four bits of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _syndrome(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The parts of the syndrome by low and high bits; for each syndrome, its error patterns of least
    weight first, then those of weight four: the way to every codeword within four bits."""
    unit = [_syndrome(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for part, first in ((low, 0), (high, 12)):
        for b in range(len(part).bit_length() - 1):
            part[1 << b : 2 << b] = part[: 1 << b] ^ unit[first + b]
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            s = 0
            for b in at:
                s ^= unit[b]
            errors[s].append(sum(1 << b for b in at))
    return low, high, [np.array(e, np.int64) for e in errors]


def near(word: int) -> np.ndarray:
    """Indices (upper 12 bits of systematic codewords) of the codewords within four bits, the nearest first."""
    low, high, errors = tables()
    return (word ^ errors[low[word & 0xFFF] ^ high[word >> 12]]) >> 11
