"""The binary Golay code of length 23: every 23-bit word lies within three bits of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, MESSAGE - 2, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - MESSAGE + 1)
    return word


@cache
def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of each byte's words, and the error that each of the 2048 remainders tells."""
    by_byte = [np.array([_remainder(b << s & (1 << LENGTH) - 1) for b in range(256)], np.uint32) for s in (0, 8, 16)]
    errors = np.zeros(1 << 11, np.uint32)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            errors[_remainder(word)] = word
    return by_byte, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095: its twelve leading bits) of the codeword nearest to each 23-bit word."""
    by_byte, errors = _tables()
    words = words.astype(np.uint32)
    remainder = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ errors[remainder]) >> (LENGTH - MESSAGE)


def around(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """The indices nearest to each word and to each word at one bit from it (in its low `width` bits), as rows; an
    index that a row has already is -1. At most six differ."""
    flips = np.array([0, *(1 << b for b in range(width))], np.uint32)
    rows = np.sort(nearest(words.astype(np.uint32)[:, None] ^ flips), axis=1).astype(np.int64)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows
