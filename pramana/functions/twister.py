"""Jumping ahead in the Mersenne Twister that Python's ``random`` and numpy's ``RandomState`` share.

The words of the generator follow a linear recurrence over GF(2). A state some number of words ahead is therefore a
polynomial in the step applied to the state: the power of x, reduced by the recurrence's own polynomial. Polynomials are
whole numbers, bit k standing for x to the k.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of the generator: words and middle of its recurrence, twist, bits kept of a word's two parts, size of its state in bits.
N, M, TWIST, UPPER, LOWER, DEGREE = 624, 397, 0x9908B0DF, 0x80000000, 0x7FFFFFFF, 19937


def words_after(state: np.ndarray, n: int) -> np.ndarray:
    """The state's N words and the ``n`` that follow them, before tempering."""
    out = np.zeros(N + n, np.uint32)
    out[:N] = state
    at = N
    while at < len(out):
        # a stretch reads only what is known: N - M words at a time
        to = min(len(out), at + N - M)
        mixed = (out[at - N : to - N] & np.uint32(UPPER)) | (out[at - N + 1 : to - N + 1] & np.uint32(LOWER))
        out[at:to] = out[at - N + M : to - N + M] ^ (mixed >> np.uint32(1)) ^ np.where(mixed & np.uint32(1), np.uint32(TWIST), np.uint32(0))
        at = to
    return out


@lru_cache(maxsize=1)
def recurrence() -> int:
    """The polynomial of least degree that the generator's bits obey, found from the bits of one seed."""
    start = np.array(random.Random(1).getstate()[1][:N], np.uint32)
    bits = words_after(start, 2 * DEGREE)[N:] & 1
    connection, before, length, gap = 1, 1, 0, 1
    seen = 0  # the newest bit lowest
    for k, bit in enumerate(bits.tolist()):
        seen = seen << 1 | bit
        window = seen & ((1 << (length + 1)) - 1)
        if (connection & window).bit_count() & 1:
            longer = 2 * length <= k
            connection, old = connection ^ (before << gap), connection
            if longer:
                length, before, gap = k + 1 - length, old, 0
        gap += 1
    # read from the other end, the connection is the polynomial of the step
    return int(format(connection, f"0{length + 1}b")[::-1], 2)


def _reduced(a: int, by: int) -> int:
    top = by.bit_length()
    while (over := a.bit_length() - top) >= 0:
        a ^= by << over
    return a


@lru_cache(maxsize=256)
def power(words: int) -> int:
    """x to the ``words``, reduced by the recurrence."""
    by, out = recurrence(), 1
    for bit in format(words, "b"):
        # a square puts a zero between any two bits
        out = _reduced(int("0".join(format(out, "b")), 2), by)
        if bit == "1":
            out = _reduced(out << 1, by)
    return out


def state_after(seed: int, words: int) -> np.ndarray:
    """The state of ``random.Random(seed)`` once it has given ``words`` 32-bit words."""
    start = np.array(random.Random(seed).getstate()[1][:N], np.uint32)
    steps = power(words)
    known = words_after(start, DEGREE + 1)
    out = np.zeros(N, np.uint32)
    for k, bit in enumerate(reversed(format(steps, "b"))):
        if bit == "1":
            out ^= known[k : k + N]
    return out


def uniforms(seed: int, skipped: int, n: int) -> np.ndarray:
    """``n`` numbers in [0, 1) as ``random.Random(seed).random()`` gives them after ``skipped`` others; each takes two words."""
    source = np.random.RandomState()
    source.set_state(("MT19937", state_after(seed, 2 * skipped), N))
    return source.random_sample(n)
