"""Far places of numpy's legacy generator: the Mersenne twister is linear, so a jump is a power of its step.

The step's minimal polynomial over GF(2) is found from one bit of the sequence (Berlekamp-Massey). A jump by t places is
x^t modulo that polynomial, applied to the words that follow: squarings only, so a jump takes log t of them. Any task can
thus begin anywhere in the stream of any seed, and one stream is drawn by many tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 624
BITS = 19937


def _words(key: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` words of the recurrence that begins with ``key``, before they are tempered."""
    gen = np.random.RandomState()
    gen.set_state(("MT19937", key, WORDS))
    out = [key]
    while len(out) * WORDS < n:
        gen.randint(0, 1 << 32, size=WORDS, dtype=np.uint32)
        out.append(gen.get_state()[1])
    return np.concatenate(out)[:n]


@lru_cache(1)
def polynomial() -> int:
    """Minimal polynomial of the step; bit i is the coefficient of x^i."""
    bits = (_words(np.random.RandomState(1).get_state()[1], 2 * BITS + 2 * WORDS)[1:] & np.uint32(1)).tolist()
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for i, bit in enumerate(bits[: 2 * BITS + 64]):
        seen = seen << 1 | bit
        if (now & seen).bit_count() & 1:
            if 2 * length <= i:
                now, before, length, gap = now ^ before << gap, now, i + 1 - length, 1
                continue
            now ^= before << gap
        gap += 1
    # the connection polynomial, turned round
    return int(format(now, "b").zfill(length + 1)[::-1], 2)


def _reduced(a: int) -> int:
    p = polynomial()
    while (over := a.bit_length() - BITS - 1) >= 0:
        a ^= p << over
    return a


@lru_cache(256)
def power(places: int) -> int:
    """x^places modulo the polynomial."""
    if places < BITS:
        return 1 << places
    half = power(places // 2)
    square = int("0".join(format(half, "b")), 2)
    return _reduced(square << places % 2)


def generator(seed: int, place: int) -> np.random.RandomState:
    """``RandomState(seed)`` after ``place`` numbers of 32 bits."""
    gen = np.random.RandomState(seed)
    if place:
        words = _words(gen.get_state()[1], BITS + WORDS)
        key, a = np.zeros(WORDS, np.uint32), power(place)
        while a:
            low = (a & -a).bit_length() - 1
            key ^= words[low : low + WORDS]
            a &= a - 1
        gen.set_state(("MT19937", key, WORDS))
    return gen


def accepted(seed: int, block: int, size: int, total: int) -> np.ndarray:
    """What ``RandomState(seed).randint(0, total)`` keeps of the raw numbers block * size and on: those below ``total`` under the mask."""
    raw = generator(seed, block * size).randint(0, 1 << 32, size=size, dtype=np.uint32)
    masked = raw & np.uint32((1 << (total - 1).bit_length()) - 1)
    return masked[masked < total].astype(np.int64)
