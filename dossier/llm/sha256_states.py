"""SHA-256 on whole columns, with states that can be kept and resumed (FIPS 180-4).

A state is the chaining value after whole 64-byte blocks: eight 32-bit words per row. A digest in lower-case hex is
one block, so the state before a child slot of a Merkle node is exactly the state after the slots before it.
"""

from __future__ import annotations

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root(x: int, power: int) -> int:
    """Whole part of a root of a whole number."""
    low, high = 0, 1 << (x.bit_length() // power + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**power <= x else (low, mid - 1)
    return low


#: Fractions of the square roots of the first 8 and the cube roots of the first 64 primes.
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
ROUND = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)
_PAIRS = np.array([int.from_bytes(b"%02x" % b, "big") for b in range(256)], dtype=np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resumed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (m, 8) after one more block each. block: (m, 16) words, or (1, 16) for the same block everywhere."""
    w = [block[:, t] for t in range(16)]
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        small0 = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        small1 = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[t - 16] + small0 + w[t - 7] + small1)
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for t in range(64):
        t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + (w[t] + ROUND[t])
        t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (m, 8) as the 16 words of their hex text."""
    pairs = _PAIRS[np.ascontiguousarray(digests.astype(">u4")).view(np.uint8)]
    return (pairs[:, 0::2] << np.uint32(16)) | pairs[:, 1::2]


def closing_block(blocks: np.ndarray | int) -> np.ndarray:
    """Last block of messages of so many whole blocks."""
    n = np.atleast_1d(np.asarray(blocks, dtype=np.uint64)) * np.uint64(512)
    out = np.zeros((len(n), 16), dtype=np.uint32)
    out[:, 0] = 0x80000000
    out[:, 14], out[:, 15] = n >> np.uint64(32), n & np.uint64(0xFFFFFFFF)
    return out


def starts(m: int) -> np.ndarray:
    return np.repeat(START[None, :], m, axis=0)


def words(column: list[bytes]) -> np.ndarray:
    """Binary(32) values as (m, 8) words."""
    return np.frombuffer(b"".join(column), dtype=">u4").astype(np.uint32).reshape(-1, 8)


def raw(states: np.ndarray) -> np.ndarray:
    """(m, 8) words as (m, 32) bytes."""
    return np.ascontiguousarray(states.astype(">u4")).view(np.uint8).reshape(-1, 32)
