"""Counting quotient filters of packed keys, lossless and in sorted form.

A key of 2w bits is held as two halves of w bits. An invertible permutation
(a Feistel network) spreads the keys evenly; of a permuted key the upper q
bits are its quotient and all other bits its remainder, so that nothing is
lost and a filter can be turned back into its keys. A filter is written as

* ``occupied``: one bit per quotient, set if some key has it,
* ``run ends``: one bit per key, set at the last key of each quotient,
* the remainders in the order of the permuted keys, in whole bytes,
* the counters: one byte each, larger ones apart.

The order does not depend on q. Filters of any size can therefore be merged
like sorted lists, and a filter can be dealt out by ranges of its permuted keys.
"""

from __future__ import annotations

import numpy as np

from recurra.llm.common import mix, run_starts

U64 = np.uint64
#: Round constants of the network; any odd numbers do.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def permute(hi: np.ndarray, lo: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    for c in ROUNDS:
        hi, lo = lo, hi ^ (mix(lo + U64(c)) >> U64(64 - w))
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    for c in reversed(ROUNDS):
        hi, lo = lo ^ (mix(hi + U64(c)) >> U64(64 - w)), hi
    return hi, lo


class Keys:
    """Packs up to three ids of ``bits`` bits each (an absent one is zero) into the halves of a key."""

    def __init__(self, bits: int):
        self.bits, self.w = bits, (3 * bits + 1) // 2

    def pack(self, a, b, c) -> tuple[np.ndarray, np.ndarray]:
        low = (b << U64(self.bits)) | c
        return permute((low >> U64(self.w)) | (a << U64(2 * self.bits - self.w)), low & mask(self.w), self.w)

    def unpack(self, hi, lo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi, lo = restore(hi, lo, self.w)
        above = 2 * self.bits - self.w
        low = ((hi & mask(above)) << U64(self.w)) | lo
        return hi >> U64(above), low >> U64(self.bits), low & mask(self.bits)


def count(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None, w: int):
    """Distinct keys in order with the sums of their counts (each key once where n is None)."""
    if 2 * w <= 64:
        key = (hi << U64(w)) | lo
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")  # made for lists that are sorted in parts
            key, n = key[order], n[order]
        first = np.flatnonzero(run_starts(key))
        key_first = key[first]
        hi, lo, total = key_first >> U64(w), key_first & mask(w), len(key)
    else:
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        n = n if n is None else n[order]
        first, total = np.flatnonzero(run_starts(hi, lo)), len(hi)
        hi, lo = hi[first], lo[first]
    if n is None:
        n = np.diff(np.append(first, total))
    elif len(first):
        n = np.add.reduceat(n, first)
    return hi, lo, n.astype(np.int64)


def _low_bytes(a: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8)[:, :(bits + 7) // 8].tobytes()


def write(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, high_bits: int, w: int) -> bytes:
    """A filter of sorted distinct permuted keys, whose upper half has ``high_bits`` bits here."""
    m = len(hi)
    q = min(high_bits, m.bit_length())
    quotient = (hi >> U64(high_bits - q)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    large = np.flatnonzero(n >= 255)
    return b"".join([
        np.array([m, q, len(large)], np.int64).tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        _low_bytes(hi & mask(high_bits - q), high_bits - q), _low_bytes(lo, w),
        np.minimum(n, 255).astype(np.uint8).tobytes(), n[large].tobytes()])


def read(blob, high_bits: int, w: int):
    """(hi, lo, n) of a written filter."""
    at = 24
    m, q, n_large = (int(x) for x in np.frombuffer(blob, np.int64, 3))

    def take(size):
        nonlocal at
        at += size
        return np.frombuffer(blob, np.uint8, size, at - size)

    def numbers(bits):
        k = (bits + 7) // 8
        out = np.zeros((m, 8), np.uint8)
        out[:, :k] = take(m * k).reshape(m, k)
        return out.view(U64).reshape(m)

    slots = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
    ends = np.unpackbits(take((m + 7) // 8), count=m)
    run = np.cumsum(ends) - ends  # the k-th run belongs to the k-th occupied quotient
    hi = (slots[run].astype(U64) << U64(high_bits - q)) | numbers(high_bits - q)
    lo = numbers(w)
    n = take(m).astype(np.int64)
    n[n == 255] = take(8 * n_large).view(np.int64)
    return hi, lo, n


def merge(parts: list, w: int):
    """One list of distinct keys and counts from several."""
    if len(parts) == 1:
        return parts[0]
    return count(*(np.concatenate([p[k] for p in parts]) for k in range(3)), w)
