"""Minimal acyclic transducer: sorted terms to their ordinals.

Built from sorted terms, one after the other: as soon as a term leaves a
branch, the branch's states are final and equal ones are shared. An edge
carries the number of terms that sort before those beyond it, so that the sum
along a path is the term's place in the list.

A built transducer is a few arrays, and text goes through it in lockstep: all
words of a buffer take their k-th step at once. A state's edges are a bitmap
over the byte values; the edge's place is the number of bits below.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Transducer:
    def __init__(self, bits, first, target, before, final, root: int, longest: int):
        self.bits, self.first, self.target, self.before, self.final = bits, first, target, before, final
        self.root, self.longest = root, longest

    @classmethod
    def build(cls, terms) -> "Transducer":
        """terms: distinct, sorted by bytes, none empty."""
        known: dict[tuple, int] = {}
        counts: list[int] = []
        path: list[tuple[list, bool]] = [([], False)]  # the states along the last term that may still change

        def close(state) -> int:
            edges, final = state
            key = (final, tuple(edges))
            number = known.get(key)
            if number is None:
                number = known[key] = len(counts)
                counts.append(int(final) + sum(counts[t] for _, t in edges))
            return number

        last, longest = b"", 0
        for term in terms:
            same = 0
            for x, y in zip(last, term):
                if x != y:
                    break
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][0].append((last[depth - 1], close(path.pop())))
            path += [([], k == len(term) - 1) for k in range(same, len(term))]
            last, longest = term, max(longest, len(term))
        for depth in range(len(last), 0, -1):
            path[depth - 1][0].append((last[depth - 1], close(path.pop())))
        root = close(path[0])

        n = len(counts)
        bits, first = np.zeros((n, 4), U64), np.zeros((n, 4), np.int64)
        final, target, before = np.zeros(n, bool), [], []
        for (is_final, edges), state in known.items():
            final[state] = is_final
            ahead, words, starts = int(is_final), [0] * 4, [0] * 4
            for byte, to in edges:
                words[byte >> 6] |= 1 << (byte & 63)
                target.append(to)
                before.append(ahead)
                ahead += counts[to]
            at = len(target) - len(edges)
            for k in range(4):
                starts[k] = at
                at += words[k].bit_count()
            bits[state], first[state] = words, starts
        return cls(bits.reshape(-1), first.reshape(-1), np.array(target, np.int64), np.array(before, np.int64), final, root, longest)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.final), len(self.target), self.root, self.longest], np.int64)
        return b"".join(x.tobytes() for x in (
            head, self.bits, self.first.astype(np.int32), self.target.astype(np.int32), self.before.astype(np.int32), self.final))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Transducer":
        n, m, root, longest = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        at, out = 32, []
        for dtype, size in ((U64, 4 * n), (np.int32, 4 * n), (np.int32, m), (np.int32, m), (bool, n)):
            out.append(np.frombuffer(blob, dtype, size, at))
            at += size * np.dtype(dtype).itemsize
        bits, first, target, before, final = out
        return cls(bits, first.astype(np.int64), target.astype(np.int64), before.astype(np.int64), final, root, longest)

    def ordinals(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ordinal (from 0) of each word data[start:start + length], -1 for words that are no terms."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero((length > 0) & (length <= self.longest))
        at, left = start[live], length[live]
        state, total = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        while len(live):
            byte = data[at]
            slot = state * 4 + (byte >> 6)
            word, bit = self.bits[slot], (byte & 63).astype(U64)
            go = np.flatnonzero((word >> bit) & U64(1))
            below = np.bitwise_count(word[go] & ((U64(1) << bit[go]) - U64(1)))
            edge = self.first[slot[go]] + below
            state, total = self.target[edge], total[go] + self.before[edge]
            live, at, left = live[go], at[go] + 1, left[go] - 1
            done = left == 0
            ended = done & self.final[state]
            out[live[ended]] = total[ended]
            rest = ~done
            live, at, left, state, total = live[rest], at[rest], left[rest], state[rest], total[rest]
        return out
