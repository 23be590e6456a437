"""Benchmark decontamination (operator 3).

Words are runs of letters and digits, ASCII lower-cased. Over every document
slides, for each item length, a window of that many words; a SimHash of its
5-word shingles (weighted by their counts) is compared with those of the items
of that length. Multi-index blocks find all item fingerprints within
``RADIUS`` of 64 bits: with 8 blocks, two fingerprints that differ in 22 bits
or fewer differ in at most 2 bits of some 8-bit block, and the index lists
every item under all block values up to 2 bits away. Candidates are verified
exactly: the sum of the smaller shingle counts over the sum of the larger ones
must reach 0.8.

Only windows that share a shingle with some item are fingerprinted; any other
has similarity zero. The radius lies about 4 standard deviations beyond the
distance that a similarity of 0.8 leads to where no shingle repeats. A shingle
that repeats weighs on all bits at once and can lead to any distance: where the
window or the item repeats a shingle, the candidates are found without
fingerprints, exactly. A similarity of 0.8 needs a number of shared shingles,
so such a window holds that many shingles of items, and an item that reaches it
holds one of any choice of the window's shingles that is too large to be left
out; the rarest are looked up. Of overlapping hits the best one per document
and item is returned.

Items are read in blocks of bounded size (``block_items``, ``block_bytes``); a
block's index is broadcast, whatever the size of the benchmark, and each block
scans all documents. Documents are never moved.

Defined cases: items or texts that are null, empty or without words match
nothing; an item or document of fewer than five words has one shingle, its
whole word sequence, and is matched by windows of its length; a document
shorter than an item is one window; repeated items each count; repeated rows
give one hit per row; a null item_id is never reported; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import U64, WordHash, clean_docs, mix, ngrams

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 22, 8
#: ASCII letters lower-cased, other ASCII but digits to spaces; bytes beyond ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: 8-bit values within two bits of zero.
FLIPS = np.array([x for x in range(256) if x.bit_count() <= RADIUS // BLOCKS], np.uint8)


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes of a word sequence (fewer words: one shingle)."""
    return ngrams(hashes, min(SHINGLE, max(len(hashes), 1)))


def sim_hash(shingle_hashes: np.ndarray) -> int:
    bits = np.unpackbits(shingle_hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits), bitorder="little").view(U64)[0])


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def latest_repeat(s: np.ndarray) -> np.ndarray:
    """For each end: the latest place up to there whose shingle comes again up to there (-1: none)."""
    order = np.argsort(s, kind="stable")
    before = np.full(len(s), -1, np.int64)
    again = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    before[order[again + 1]] = order[again]
    return np.maximum.accumulate(before)


class ItemIndex:
    """Fingerprints and shingles of one block of items, by item length."""

    def __init__(self, items: list[tuple[int, str]]):
        hashing = WordHash()
        self.by_length: dict[int, list[tuple[int, int, Counter]]] = defaultdict(list)
        known = set()
        for item_id, text in items:
            words = word_list(text)
            if words:
                s = shingles(hashing.of(words))
                self.by_length[len(words)].append((item_id, sim_hash(s), Counter(s.tolist())))
                known.update((min(len(words), SHINGLE), h) for h in s.tolist())
        #: Sorted shingle hashes by shingle length.
        self.known = {n: np.array(sorted(h for m, h in known if m == n), U64) for n in {m for m, _ in known}}
        #: By item length: fingerprints, and for each block and value the bitmap of items within two bits.
        self.blocks = {}
        for length, group in self.by_length.items():
            fps = np.array([fp for _, fp, _ in group], U64)
            near = np.zeros((BLOCKS, 256, len(group)), bool)
            values = fps.view(np.uint8).reshape(-1, BLOCKS)
            for k in range(BLOCKS):
                for i in range(len(group)):
                    near[k, values[i, k] ^ FLIPS, i] = True
            self.blocks[length] = fps, near
        #: By item length: the items that hold a shingle, and whether an item repeats one.
        self.holders: dict[int, dict[int, list[int]]] = {}
        self.repeats = {}
        for length, group in self.by_length.items():
            holders = self.holders[length] = {}
            for i, (_, _, counts) in enumerate(group):
                for h in counts:
                    holders.setdefault(h, []).append(i)
            self.repeats[length] = np.array([max(counts.values()) > 1 for _, _, counts in group])

    def candidates(self, length: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) positions within RADIUS: found by the blocks, checked on all bits."""
        own, near = self.blocks[length]
        values = fps.view(np.uint8).reshape(-1, BLOCKS)
        hit = reduce(np.logical_or, (near[k][values[:, k]] for k in range(BLOCKS)))
        w, i = np.nonzero(hit)
        close = np.bitwise_count(fps[w] ^ own[i]) <= RADIUS
        return w[close], i[close]

    def sharing(self, length: int, counts: Counter, spare: float) -> set[int]:
        """Items that hold a shingle of the window, if all but ``spare`` of its shingles must be shared."""
        holders, found, seen = self.holders[length], set(), 0
        for h in sorted(counts, key=lambda h: len(holders.get(h, ()))):
            found.update(holders.get(h, ()))
            seen += counts[h]
            if seen > spare:
                break
        return found

    def hits(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words): the best window of each item."""
        n, best = len(hashes), {}
        if not n:
            return []

        def verify(length, i, x, window):
            item_id, _, counts = self.by_length[length][i]
            alike = similarity(window, counts)
            if alike >= SIMILARITY and (alike, -x) > best.get((length, i), (0, 0))[:2]:
                best[length, i] = (alike, -x, item_id)

        grams, latest = {}, {}
        for m, known in self.known.items():
            size = m if m < SHINGLE else min(SHINGLE, n)
            s = ngrams(hashes, size)
            at = np.searchsorted(known, s)
            grams[m] = s, known[np.minimum(at, len(known) - 1)] == s
        if not any(hit.any() for _, hit in grams.values()):
            return []
        for length in self.by_length:
            s, hit = grams[min(length, SHINGLE)]
            if not hit.any():
                continue
            per = min(length, n) - min(length, SHINGLE, n) + 1  # shingles in a window
            places = np.flatnonzero(hit)
            # Windows that hold a known shingle, in pieces of neighbouring starts.
            mark = np.zeros(len(s) + 1, np.int32)
            np.add.at(mark, np.maximum(places - per + 1, 0), 1)
            np.add.at(mark, places + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1])[:len(s) - per + 1] > 0)
            for at in range(0, len(starts), 4096):
                some = starts[at:at + 4096]
                lo, hi = some[0], some[-1] + per
                if hi - lo > 8 * (len(some) + per):  # far apart: one by one
                    fps = np.array([sim_hash(s[x:x + per]) for x in some.tolist()], U64)
                else:
                    bits = np.unpackbits(s[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums = np.zeros((len(bits) + 1, 64), np.int32)
                    np.cumsum(bits, axis=0, out=sums[1:])
                    votes = sums[some - lo + per] - sums[some - lo]
                    fps = np.packbits(2 * votes > per, axis=1, bitorder="little").view(U64)[:, 0]
                for w, i in zip(*self.candidates(length, np.ascontiguousarray(fps))):
                    x = int(some[w])
                    verify(length, i, x, Counter(s[x:x + per].tolist()))
            # Where the window or the item repeats shingles: without fingerprints. Fewer shared shingles than least are too few.
            least = SIMILARITY / (1 + SIMILARITY) * (length - min(length, SHINGLE) + 1 + per) - 1e-6
            if len(places) < least:
                continue
            m = min(length, SHINGLE)
            if m not in latest:
                latest[m] = latest_repeat(s)
            inside = np.concatenate([[0], np.cumsum(hit)])
            full = np.flatnonzero(inside[per:] - inside[:-per] >= least)
            own = latest[m][full + per - 1] >= full
            if not self.repeats[length].any():
                full, own = full[own], own[own]
            for x, repeated in zip(full.tolist(), own.tolist()):
                window = Counter(s[x:x + per].tolist())
                for i in self.sharing(length, window, per - least):
                    if repeated or self.repeats[length][i]:
                        verify(length, i, x, window)
        return [(item, alike, -x, min(length, n)) for (length, _), (alike, x, item) in best.items()]


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int):
    """The items in lists of bounded size."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(held) >= block_items or size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = 10_000, block_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): every document and item that match."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word int, n_words int"

    def scan(index):
        def run(batches):
            hashing = WordHash()
            for b in batches:
                out = []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    out += [(i, *h) for h in index.value.hits(hashing.of(word_list(t.as_py())))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) if k else pa.array(x, pa.int64()) for k, x in enumerate(zip(*out))],
                                                     ["doc_id", "item_id", "similarity", "first_word", "n_words"]).cast(target)
        target = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                            ("first_word", pa.int32()), ("n_words", pa.int32())])
        return run

    parts = [clean_docs(docs).mapInArrow(scan(spark.sparkContext.broadcast(ItemIndex(block))), schema)
             for block in item_blocks(benchmark, block_items, block_bytes)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
