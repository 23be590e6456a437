"""Suffix-array dedup by linear grouping construction (operator 1).

A byte is removed if a string of ``window`` bytes that covers it also starts
earlier (in a smaller doc_id, or earlier in the same document).

1. Buckets. In every window the smallest hash of its ``ANCHOR``-byte strings
   marks an anchor; equal windows mark equal anchors at equal places. An
   anchor's context is all that windows around it can hold: ``window`` bytes
   less the anchor to both sides. Anchors are dealt to buckets by hash. Of
   equal contexts (by a 128-bit cryptographic digest of their bytes) the first
   stays; the later ones are covered by it whole.
2. Suffix arrays. Where an anchor has several different contexts, these are
   suffix sorted together: cut into units of ``UNIT`` bytes aligned on the
   anchor, named in byte order, concatenated, and sorted by ``suffix_array``
   below. Suffixes next to each other give the longest common prefixes, and
   windows that are equal lie next to each other, also where they end
   mid-unit; a window that starts mid-unit is the suffix at the next unit
   border together with the bytes before it. All but the first of equal
   windows are covered.
3. The covered bytes are taken out of each document.

``suffix_array`` constructs in linear time: suffixes are grouped by their
longest Lyndon prefix. Groups are processed in descending order; each member's
pointer to the previous smaller suffix is found by hopping over larger ones,
and the group's word is appended to those suffixes, which moves them to a new
group right above their old one. Then the groups' suffixes are emitted in
ascending order: emitting a suffix places those that it is the next smaller
suffix of at the front of their groups. Nothing is renamed or recursed into.

Only hashes and positions are shuffled per anchor (one for about 28 bytes);
the texts are shuffled once, to meet their open anchors and covered places.
A map task settles equal contexts among the ``HELD`` positions it holds before
it deals them out, so a string that very many documents share costs a bucket
one position per ``HELD``. An anchor with more than ``HOT`` different contexts
is not sorted in one task: its windows are dealt out by their own digests, as
suffix buckets of the full window length, where all order left is that of the
positions; equal windows of a batch are settled before the shuffle here too. A
map task that holds more than ``HOT_HELD`` different contexts of an anchor
sends them this way at once and tells the anchor's bucket, which does the same
with what it gets of it.

Defined cases: null and empty texts have no bytes; texts shorter than the
window lose nothing; of rows with the same doc_id the one with the smallest text
has it, the others and rows without doc_id count as documents after all others,
in order of id and text (each row gets a row); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import U64, clean_docs, deal, mix, own_ids, pack, run_starts, shuffle_partitions, unpack, with_given_ids

WINDOW, ANCHOR, UNIT = 100, 40, 15
#: Bytes hashed at a time (in cache), and the overlap of the pieces of a longer text.
PIECE, OVERLAP = 1 << 18, 512
#: Different contexts of an anchor that one task sorts together.
HOT = 20_000
#: Positions that a map task holds, and different contexts of an anchor among them that make it hot.
HELD, HOT_HELD = 1 << 20, 512
#: Bytes of contexts that are sorted at a time.
CHUNK = 1 << 21

BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers; the last one must be smaller than all others."""
    n = len(text)
    # Groups are a linked list in ascending order; a group's members may have left it (group[i] tells).
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    size: list[int] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        g = len(members)
        m = by_symbol[c]
        members.append(m)
        size.append(len(m))
        below.append(g - 1)
        above.append(g + 1)
        for i in m:
            group[i] = g
    above[-1] = -1
    top = len(members) - 1
    smaller = [-2] * n  # pointer to the previous smaller suffix; -2: not processed
    order = []
    g = top
    while g >= 0:
        order.append(g)
        if size[g] == 1 and len(members[g]) == 1:
            i = members[g][0]
            j = i - 1
            while j >= 0 and smaller[j] != -2:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                old = group[j]
                if size[old] > 1:
                    new = len(members)
                    members.append([j])
                    size.append(1)
                    size[old] -= 1
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    group[j] = new
        else:
            own = [i for i in members[g] if group[i] == g]
            own.sort()
            members[g] = own
            times: dict[int, int] = {}
            for i in own:
                smaller[i] = -3  # of this group: hopped over like those above
            for i in own:
                j = i - 1
                while j >= 0 and smaller[j] != -2:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            # Suffixes of one old group that are followed by the word equally often move together, the most often highest.
            moved: dict[int, dict[int, list[int]]] = {}
            for j, k in times.items():
                moved.setdefault(group[j], {}).setdefault(k, []).append(j)
            for old, by_times in moved.items():
                for k in sorted(by_times, reverse=True):
                    js = by_times[k]
                    if len(js) == size[old]:
                        continue  # all that is left of the group moves: it stays where it is
                    new = len(members)
                    members.append(js)
                    size.append(len(js))
                    size[old] -= len(js)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    for j in js:
                        group[j] = new
        g = below[g]
    front = [0] * len(members)
    at = 0
    for g in reversed(order):
        front[g] = at
        at += size[g]
    out = [0] * n
    out[0] = n - 1
    for k in range(n):
        i = out[k]
        stop = smaller[i]
        j = i - 1
        while j != stop:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = smaller[j]
    return out


class Anchors:
    """Rolling hashes and anchors of concatenated texts; powers are made once per task."""

    def __init__(self, window: int):
        self.window, self.reach = window, window - ANCHOR
        self.up, self.down = (self._powers(b) for b in (BASE[0], pow(BASE[0], -1, 1 << 64)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        a = np.full(PIECE + 2 * OVERLAP + 2, U64(base))
        a[0] = 1
        return np.multiply.accumulate(a)

    def of(self, texts: list[bytes], within: list[tuple[int, int]]):
        """(text number, position, anchor hash, two halves of the context's digest) of the anchors within the places to report."""
        n_gram, reach, window = ANCHOR, self.reach, self.window
        joined = b"".join(texts)
        buf = np.frombuffer(joined, np.uint8).astype(U64) + U64(1)
        n = len(buf)
        none = np.zeros(0, np.int64)
        if n < window:
            return none, none, none.astype(U64), none.astype(U64), none.astype(U64)
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sums = np.zeros(n + 1, U64)
        np.cumsum(buf * self.up[:n], out=sums[1:])
        x = mix((sums[n_gram:] - sums[:-n_gram]) * self.down[:n + 1 - n_gram])
        cross = np.zeros(len(x), bool)
        for e in start[1:-1].tolist():
            cross[max(0, e - n_gram + 1):e] = True
        x[cross] = ~U64(0)
        least = _slide(x, reach + 1, np.minimum)
        pad = np.zeros(reach, U64)
        at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), reach + 1, np.maximum) == x) & ~cross)
        t = np.searchsorted(start, at, "right") - 1
        lo, hi = np.maximum(start[t], at - reach), np.minimum(start[t + 1], at + window)
        pos = at - start[t]
        limits = np.array(within, np.int64).reshape(-1, 2)
        keep = (hi - lo >= window) & (pos >= limits[t, 0]) & (pos < limits[t, 1])
        at, t, lo, hi, pos = at[keep], t[keep], lo[keep], hi[keep], pos[keep]
        # Equal contexts are told by a 128-bit cryptographic digest of their bytes, and by where the anchor lies in them.
        digest = b"".join([hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
        digest = np.frombuffer(digest, U64).reshape(-1, 2)
        return t, pos, x[at], digest[:, 0] + (at - lo).astype(U64) * U64(BASE[0]), digest[:, 1] + (hi - at).astype(U64) * U64(BASE[0])


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    y, have = x, 1
    while 2 * have <= width:
        y = f(y[:-have], y[have:])
        have *= 2
    rest = width - have
    return f(y[:-rest], y[rest:]) if rest else y


def _pieces(batches, window: int):
    """Slices of (doc_ids, offsets, pieces, whole, within): about PIECE bytes each; longer texts in overlapping pieces."""
    held, size = [], 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            data = text.as_py().encode("utf-8", "surrogatepass")
            if len(data) <= PIECE:
                parts = [(doc_id, 0, data, (0, len(data)))]
            else:
                parts = []
                for a in range(0, len(data), PIECE):
                    lo, hi = max(0, a - OVERLAP), min(len(data), a + PIECE + OVERLAP)
                    parts.append((doc_id, lo, data[lo:hi], (a - lo, min(a + PIECE, len(data)) - lo)))
            for p in parts:
                if size and size + len(p[2]) > PIECE:
                    yield tuple(zip(*held))
                    held, size = [], 0
                held.append(p)
                size += len(p[2])
    if held:
        yield tuple(zip(*held))


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else
                                      [pa.array([], t) for t in types], names)


def _by_doc(doc: np.ndarray, *arrays: np.ndarray):
    """(doc, packed arrays) per document."""
    if not len(doc):
        return
    order = np.argsort(doc)
    doc = doc[order]
    cut = np.flatnonzero(run_starts(doc))
    ends = np.append(cut[1:], len(doc))
    arrays = [a[order] for a in arrays]
    for a, b in zip(cut.tolist(), ends.tolist()):
        yield int(doc[a]), pack(*(x[a:b] for x in arrays))


#: Kinds of a document's marks: contexts covered whole, open anchors, open anchors of hot groups, covered windows.
COVERED, OPEN, OPEN_HOT, STARTS = 0, 1, 2, 3
#: Kinds of a bucket's rows: positions of anchors, and keys of anchors that are hot.
POSITIONS, HOT_KEYS = 4, 5
MARKS = "doc_id long, kind byte, data binary"
MARK_NAMES, MARK_TYPES = ["doc_id", "kind", "data"], [pa.int64(), pa.int8(), pa.binary()]


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run."""
    first = np.flatnonzero(run_starts(sorted_keys))
    return first, np.diff(np.append(first, len(sorted_keys)))


def anchor_marks(docs: DataFrame, window: int, hot: int = HOT, hot_held: int = HOT_HELD) -> DataFrame:
    """MARKS of kinds COVERED (positions) and OPEN, OPEN_HOT (anchor keys and positions)."""
    n_buckets = shuffle_partitions(docs)
    names, types = ["bucket", *MARK_NAMES], [pa.int32(), *MARK_TYPES]

    def keys_of(h):
        """Bucket and key of anchor hashes; the key holds the bucket and the 48 bits that are sent."""
        bucket = ((h >> U64(48)) % U64(n_buckets)).astype(np.int64)
        return bucket, (h & U64((1 << 48) - 1)).astype(np.int64) | bucket << 48

    def dealt(held):
        h, ctx, ctx2, doc, pos = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        _, size = _runs(h[order])
        many = np.repeat(size > 1, size)
        alone, some = order[~many], order[many]
        some = some[np.lexsort((pos[some], doc[some], ctx2[some], ctx[some], h[some]))]
        new = run_starts(h[some], ctx[some], ctx2[some])
        late, some = some[~new], some[new]
        first, size = _runs(h[some])
        wide = np.repeat(size > hot_held, size)
        heads, own, rest = some[first[size > hot_held]], some[wide], np.concatenate([alone, some[~wide]])
        out = [(d % n_buckets, d, COVERED, x) for d, x in _by_doc(doc[late], pos[late])]
        out += [(d % n_buckets, d, OPEN_HOT, x) for d, x in _by_doc(doc[own], keys_of(h[own])[1], pos[own])]
        bucket, key = keys_of(h[heads])
        out += [(b, None, HOT_KEYS, x) for b, x in deal(bucket, n_buckets, key)]
        h, ctx, ctx2, doc, pos = h[rest], ctx[rest], ctx2[rest], doc[rest], pos[rest]
        out += [(b, None, POSITIONS, x) for b, x in deal(keys_of(h)[0], n_buckets, h.astype(np.uint32),
                                                        (h >> U64(32)).astype(np.uint16), ctx, ctx2, doc, pos)]
        return _batch(out, names, types)

    def scan(batches):
        anchors, held, n = Anchors(window), [], 0
        for ids, offsets, parts, within in _pieces(batches, window):
            t, pos, h, ctx, ctx2 = anchors.of(parts, within)
            held.append((h, ctx, ctx2, np.array(ids, np.int64)[t], (pos + np.array(offsets, np.int64)[t]).astype(np.uint32)))
            n += len(t)
            if n >= HELD:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    def match(batches):
        by_bucket: dict[int, list] = {}
        hot_keys: dict[int, list] = {}
        for b in batches:
            kinds = b.column("kind").to_numpy()
            yield b.filter(pa.array(kinds < POSITIONS)).select(MARK_NAMES)
            for bucket, kind, data in zip(*(b.filter(pa.array(kinds >= POSITIONS)).column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                (by_bucket if kind == POSITIONS else hot_keys).setdefault(bucket, []).append(data)
        while by_bucket:
            bucket, blobs = by_bucket.popitem()
            low, high, ctx, ctx2, doc, pos = (np.concatenate(x) for x in zip(*(
                unpack(d, np.uint32, np.uint16, np.uint64, np.uint64, np.int64, np.uint32) for d in blobs)))
            del blobs
            key = low.astype(np.int64) | high.astype(np.int64) << 32 | np.int64(bucket) << 48
            told = np.unique(np.concatenate([unpack(d, np.int64)[0] for d in hot_keys.get(bucket, ())] or [np.zeros(0, np.int64)]))
            order = np.argsort(key)
            first, size = _runs(key[order])
            # Anchors that occur once cover nothing, unless their other places went the hot way.
            order = order[np.repeat((size > 1) | np.isin(key[order[first]], told), size)]
            key, ctx, ctx2, doc, pos = key[order], ctx[order], ctx2[order], doc[order], pos[order]
            order = np.lexsort((pos, doc, ctx2, ctx, key))
            key, ctx, ctx2, doc, pos = key[order], ctx[order], ctx2[order], doc[order], pos[order]
            new = run_starts(key, ctx, ctx2)
            out = [(d, COVERED, x) for d, x in _by_doc(doc[~new], pos[~new])]
            key, doc, pos = key[new], doc[new], pos[new]
            first, size = _runs(key)
            wide = np.repeat((size > hot) | np.isin(key[first], told), size)
            open_ = np.repeat(size > 1, size) & ~wide
            for kind, some in ((OPEN, open_), (OPEN_HOT, wide)):
                out += [(d, kind, x) for d, x in _by_doc(doc[some], key[some], pos[some])]
            yield _batch(out, MARK_NAMES, MARK_TYPES)

    return docs.mapInArrow(scan, "bucket int, " + MARKS).repartition(n_buckets, "bucket").mapInArrow(match, MARKS)


def covered_windows(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of windows that an earlier context holds too; starts count from the left edge of ``left``.

    Contexts are rows in ascending order of their places: left (right-aligned) and right (left-aligned, from the
    anchor on) bytes with their numbers. Contexts of different anchors may be given together.
    """
    n, reach = left.shape
    rows = np.concatenate([left, right], axis=1)
    units = reach // UNIT
    # Symbols: units named by rank in byte order (a shorter end first), so that those with equal first bytes lie together;
    # anchors, which every window holds whole, by hash. 0 ends the text, 1 separates contexts.
    high = np.zeros((n, 2 * units + 2), U64)
    low = np.zeros(high.shape, U64)
    used = np.zeros(high.shape, bool)
    anchor = rows[:, reach:reach + ANCHOR]
    high[:, units] = [xxhash.xxh64_intdigest(a) for a in np.ascontiguousarray(anchor)]
    low[:, units] = ANCHOR
    used[:, units] = True
    word = np.zeros((n, UNIT + 1), np.uint8)  # the unit's bytes and their number
    for u in range(units):
        at = reach + ANCHOR + u * UNIT
        have = np.clip(n_right - ANCHOR - u * UNIT, 0, UNIT)
        for k, part, number in ((u, rows[:, u * UNIT:(u + 1) * UNIT], UNIT),
                                (units + 1 + u, np.where(np.arange(UNIT) < have[:, None], rows[:, at:at + UNIT], 0), have)):
            word[:, :UNIT], word[:, UNIT] = part, number
            high[:, k], low[:, k] = word.view(">u8").T
        used[:, u] = n_left >= reach - u * UNIT
        used[:, units + 1 + u] = have > 0
    used[:, -1] = True
    ranks = np.zeros(used.shape, np.int64)
    inner = used.copy()
    inner[:, -1] = False
    high, low = high[inner], low[inner]
    order = np.lexsort((low, high))
    name = np.zeros(len(order), np.int64)
    name[order] = np.cumsum(run_starts(high[order], low[order])) + 1
    ranks[inner] = name
    ranks[:, -1] = 1
    flat = np.flatnonzero(used.ravel())
    text = ranks.ravel()[flat].tolist() + [0]
    sa = np.array(suffix_array(text), np.int64)
    sa = sa[sa < len(flat)]
    col = flat[sa] % used.shape[1]
    keep = col <= units  # suffixes that start at a unit border at or before the anchor
    ctx, border = flat[sa[keep]] // used.shape[1], col[keep] * UNIT
    first_byte = reach - n_left
    end = reach + n_right
    # Longest common prefixes of neighbours, up to the window.
    wide = np.arange(window)
    lcp = np.zeros(len(ctx), np.int64)
    for a in range(1, len(ctx), 8192):
        b = min(a + 8192, len(ctx))
        p = rows[ctx[a - 1:b, None], np.minimum(border[a - 1:b, None] + wide, rows.shape[1] - 1)]
        have = np.minimum(end[ctx[a - 1:b]] - border[a - 1:b], window)
        differ = p[1:] != p[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
        lcp[a:b] = np.minimum(same, np.minimum(have[1:], have[:-1]))
    out_ctx, out_start = [], []
    before = [np.zeros(len(ctx), U64), np.zeros(len(ctx), U64)]
    for d in range(UNIT):
        s = border - d
        if d:
            byte = rows[ctx, np.maximum(s, 0)].astype(U64)
            before[(d - 1) // 8] |= byte << U64(8 * ((d - 1) % 8))
        fine = np.flatnonzero((s >= first_byte[ctx]) & (s + window <= end[ctx]))
        kind = np.cumsum(lcp < window - d)[fine]
        keys = [before[1][fine], before[0][fine], border[fine], kind] if d else [border[fine], kind]
        order = np.lexsort((ctx[fine], *keys))
        late = fine[order][~run_starts(*(k[order] for k in keys))]
        out_ctx.append(ctx[late])
        out_start.append(s[late])
    return np.concatenate(out_ctx), np.concatenate(out_start)


def open_windows(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """MARKS of kind STARTS: covered window starts, from the open anchors' contexts."""
    reach, n_buckets = window - ANCHOR, shuffle_partitions(docs)
    open_ = marks.where(F.col("kind").isin(OPEN, OPEN_HOT)).groupBy("doc_id").agg(
        F.collect_list(F.struct("kind", "data")).alias("anchors"))
    # One pass over the texts gives contexts (kind OPEN) and, of hot anchors, window digests (kind OPEN_HOT) and
    # windows already known to come later (kind STARTS, packed).
    schema = "kind byte, key long, doc_id long, pos long, n_left int, context binary"
    names = ["kind", "key", "doc_id", "pos", "n_left", "context"]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def contexts(batches):
        first, late = {}, {}  # of the hot windows held: place of the earliest by digest; the others by document

        def settled():
            rows = [(OPEN_HOT, int.from_bytes(x[:8], "little", signed=True), d, s, 0, x) for x, (d, s) in first.items()]
            rows += [(STARTS, d, d, 0, 0, pack(np.array(s, np.uint32))) for d, s in late.items()]
            first.clear()
            late.clear()
            return _batch(rows, names, types)

        for b in batches:
            out = []
            for doc_id, text, anchors in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("anchors").to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for a in anchors:
                    key, pos = unpack(a["data"], np.int64, np.uint32)
                    for k, p in zip(key.tolist(), pos.tolist()):
                        lo, hi = max(0, p - reach), min(len(data), p + window)
                        if a["kind"] == OPEN:
                            out.append((OPEN, k, doc_id, p, p - lo, data[lo:hi]))
                            continue
                        for s in range(lo, hi - window + 1):
                            digest, here = xxhash.xxh3_128_digest(data[s:s + window]), (doc_id, s)
                            least = first.setdefault(digest, here)
                            if here < least:
                                first[digest], here = here, least
                            elif here == least:
                                continue
                            late.setdefault(here[0], []).append(here[1])
                if len(out) > 20_000:
                    yield _batch(out, names, types)
                    out = []
                if len(first) > 200_000:
                    yield settled()
            if out:
                yield _batch(out, names, types)
        if first:
            yield settled()

    def settle(batches):
        held, size = [], 0

        def hot_groups(t):
            t = t.sort_by([("key", "ascending"), ("context", "ascending"), ("doc_id", "ascending"), ("pos", "ascending")])
            digest = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint64).reshape(-1, 2)
            new = run_starts(digest[:, 0], digest[:, 1])
            doc, pos = t.column("doc_id").to_numpy(), t.column("pos").to_numpy()
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # Contexts overlap, so the first window may come several times.
            late = (doc != doc[first]) | (pos != pos[first])
            return doc[late], pos[late]

        def groups(t):
            t = t.sort_by([("doc_id", "ascending"), ("pos", "ascending")])
            doc, pos = t.column("doc_id").to_numpy(), t.column("pos").to_numpy()
            n_left = t.column("n_left").to_numpy().astype(np.int64)
            data = t.column("context").to_pylist()
            left = np.frombuffer(b"".join(x[:k].rjust(reach, b"\0") for x, k in zip(data, n_left.tolist())), np.uint8).reshape(-1, reach)
            right = np.frombuffer(b"".join(x[k:].ljust(window, b"\0") for x, k in zip(data, n_left.tolist())), np.uint8).reshape(-1, window)
            n_right = np.fromiter(map(len, data), np.int64, len(data)) - n_left
            c, s = covered_windows(left, right, n_left, n_right, window)
            return doc[c], pos[c] - reach + s

        def result(tables):
            t = pa.concat_tables(tables).combine_chunks()
            kinds = t.column("kind").to_numpy()
            out = []
            for kind, f in ((OPEN, groups), (OPEN_HOT, hot_groups)):
                if (kinds == kind).any():
                    doc, start = f(t.filter(pa.array(kinds == kind)))
                    out += [(d, STARTS, x) for d, x in _by_doc(doc, start.astype(np.uint32))]
            early = t.filter(pa.array(kinds == STARTS))
            out += zip(early.column("doc_id").to_pylist(), [STARTS] * len(early), early.column("context").to_pylist())
            return _batch(out, MARK_NAMES, MARK_TYPES)

        for b in batches:
            t = pa.Table.from_batches([b])
            keys = t.column("key").to_numpy()
            # Whole keys only: a key may go on in the next batch.
            edges = np.flatnonzero(run_starts(keys))
            at = 0
            lengths = np.cumsum(pa.compute.binary_length(t.column("context")).to_numpy())
            for e in edges.tolist():
                done = int(lengths[e - 1]) - (int(lengths[at - 1]) if at else 0) if e > at else 0
                if size + done >= CHUNK and (e or not held or held[-1].column("key")[-1].as_py() != keys[0]):
                    if e > at:
                        held.append(t.slice(at, e - at))
                    yield result(held)
                    held, size, at = [], 0, e
            held.append(t.slice(at))
            size += int(lengths[-1]) - (int(lengths[at - 1]) if at else 0)
        if held:
            yield result(held)

    rows = docs.join(open_, "doc_id").select("doc_id", "text", "anchors").mapInArrow(contexts, schema)
    return rows.repartition(n_buckets, "key").sortWithinPartitions("kind", "key").mapInArrow(settle, MARKS)


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT, hot_held: int = HOT_HELD) -> DataFrame:
    """(doc_id, text, spans, n_bytes, n_removed, n_spans, kept_sha256).

    spans are the removed byte ranges, and the numbers and the digest follow them. text is what is left as a string:
    there a character that a span's edge cuts through stays whole.
    """
    rows, given = own_ids(clean_docs(docs))
    marks = anchor_marks(rows, window, hot, hot_held)
    covered = marks.where(F.col("kind") == COVERED).union(open_windows(rows, marks, window))
    per_doc = covered.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "data")).alias("marks"))
    reach = window - ANCHOR
    schema = ("doc_id long, text string, spans array<struct<start:long,end:long>>, n_bytes long, n_removed long, "
              "n_spans long, kept_sha256 string")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, found in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("marks").to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                mark = np.zeros(len(data) + 1, np.int32)
                for m in found or ():
                    at = unpack(m["data"], np.uint32)[0].astype(np.int64)
                    lo, hi = (at - reach, at + window) if m["kind"] == COVERED else (at, at + window)
                    np.add.at(mark, np.maximum(lo, 0), 1)
                    np.add.at(mark, np.minimum(hi, len(data)), -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                raw = np.frombuffer(data, np.uint8)
                kept = raw[~gone].tobytes() if edge else data
                inside = np.append(raw & 0xC0 == 0x80, False)  # bytes that go on with a character
                clean, at = [], 0
                for s, e in edge:
                    while s < e and inside[s]:
                        s += 1
                    while e > s and inside[e]:
                        e -= 1
                    clean.append(data[at:s])
                    at = e
                clean = b"".join([*clean, data[at:]]).decode("utf-8", "surrogatepass")
                out.append((doc_id, clean, [{"start": s, "end": e} for s, e in edge], len(data), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
            yield _batch(out, ["doc_id", "text", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                         [pa.int64(), pa.string(), span, pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return with_given_ids(rows.join(per_doc, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(cut, schema), given)
