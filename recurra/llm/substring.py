"""Substring dedup with fixed-block anchors (operator 7).

Words are runs of bytes other than ASCII white space. A window is ``window``
consecutive words of one document; a word is removed if a window that covers
it also starts in a document with a smaller doc_id.

1. Anchors. Every document is cut into non-overlapping reference blocks of
   (window + 1) // 2 words, so that any window holds a whole block. The blocks
   are indexed by hash, and every rolling block-sized window of every document
   probes the index. Index and probes travel together: a position is a block
   of the index if it lies on its document's block grid. A position is a hit
   if another position with its hash lies on the grid (or it does itself).
2. Extension. Around each hit the words to both sides are added: all windows
   that hold the hit are formed at once, and a window occurs in a smaller
   document if its digest does (128 bits, cryptographic, of the words' bytes). Neighbouring windows that do so join
   into maximal repeats.
3. Every word under such a window is removed.

Only hashes and positions are shuffled (a few bytes per word, packed per batch
and bucket); the texts are shuffled once, to meet the hits of their document.
Nothing grows with the square of a group's size: a bucket sorts its positions.
Map tasks settle first what they hold: block hits among the words of a slice
and repeats among the windows of a batch need no bucket, which then gets one
position for them. So words or passages that a third of all documents share
cost a bucket about one position per slice or batch.
Hash clashes of step 1 cost work only; of step 2's digests 96 bits and the bucket travel.

Defined cases: null and empty texts have no words; documents shorter than a
window lose nothing; of rows with the same doc_id the one with the smallest text has it,
the others and rows without doc_id count as documents after all others, in order
of id and text (each row gets a row); equal texts under different ids
lose all words that a window covers, but for the smallest id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import U64, WordHash, clean_docs, deal, materialize, mix, ngrams, own_ids, pack, run_starts, shuffle_partitions, text_slices, unpack, with_given_ids

WINDOW = 13
#: Bytes of text that a map task hashes and settles at a time.
SLICE = 1 << 22
#: Kinds of rows: a slice's documents, hits, positions for a bucket.
HEAD, HIT, PROBE = 0, 1, 2


def _rows(out: list[tuple], names: list[str], types: list[pa.DataType]):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else
                                      [pa.array([], t) for t in types], names)


def _slices(batches, hashing: WordHash, size: int, keep: bool = False):
    """Per slice: ids, first word of each document, words of each, word hashes, and the words if they are kept."""
    for ids, texts in text_slices(batches, size):
        flat, n = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            words = t.split()
            n[k] = len(words)
            flat += words
        hashes = hashing.of(flat)
        if not keep:
            flat = None  # else the words would live on while their hashes are dealt out
        yield ids, np.cumsum(n) - n, n, hashes, flat


def hits(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, hits): packed word positions where an indexed block is hit; documents without hits are left out."""
    block, n_buckets = (window + 1) // 2, shuffle_partitions(docs)
    names, types = ["bucket", "batch", "kind", "data"], [pa.int32(), pa.int64(), pa.int8(), pa.binary()]
    schema = "bucket int, batch long, kind byte, data binary"

    def probe(batches):
        from pyspark import TaskContext
        hashing, batch = WordHash(), TaskContext.get().partitionId() << 32
        for ids, starts, n, words, _ in _slices(batches, hashing, SLICE):
            grams = ngrams(words, block)
            at = np.flatnonzero(np.repeat(starts + n, n)[:len(grams)] - np.arange(len(grams)) >= block)
            h = grams[at]
            on_grid = (at - np.repeat(starts, n)[at]) % block == 0
            # Runs of the slice with a block of the index and at least two positions are hits; one of them stands for all.
            order = np.argsort(h)
            first = np.flatnonzero(run_starts(h[order]))
            size = np.diff(np.append(first, len(h)))
            known = (np.add.reduceat(on_grid[order].astype(np.int64), first) > 0) & (size > 1) if len(h) else size > 1
            sure = order[np.repeat(known, size)]
            on_grid[order[first[known]]] = True
            others = np.ones(len(h), bool)
            others[sure] = False
            others[order[first[known]]] = True
            out = [(batch % n_buckets, batch, HEAD, pack(np.array(ids, np.int64), starts))]
            if len(sure):
                out.append((batch % n_buckets, batch, HIT, pack(at[sure].astype(np.uint32))))
            h, at, on_grid = h[others], at[others], on_grid[others]
            low = ((h & U64(0x7FFFFFFF)) << U64(1) | on_grid.astype(U64)).astype(np.uint32)
            out += [(b, batch, PROBE, data) for b, data in deal(((h >> U64(33)) % U64(n_buckets)).astype(np.int64), n_buckets, low, at.astype(np.uint32))]
            yield _rows(out, names, types)
            batch += 1

    def match(batches):
        by_bucket: dict[int, list] = {}
        for b in batches:
            out = []
            for bucket, batch, kind, data in zip(*(b.column(c).to_pylist() for c in names)):
                if kind != PROBE:
                    out.append((0, batch, kind, data))
                else:
                    by_bucket.setdefault(bucket, []).append((batch, data))
            yield _rows(out, names, types)
        while by_bucket:
            _, blobs = by_bucket.popitem()
            arrays = [unpack(d, np.uint32, np.uint32) for _, d in blobs]
            low, sizes = np.concatenate([a[0] for a in arrays]), [len(a[0]) for a in arrays]
            order = np.argsort(low >> 1)
            s = low[order]
            first = np.flatnonzero(run_starts(s >> 1))
            grid = np.add.reduceat((s & 1).astype(np.int64), first)
            size = np.diff(np.append(first, len(s)))
            # A run with a block of the index and at least two positions: all of them matter.
            hit = np.zeros(len(low), bool)
            hit[order] = np.repeat((grid > 0) & (size > 1), size)
            out, at = [], 0
            for (batch, _), (_, pos), n in zip(blobs, arrays, sizes):
                mine = pos[hit[at:at + n]]
                at += n
                if len(mine):
                    out.append((0, batch, HIT, pack(mine)))
            if out:
                yield _rows(out, names, types)

    def resolve(batches):
        heads, found = {}, {}
        for b in batches:
            for batch, kind, data in zip(*(b.column(c).to_pylist() for c in names[1:])):
                if kind == HEAD:
                    heads[batch] = data
                else:
                    found.setdefault(batch, []).append(data)
        for batch, blobs in found.items():
            ids, starts = unpack(heads[batch], np.int64, np.int64)
            pos = np.unique(np.concatenate([unpack(d, np.uint32)[0] for d in blobs]).astype(np.int64))
            doc = np.searchsorted(starts, pos, "right") - 1
            cut = np.flatnonzero(run_starts(doc))
            out = [(int(ids[d]), pack((p - starts[d]).astype(np.uint32))) for d, p in zip(doc[cut].tolist(), np.split(pos, cut[1:]))]
            yield _rows(out, ["doc_id", "hits"], [pa.int64(), pa.binary()])

    found = docs.mapInArrow(probe, schema).repartition(n_buckets, "bucket").mapInArrow(match, schema)
    return found.repartition(n_buckets, "batch").mapInArrow(resolve, "doc_id long, hits binary")


def repeated_windows(docs: DataFrame, hit_rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): packed starts of the windows that also start in a smaller doc_id; one row per document."""
    block, n_buckets = (window + 1) // 2, shuffle_partitions(docs)
    reach = window - block
    names, types = ["bucket", "kind", "data"], [pa.int32(), pa.int8(), pa.binary()]

    def later(lo, hi, doc):
        """Whether each window also starts in a smaller document."""
        order = np.argsort(lo)
        first = np.flatnonzero(run_starts(lo[order]))
        size = np.diff(np.append(first, len(lo)))
        order = order[np.repeat(size > 1, size)]
        order = order[np.lexsort((doc[order], hi[order], lo[order]))]
        lo, hi, least = lo[order], hi[order], doc[order]
        first = np.flatnonzero(run_starts(lo, hi))
        least = np.repeat(least[first], np.diff(np.append(first, len(lo))))
        again = np.zeros(len(doc), bool)
        again[order] = doc[order] > least
        return again

    def replies(doc, pos):
        # Replies travel in one blob per bucket and target, not in a row per bucket and document.
        return deal((mix(doc.view(U64)) % U64(n_buckets)).astype(np.int64), n_buckets, doc, pos)

    def extend(batches):
        hashing = WordHash()
        for b in batches:
            blobs, los, his, ds, ps = b.column("hits").to_pylist(), [], [], [], []
            for ids, starts, n, words, flat in _slices([b], hashing, 1 << 20, keep=True):
                mine, blobs = blobs[:len(ids)], blobs[len(ids):]
                m = len(words) - window + 1
                if m <= 0:
                    continue
                q = [unpack(x, np.uint32)[0].astype(np.int64) + a for x, a in zip(mine, starts.tolist())]
                own = np.repeat(starts, [len(x) for x in q])
                q = np.concatenate(q)
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, np.maximum(q - reach, own), 1)
                np.add.at(mark, q + 1, -1)
                inside = np.repeat(starts + n, n)[:m] - np.arange(m) >= window
                at = np.flatnonzero((np.cumsum(mark)[:m] > 0) & inside)
                digest = bytearray(16 * len(at))
                for k, i in enumerate(at.tolist()):
                    digest[16 * k:16 * k + 16] = hashlib.blake2b(b" ".join(flat[i:i + window]), digest_size=16).digest()
                digest = np.frombuffer(bytes(digest), U64).reshape(-1, 2)
                los.append(digest[:, 0].copy())
                his.append(digest[:, 1].copy())
                ds.append(np.repeat(np.array(ids, np.int64), n)[at])
                ps.append((at - np.repeat(starts, n)[at]).astype(np.uint32))
            if los:
                lo, hi, doc, pos = map(np.concatenate, (los, his, ds, ps))
                late = later(lo, hi, doc)
                out = [(b, HIT, data) for b, data in replies(doc[late], pos[late])]
                lo, hi, doc, pos = lo[~late], hi[~late], doc[~late], pos[~late]
                out += [(b, PROBE, data) for b, data in deal((hi % U64(n_buckets)).astype(np.int64), n_buckets, lo, (hi >> U64(32)).astype(np.uint32), doc, pos)]
                yield _rows(out, names, types)

    def settle(batches):
        by_bucket: dict[int, list] = {}
        for b in batches:
            out = []
            for bucket, kind, data in zip(*(b.column(c).to_pylist() for c in names)):
                if kind == HIT:
                    out.append((bucket, data))
                else:
                    by_bucket.setdefault(bucket, []).append(data)
            yield _rows(out, ["target", "data"], [pa.int32(), pa.binary()])
        while by_bucket:
            _, blobs = by_bucket.popitem()
            lo, hi, doc, pos = (np.concatenate(x) for x in zip(*(unpack(d, np.uint64, np.uint32, np.int64, np.uint32) for d in blobs)))
            late = later(lo, hi, doc)
            yield _rows(list(replies(doc[late], pos[late])), ["target", "data"], [pa.int32(), pa.binary()])

    def gather(batches):
        blobs = [d for b in batches for d in b.column("data").to_pylist()]
        if blobs:
            doc, pos = (np.concatenate(x) for x in zip(*(unpack(d, np.int64, np.uint32) for d in blobs)))
            order = np.argsort(doc, kind="stable")
            doc, pos = doc[order], pos[order]
            cut = np.flatnonzero(run_starts(doc))
            out = [(d, pack(p)) for d, p in zip(doc[cut].tolist(), np.split(pos, cut[1:]))]
            yield _rows(out, ["doc_id", "starts"], [pa.int64(), pa.binary()])

    rows = docs.join(hit_rows, "doc_id").select("doc_id", "text", "hits").mapInArrow(extend, "bucket int, kind byte, data binary")
    found = rows.repartition(n_buckets, "bucket").mapInArrow(settle, "target int, data binary")
    return found.repartition(n_buckets, "target").mapInArrow(gather, "doc_id long, starts binary")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, spans): the kept words joined by one space; spans are removed word ranges (start, end).

    Also n_words, n_removed and kept_sha256 (of the kept text).
    """
    # Slices are numbered within a partition; a table's or a written table's partition has the same order when made again.
    rows, given = own_ids(clean_docs(docs))
    rows = rows if given is None else materialize(docs.sparkSession, rows, "substring-rows")
    per_doc = repeated_windows(rows, hits(rows, window), window)
    schema = "doc_id long, text string, spans array<struct<start:int,end:int>>, n_words long, n_removed long, kept_sha256 string"

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, data in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("starts").to_pylist()):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                mark = np.zeros(len(words) + 1, np.int32)
                if data:
                    at = unpack(data, np.uint32)[0]
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(edge) else b" ".join(words)
                spans = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                out.append((doc_id, kept.decode("utf-8", "surrogatepass"), spans, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield _rows(out, ["doc_id", "text", "spans", "n_words", "n_removed", "kept_sha256"],
                        [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int64(), pa.string()])

    return with_given_ids(rows.join(per_doc, "doc_id", "left").select("doc_id", "text", "starts").mapInArrow(cut, schema), given)

