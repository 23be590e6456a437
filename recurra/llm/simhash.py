"""SimHash near-duplicates linked with pivot distance tables (operator 6).

A document's fingerprint is the majority of the XXH64 bits of its word
shingles. Fingerprints at ``radius`` bits or fewer are linked, and every
document gets the smallest doc_id of its linked component.

Only distinct fingerprints are compared; copies share one entry. Two
fingerprints within the radius agree in one of ``radius + 1`` bit blocks, so
each (block, value) is a bucket that must be searched. A bucket is searched
with a table of Hamming distances to fixed reference fingerprints (pivots): by
the triangle inequality two fingerprints within the radius differ by at most
the radius in every coordinate, so a pair whose largest coordinate difference
exceeds it is discarded, and survivors are verified on all 64 bits. A bucket
with very many fingerprints is cut into cells of pivot distance first (with
guests from the next cell), as often as its size asks for.

A bucket returns a spanning forest of its links, not its pairs: fingerprints
that are known to be connected are not compared again, so a group of
thousands of near copies costs about its size. No link between different
components is lost.

Defined cases: null text is empty; a text without words has fingerprint zero
and is linked like any other; a row without doc_id gets a fingerprint and a
null component; repeated rows and repeated ids each keep their row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import U64, clean_docs, materialize, mix, run_starts, shuffle_partitions
from recurra.llm.graph import components

#: Reference fingerprints: fixed, the same for every input.
PIVOTS = [int(x) for x in mix(np.arange(1, 17, dtype=U64) * U64(0x9E3779B97F4A7C15))]
#: Fingerprints of one bucket that are searched by one task without cutting.
BUCKET_ROWS = 8192
#: Width of a cell of pivot distance; wider than any radius in use.
CELL = 8


def fingerprint_of(text: str, shingle: int, seed: int = 42) -> int:
    """Majority bits of the shingle hashes; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h(b" ".join(words), seed)], U64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:n - 1].tolist()]
        hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())), U64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # byte counters hold 255
        bits = np.unpackbits(hashes[at:at + 255].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += np.add.reduce(bits.view(U64), axis=0).view(np.uint8)
    out = np.packbits(2 * votes > n)
    return int.from_bytes(out.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint_of(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(fps, U64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return clean_docs(docs).mapInArrow(run, "doc_id long, fp long")


def _pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fp ^ U64(p)).astype(np.int8) for p in PIVOTS], axis=1)


def _verified(fp, dist, i, j, radius):
    """The pairs (positions i, j) that are linked: pivots discard one after the other, all bits decide."""
    for p in range(dist.shape[1]):
        near = np.abs(dist[i, p] - dist[j, p]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[near], j[near]


def forest(fp: np.ndarray, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Links (positions) that connect all that is linked among ``fp``.

    Rows are searched in blocks against all rows still to come. When a whole
    block belongs to one component already, rows of that component are left
    out, so a dense group costs about its size.
    """
    dist = _pivot_table(fp)
    label = np.arange(len(fp))
    todo = np.argsort(dist[:, 0], kind="stable")
    found: list[tuple[int, int]] = []

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    while len(todo) > 1:
        rows, rest = todo[:block], todo[block:]
        same = (label[rows] == label[rows[0]]).all()
        cols = rest[label[rest] != label[rows[0]]] if same else todo
        first = dist[rows, 0]
        d0 = dist[cols, 0]
        cols = cols[(d0 >= first.min() - radius) & (d0 <= first.max() + radius)]
        i, j = np.nonzero(np.abs(first[:, None] - dist[cols, 0][None, :]) <= radius)
        i, j = rows[i], cols[j]
        if not same:
            i, j = i[i != j], j[i != j]
        i, j = _verified(fp, dist, i, j, radius)
        joined = False
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
                joined = True
        if joined:
            while (label[label] != label).any():
                label = label[label]
        todo = rest[np.argsort(label[rest], kind="stable")] if joined else rest
    return found


def _search(keys: list[np.ndarray], fp: np.ndarray, radius: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys (rows are sorted by them)."""
    start = np.flatnonzero(run_starts(*keys))
    size = np.diff(np.append(start, len(fp)))
    us, vs = [], []
    dist = _pivot_table(fp)
    left = np.arange(len(fp)) - np.repeat(start, size)
    wide = np.repeat(size, size)
    rows = np.flatnonzero((wide > 1) & (wide <= small))
    for d in range(1, small):
        rows = rows[left[rows] + d < wide[rows]]
        i, j = _verified(fp, dist, rows, rows + d, radius)
        us.append(fp[i])
        vs.append(fp[j])
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        for a, b in forest(fp[s:s + n], radius):
            us.append(fp[s + a:s + a + 1])
            vs.append(fp[s + b:s + b + 1])
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def links(fps: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links that connect all that is linked among the distinct fingerprints in column fp."""
    blocks = radius + 1
    bits = [64 // blocks + (j < 64 % blocks) for j in range(blocks)]
    keys = []
    for j in range(blocks):
        up = F.shiftleft("fp", sum(bits[:j]))
        keys.append(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(up, 64 - bits[j]).alias("key")))
    rows = fps.select("fp", F.inline(F.array(*keys)))
    count = rows.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(count, ["j", "key"])
    cut = []
    for p in range(4):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(np.array(PIVOTS[p], U64).view(np.int64)))))
        c = F.floor(d / CELL).cast("int")
        # The cell below gets a guest that may be within the radius of what is at home there.
        cells = F.when(d % CELL < radius, F.array(c, c - 1)).otherwise(F.array(c))
        rows = rows.withColumn(f"c{p}", F.explode(
            F.when(F.col("n") > bucket_rows * 3 ** p, cells).otherwise(F.array(F.lit(-9)))))
        cut.append(f"c{p}")

    def search(batches):
        def arrays(t):
            return [t.column(c).to_numpy() for c in by]

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        by, held = ["j", "key", *cut], None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            k = arrays(t)
            new = np.flatnonzero(run_starts(*k))
            last = int(new[-1])
            held = t.slice(last)
            if last:
                yield out(*_search([x[:last] for x in k], t.column("fp").to_numpy()[:last].view(U64), radius))
        if held is not None:
            yield out(*_search(arrays(held), held.column("fp").to_numpy().view(U64), radius))

    return (rows.select("j", "key", *cut, "fp").repartition(shuffle_partitions(fps), "j", "key", *cut)
            .sortWithinPartitions("j", "key", *cut).mapInArrow(search, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id); the link table stays within distinct fingerprints."""
    spark = docs.sparkSession
    fps = materialize(spark, fingerprints(docs, shingle), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = materialize(spark, links(distinct.select("fp"), radius).distinct(), "simhash-links")
    comp = components(found, "simhash-cc")
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
