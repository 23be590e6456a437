"""Source divergence audit (operator 12).

How far apart are the sources of a language in their words, and which words
mark a source?

1. Each language keeps the terms that at least ``min_docs`` of its documents
   hold (distinct terms per document, counted in the tasks, summed by Spark).
2. The kept terms are sorted and numbered per language. Blocks of at most
   ``block_terms`` of them become minimal acyclic transducers
   (``transducer.py``), each in a task of its own.
3. Every whole text is streamed through the transducers of its language, which
   gives the ordinals of its kept terms; occurrences are summed by language,
   source and ordinal. Transducers are broadcast in passes of at most
   ``pass_bytes`` bytes (one, unless a vocabulary is larger); a pass reads only
   the documents of its languages.
4. Smoothed shares are exact (decimals where a product may pass 64 bits).
   Distances between sources are sums over blocks of ordinals and tiles of
   sources, dense within a block. The terms that mark a source are its first
   ``top``, ties by ordinal, which is the order of the terms' bytes.

Defined cases: null text, language and source are empty; every row is a
document, repeated rows too; doc_id is not read. A group without terms has its
share of the smoothing; a language without kept terms has distances of zero; a
lone source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurra.llm.common import materialize, numbered, shuffle_partitions
from recurra.llm.transducer import Transducer

#: Upper-case letters become lower case, other ASCII that is no letter a blank; all other bytes are parts of terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))
#: Entries a task holds before it hands them on.
HELD = 1 << 19
#: Bytes of text that go through a transducer at once.
BUFFER = 1 << 22
#: Ordinals and sources of a block of the distances.
BLOCK, TILE = 4096, 256
SCALE = 1_000_000_000


def _rows(docs: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*text, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _document_counts(batches, most: int):
    held: dict[str, Counter] = {}

    def flush():
        for lang, counter in held.items():
            terms = list(counter)
            for at in range(0, len(terms), 65536):
                part = terms[at:at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                                                  pa.array([counter[t] for t in part], pa.int64())], ["lang", "term", "docs"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held.setdefault(lang, Counter()).update(set(text.as_py().translate(FOLD).split()))
            if sum(map(len, held.values())) > most:
                yield from flush()
    yield from flush()


def kept_terms(docs: DataFrame, min_docs: int, held: int = HELD) -> DataFrame:
    """lang, term (bytes), ordinal (from 0 per language, by bytes), written."""
    spark = docs.sparkSession
    counted = _rows(docs).select("lang", "text").mapInArrow(lambda batches: _document_counts(batches, held), "lang string, term binary, docs long")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    placed = numbered(materialize(spark, kept, "audit-kept").orderBy("lang", "term"), "audit-sorted", "place")
    placed = materialize(spark, placed, "audit-placed")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    return materialize(spark, placed.join(first, "lang").select("lang", "term", (F.col("place") - F.col("first")).alias("ordinal")), "audit-terms")


def transducers(terms: DataFrame, block_terms: int) -> DataFrame:
    """lang, base (ordinal of the block's first term), blob; written."""
    def build(batches):
        key, held, base = None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([base], pa.int64()),
                                               pa.array([Transducer.build(held).to_bytes()], pa.binary())], ["lang", "base", "blob"])
        for batch in batches:
            for lang, block, ordinal, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "ordinal", "term"))):
                if (lang, block) != key:
                    if held:
                        yield made()
                    key, held, base = (lang, block), [], ordinal
                held.append(term)
        if held:
            yield made()

    rows = terms.withColumn("block", F.floor(F.col("ordinal") / block_terms))
    rows = rows.repartition(shuffle_partitions(terms), "lang", "block").sortWithinPartitions("lang", "block", "ordinal")
    return materialize(terms.sparkSession, rows.select("lang", "block", "ordinal", "term").mapInArrow(build, "lang string, base long, blob binary"), "audit-transducers")


def _recount(shared, most: int):
    """Occurrences of kept terms by language, source and ordinal, summed within the task."""
    def run(batches):
        by_lang: dict[str, list] = {}
        for lang, base, blob in shared.value:
            by_lang.setdefault(lang, []).append((base, Transducer.from_bytes(blob)))
        groups: dict[tuple[str, str], int] = {}
        codes, sums, size = [], [], 0

        def stream(lang, held):
            nonlocal size
            data = np.frombuffer(b" ".join(t for _, t in held).translate(FOLD), np.uint8)
            term = np.concatenate([[False], data != 32, [False]])
            edge = np.flatnonzero(term[1:] != term[:-1])
            start, length = edge[::2], edge[1::2] - edge[::2]
            if not len(start):
                return
            ends = np.cumsum([len(t) + 1 for _, t in held])
            group = np.array([groups.setdefault((lang, s), len(groups)) for s, _ in held], np.int64)[np.searchsorted(ends, start, "right")]
            for base, transducer in by_lang[lang]:
                ordinal = transducer.ordinals(data, start, length)
                hit = ordinal >= 0
                code, n = np.unique((group[hit] << 40) | (ordinal[hit] + base), return_counts=True)
                codes.append(code)
                sums.append(n)
                size += len(code)

        def merge():
            nonlocal codes, sums, size
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            sums = [np.bincount(at, np.concatenate(sums), len(code)).astype(np.int64)]
            codes, size = [code], len(code)

        def flush():
            nonlocal codes, sums, size
            if codes:
                merge()
                names = list(groups)
                for at in range(0, size, 65536):
                    code = codes[0][at:at + 65536]
                    own = [names[g] for g in (code >> 40).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string()),
                         pa.array(code & ((1 << 40) - 1)), pa.array(sums[0][at:at + 65536])], ["lang", "source", "ordinal", "n"])
            codes, sums, size = [], [], 0

        waiting: dict[str, list] = {}
        bytes_of: Counter = Counter()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                waiting.setdefault(lang, []).append((source, text))
                bytes_of[lang] += len(text) + 1
                if bytes_of[lang] >= BUFFER:
                    stream(lang, waiting.pop(lang))
                    del bytes_of[lang]
                if size > most:
                    merge()
                    if size > most // 2:
                        yield from flush()
        for lang, held in waiting.items():
            stream(lang, held)
        yield from flush()
    return run


def occurrences(docs: DataFrame, blobs: DataFrame, pass_bytes: int, most: int = HELD) -> DataFrame:
    """lang, source, ordinal, n: occurrences of the kept terms; written."""
    spark = docs.sparkSession
    rows = _rows(docs)
    empty = "lang string, source string, ordinal long, n long"
    found = spark.createDataFrame([], empty)

    def scan(held):
        shared = spark.sparkContext.broadcast(held)
        return rows.where(F.col("lang").isin(sorted({h[0] for h in held}))).mapInArrow(_recount(shared, most), empty)

    held, size = [], 0
    for r in blobs.orderBy("lang", "base").toLocalIterator():
        if held and size + len(r.blob) > pass_bytes:
            found = found.union(materialize(spark, scan(held), "audit-pass"))
            held, size = [], 0
        held.append((r.lang, r.base, bytes(r.blob)))
        size += len(r.blob)
    if held:
        found = found.union(scan(held))
    return materialize(spark, found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "audit-occurrences")


def _share(n: str, total: str, terms: str):
    """Smoothed share of a term; null in a language without kept terms."""
    big = "CAST({} AS DECIMAL(18,0))".format
    top, below = f"CAST({SCALE} AS DECIMAL(10,0)) * {big(f'{n} + 5')}", big(f"{total} + 5 * {terms}")
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div ({below}) END")


def _distances(wide: int, tile: int):
    """Sums of absolute differences of shares between the sources of two tiles over the ordinals of one block."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, tile_a, tile_b, block = (k.as_py() for k in key)
        source, ordinal, p, terms = (rows.column(c).to_numpy() for c in ("idx", "ordinal", "p", "terms"))
        # A source's row of ordinal -1 holds its share of terms that it lacks.
        lacks = np.flatnonzero(ordinal < 0)
        lacks = lacks[np.argsort(source[lacks])]
        idx, width = source[lacks], max(min(wide, int(terms[0]) - block * wide), 0)
        share = np.repeat(p[lacks][:, None], width, axis=1)
        some = ordinal >= 0
        share[np.searchsorted(idx, source[some]), ordinal[some] - block * wide] = p[some]
        left, right = np.flatnonzero(idx // tile == tile_a), np.flatnonzero(idx // tile == tile_b)
        a, b, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for one in left:
            others = right[right > one] if tile_a == tile_b else right
            a.append(np.full(len(others), idx[one]))
            b.append(idx[others])
            far.append(np.abs(share[others] - share[one]).sum(axis=1))
        a, b, far = (np.concatenate(x) for x in (a, b, far))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a), "b": pa.array(b), "value": pa.array(far)})
    return run


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, block_terms: int = 1 << 17, pass_bytes: int = 64 << 20,
          block: int = BLOCK, tile: int = TILE, held: int = HELD) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    terms = kept_terms(docs, min_docs, held)
    counts = occurrences(docs, transducers(terms, block_terms), pass_bytes, held)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _rows(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms"]).withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("tiles", F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / tile))
    groups = materialize(spark, groups.withColumn("p", _share("0", "total", "terms")), "audit-groups")

    shares = counts.join(groups.drop("p"), ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / block))).alias("block")
    columns = ["lang", "idx", "terms", "tiles", "ordinal", "p"]
    cells = groups.withColumn("ordinal", F.lit(-1).cast("long")).select(*columns, blocks)
    cells = cells.unionByName(shares.select(*columns, F.floor(F.col("ordinal") / block).alias("block")))
    own = F.floor(F.col("idx") / tile)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles")))).select(
        "lang", F.least(own, "other").alias("tile_a"), F.greatest(own, "other").alias("tile_b"), "block", F.col("idx").cast("long").alias("idx"), F.col("terms").cast("long").alias("terms"), "ordinal", F.coalesce("p", F.lit(0)).alias("p"))
    parts = cells.groupBy("lang", "tile_a", "tile_b", "block").applyInArrow(_distances(block, tile), "lang string, a long, b long, value long")
    far = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    far = far.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("idx"), F.col("b").alias("to")), F.struct(F.col("b").alias("idx"), F.col("a").alias("to")))))
    names = groups.select("lang", "idx", "source")
    far = far.join(names, ["lang", "idx"]).join(names.select("lang", F.col("idx").alias("to"), F.col("source").alias("item")), ["lang", "to"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # The language's own share of each term; its total is that of its sources.
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(sizes, "lang").join(sums.groupBy("lang").agg(F.sum("total").alias("total")), "lang")
    whole = whole.select("lang", "ordinal", _share("n", "total", "terms").alias("q"))
    marks = shares.join(whole, ["lang", "ordinal"]).where(F.col("p") > F.col("q")).select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("ordinal"))
    marks = marks.withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    marks = marks.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(marks)
