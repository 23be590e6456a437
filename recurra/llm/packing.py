"""Conflict-constrained best-fit packing (operator 8).

Texts are laid into bins of ``capacity`` words. A bin carries two bitmaps, of
the sources and of the duplicate clusters it holds; a text may enter a bin
only if neither bitmap has its bit: no two texts of one source and no two
copies share a bin. Bins are kept in the order of their residual space; from
the least residual that is large enough the search goes on to its successors
until a bin without conflict is found, the tightest compatible one. Texts are
placed in descending size.

A text longer than a bin is cut: full pieces fill bins of their own, the rest
is packed like any other text. Packing runs in shards of about ``shard_rows``
texts each, dealt by a hash of the row and its place, so a source, an id or a row
that a third of all rows repeat is spread over all shards. Places are fixed by
writing the rows (id, source, text hash and size) first. The only cost is a
part-filled last bin or so per shard.

Defined cases: null and empty texts have no words, take no space and are laid
in the tightest compatible bin all the same; a null source is a source of its
own kind that never conflicts; copies are texts that are equal after
lower-casing and white space runs made one space (null and empty texts are
copies of each other, and do not conflict as they take no space); repeated
rows are packed each, rows with the same doc_id are told apart by shard and
``copy``, a number within the shard;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import materialize

CAPACITY = 2048
SHARD_ROWS = 8192
SCHEMA = "shard int, bin long, doc_id long, copy int, piece int, start long, length long, free long"


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n_words) of every text."""
    words = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    line = F.trim(words)
    n = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.translate(line, " ", "")) + 1)
    return docs.select("doc_id", "source", F.xxhash64(line).alias("cluster"), n.cast("long").alias("n_words"))


def pack_shard(sizes, sources, clusters, capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Bins as lists of (item, start, length), and what each has left. sources and clusters: bit numbers or -1."""
    bins: list[list[tuple[int, int, int]]] = []
    marks: list[list[int]] = []  # of each bin: source bitmap, cluster bitmap
    order: list[tuple[int, int]] = []  # (residual, bin)
    free: list[int] = []
    todo = []
    for i, n in enumerate(sizes):
        full = n // capacity if n > capacity else 0
        for p in range(full):
            bins.append([(i, p * capacity, capacity)])
            marks.append([0, 0])
            free.append(0)
        rest = n - full * capacity
        if rest or not n:
            todo.append((rest, i, full * capacity))
    todo.sort(key=lambda x: (-x[0], x[1]))
    for n, i, start in todo:
        s = 1 << sources[i] if sources[i] >= 0 and n else 0
        c = 1 << clusters[i] if clusters[i] >= 0 and n else 0
        at = bisect_left(order, (n, -1))
        while at < len(order) and (marks[order[at][1]][0] & s or marks[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            marks.append([0, 0])
            free.append(capacity)
        bins[b].append((i, start, n))
        marks[b][0] |= s
        marks[b][1] |= c
        free[b] = left - n
        insort(order, (left - n, b))
    return bins, free


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece laid: shard, bin, doc_id, piece, start, length and what its bin has left."""
    rows = materialize(rows.sparkSession, rows.withColumn("place", F.monotonically_increasing_id()), "packing-items")
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["doc_id", "source", "cluster", "n_words"], na_position="first", ignore_index=True)
        copy = pdf.groupby("doc_id", dropna=False).cumcount().tolist()
        sources = pd.factorize(pdf["source"])[0].tolist()  # null: -1
        bins, free = pack_shard(pdf["n_words"].astype(int).tolist(), sources, pd.factorize(pdf["cluster"])[0].tolist(), capacity)
        ids = pdf["doc_id"].astype("Int64").tolist()
        out = [(key[0], b, ids[i], copy[i], start // capacity, start, n, free[b])
               for b, held in enumerate(bins) for i, start, n in held]
        out = pd.DataFrame(out, columns=["shard", "bin", "doc_id", "copy", "piece", "start", "length", "free"])
        return out.astype({"doc_id": "Int64"})

    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_words", "place"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return pack(items(docs), capacity, shard_rows)
