"""Exact top-k inner product search over vector-approximation files (operator 10).

Vectors become integers floor(scale * x). The approximation file keeps a
signed byte per component: the number of its cell. Each vector has cells of a
width of its own, 2**s for the least s at which its components fit, so an
outlier widens its own bounds alone. For a query the cells bound the inner
product from both sides. Scanning them gives for each block of candidates those
whose upper bound reaches the kth largest lower bound; over all blocks the same
test leaves few. Their exact vectors are read in the order of their bounds: the
first ``first_reads`` of each query give a kth score, and of the others only
those are read whose upper bound reaches it. What is not read cannot be in the
result.

Equal vectors share one entry. It keeps the smallest 2k ids, a repeated id up
to k times: more can never be in a result, as ties go to the smaller id and one
id (the query's) does not count. So a vector that a third of the rows hold
costs one entry.

Queries and candidates meet block by block (``query_block`` x ``cand_block``);
the compared pairs are the given query set against all rows, which the task
asks for. Blocks are bounded, whatever the input size.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; a vector meets vectors of its own length only; rows
without id take no part; repeated rows count as rows, each with a rank of its
own; all rows of a query's id are left out of its result; of an id's different
vectors the smallest (compared component by component) is the query; an empty
table gives an empty result; other columns are ignored. Scaled components
beyond 2**62 count as 2**62; scores are exact, beyond 63 bits they are cut to the
largest or smallest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import materialize, shuffle_partitions

LARGEST = 1 << 62


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, ints, dim) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(
        F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), held.alias("ints")).withColumn("dim", F.size("ints"))


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """(entry, dim, ints, ids, own, lone): one row per vector; lone: all its rows have the id ``own``."""
    w = Window.partitionBy("ints").orderBy("id")
    times = vectors.groupBy("ints", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    few = times.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "times"))), lambda x: F.array_repeat(x["id"], x["times"])))
    grouped = few.groupBy("ints").agg(F.slice(ids, 1, 2 * k).alias("ids"), F.min("id").alias("least"), F.max("id").alias("most"))
    return grouped.select(F.monotonically_increasing_id().alias("entry"), F.size("ints").alias("dim"), "ints", "ids",
                          F.col("least").alias("own"), (F.col("least") == F.col("most")).alias("lone"))


def _query_blocks(queries: DataFrame, count: int) -> DataFrame:
    """(qb, dim, qids, qdata): ``count`` blocks by a hash of the id, vectors as int64."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qb": [key[0]], "dim": [key[1]], "qids": [pdf["id"].to_numpy(np.int64).tobytes()],
                             "qdata": [np.stack(pdf["ints"].to_numpy()).astype(np.int64).tobytes()]})

    keyed = queries.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("qb"), F.size("ints").alias("dim"), "id", "ints")
    return keyed.groupBy("qb", "dim").applyInPandas(run, "qb int, dim int, qids binary, qdata binary")


def _cell_blocks(entries: DataFrame, count: int) -> DataFrame:
    """(cb, dim, entries, own, shifts, cells): the approximation file in ``count`` blocks by a hash of the entry."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf["ints"].to_numpy()).astype(np.int64)
        # The least shift at which both ends of a vector's range fit a signed byte.
        top = np.maximum(a.max(axis=1), ~a.min(axis=1))
        shift = np.array([max(1, int(x).bit_length() - 7) for x in top.tolist()], np.int64)
        cells = (a >> shift[:, None]).astype(np.int8)
        return pd.DataFrame({"cb": [key[0]], "dim": [key[1]], "entries": [pdf["entry"].to_numpy(np.int64).tobytes()],
                             "own": [pdf["own"].to_numpy(np.int64).tobytes()], "lone": [pdf["lone"].to_numpy(bool).tobytes()],
                             "shifts": [shift.astype(np.int8).tobytes()], "cells": [cells.tobytes()]})

    keyed = entries.select(F.pmod(F.xxhash64("entry"), F.lit(count)).cast("int").alias("cb"), "dim", "entry", "ints", "own", "lone")
    return keyed.groupBy("cb", "dim").applyInPandas(run, "cb int, dim int, entries binary, own binary, lone binary, shifts binary, cells binary")


def bounds_of(queries: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries (rows) and vectors in cells (columns)."""
    q = queries.astype(np.float64)
    width = np.ldexp(1.0, shift)
    half = (width - 1) / 2
    mid = (q @ cells.astype(np.float64).T) * width + q.sum(axis=1)[:, None] * half
    size = np.abs(q).sum(axis=1)[:, None]
    # The last term covers the rounding of doubles.
    gap = size * half + 1 + 1e-12 * size * width * 128
    return mid - gap, mid + gap


def _bounds(k: int):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                qi = np.frombuffer(r.qdata, np.int64).reshape(-1, r.dim)
                cells, shift = np.frombuffer(r.cells, np.int8).reshape(-1, r.dim), np.frombuffer(r.shifts, np.int8).astype(np.int64)
                qids, entries = np.frombuffer(r.qids, np.int64), np.frombuffer(r.entries, np.int64)
                own, lone = np.frombuffer(r.own, np.int64), np.frombuffer(r.lone, bool)
                for at in range(0, len(qi), 256):
                    lower, upper = bounds_of(qi[at:at + 256], cells, shift)
                    # An entry that only the query's id has is no candidate.
                    none = (own[None, :] == qids[at:at + 256, None]) & lone
                    lower[none], upper[none] = -np.inf, -np.inf
                    least = min(k, lower.shape[1])
                    kth = np.partition(lower, lower.shape[1] - least, axis=1)[:, -least][:, None]
                    i, j = np.nonzero((upper >= kth) & ~none)
                    yield pd.DataFrame({"query_id": qids[at + i], "entry": entries[j], "lower": lower[i, j], "upper": upper[i, j]})
    return run


def _scores(frames):
    """Exact inner products; beyond 62 bits by Python's integers."""
    for pdf in frames:
        out = []
        for a, b in zip(pdf["q"], pdf["v"]):
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
            if int(np.abs(a).max()) * int(np.abs(b).max()) * len(a) < LARGEST:
                out.append(int(a @ b))
            else:
                out.append(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a.tolist(), b.tolist())))))
        yield pd.DataFrame({"query_id": pdf["query_id"], "entry": pdf["entry"], "score": np.array(out, np.int64)})


def candidate_bounds(entries: DataFrame, queries: DataFrame, k: int, query_block: int, cand_block: int) -> DataFrame:
    """(query_id, entry, lower, upper) of the entries that no block rules out."""
    n, n_queries = entries.count(), queries.count()
    nq, nc = -(-n_queries // query_block) or 1, -(-n // cand_block) or 1
    q = _query_blocks(queries, nq).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = _cell_blocks(entries, nc).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # Every pair of blocks is a key of its own, dealt to as many tasks as there are pairs (up to a bound).
    parts = max(shuffle_partitions(entries), min(nq * nc, 20000))
    keys = ["qb", "cb", "dim"]
    return (q.repartition(parts, *keys).join(c.repartition(parts, *keys), keys).drop("qb", "cb")
            .mapInPandas(_bounds(k), "query_id long, entry long, lower double, upper double"))


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
          query_block: int = 2048, cand_block: int = 4096, first_reads: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row (``is_query``: on column id)."""
    spark = rows.sparkSession
    vectors = materialize(spark, integer_vectors(rows, id_col, vec_col, scale), "topk-ints")
    entries = materialize(spark, _entries(vectors, k), "topk-entries")
    queries = vectors.where(is_query(F.col("id"))).groupBy("id").agg(F.min("ints").alias("ints"))
    near = materialize(spark, candidate_bounds(entries, queries, k, query_block, cand_block), "topk-bounds")

    exact = entries.select("entry", F.col("ints").alias("v"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("ints").alias("q"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.select("query_id", "entry").join(exact, "entry").join(asked, "query_id")
        return met.mapInPandas(_scores, "query_id long, entry long, score long")

    def kth_largest(df: DataFrame, col: str) -> DataFrame:
        """The kth largest value of each query that has as many."""
        w = Window.partitionBy("query_id").orderBy(F.desc(col))
        return (df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
                .groupBy("query_id").agg(F.min(col).alias("kth"), F.count("*").alias("have")).where(F.col("have") == k).drop("have"))

    left = near.join(kth_largest(near, "lower"), "query_id", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "entry")
    ranked = materialize(spark, left.drop("kth").withColumn("r", F.row_number().over(by_bound)), "topk-left")
    first = materialize(spark, scored(ranked.where(F.col("r") <= first_reads)), "topk-first")
    rest = ranked.where(F.col("r") > first_reads).join(kth_largest(first, "score"), "query_id", "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth") - F.abs("kth") * 1e-12 - 1))
    found = first.unionByName(scored(rest)).join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry")
    found = found.where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
