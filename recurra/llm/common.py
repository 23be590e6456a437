"""Shared helpers of the training-data operators.

Wide intermediate data (rolling hashes of every position) moves between tasks
as a few binary rows per input batch and bucket instead of one row per
position: a map task hashes a batch of texts with numpy, deals the positions
out by hash to buckets and emits one packed row per bucket; Spark shuffles the
rows by bucket. There are as many buckets as shuffle partitions, so a bucket's
memory is its share of the positions; the setting must grow with the input.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurra.session import materialize, shared_path  # noqa: F401  (re-exported)

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def clean_docs(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (plus ``more``); null text becomes empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def numbered(df: DataFrame, name: str, col: str) -> DataFrame:
    """df, written, with numbers from 1 on in the order of its partitions, without gaps."""
    rows = materialize(df.sparkSession, df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    # One row per partition that wrote rows.
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(col, F.col("_before") + within + 1).drop("_at", "_part", "_before")


def own_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a doc_id of its own for each row, and (doc_id, given) of the rows that got a new one.

    A table whose ids are unique stays as it is (one grouped count over the ids; texts are not read). Otherwise, of
    the rows with one id the one with the smallest text keeps it. The others and rows without an id get numbers above
    all ids, in order of id and text, so they count as later documents; no row is lost.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        # The condition holds anyway; joins add it to one of their sides, and equal plans share a shuffle.
        return docs.where(F.col("doc_id").isNotNull()), None
    spark, columns = docs.sparkSession, docs.columns
    rows = materialize(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "rows-by-id")
    first = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", "_row"))["_row"].alias("_row"))
    kept, extra = (rows.join(first.select("_row"), "_row", how) for how in ("left_semi", "left_anti"))
    most = rows.agg(F.max("doc_id")).first()[0] or 0
    extra = numbered(extra.orderBy("doc_id", "text", "_row"), "rows-extra", "_number").withColumn("_own", F.col("_number") + most)
    extra = materialize(spark, extra.drop("_row", "_number"), "rows-extra-ids")
    given = extra.select(F.col("_own").alias("doc_id"), F.col("doc_id").alias("given"))
    own = kept.select(*columns).unionByName(extra.drop("doc_id").withColumnRenamed("_own", "doc_id").select(*columns))
    return own.where(F.col("doc_id").isNotNull()), given


def with_given_ids(result: DataFrame, given: DataFrame | None) -> DataFrame:
    """The result's doc_id as it was given."""
    if given is None:
        return result
    met = result.join(given.withColumn("_new", F.lit(True)), "doc_id", "left")
    return met.withColumn("doc_id", F.when(F.col("_new"), F.col("given")).otherwise(F.col("doc_id"))).select(*result.columns)


class WordHash(dict):
    """64-bit hash of a word, remembered; cleared when the vocabulary is large."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def ngrams(words: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the n words from each position on (position count: len - n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = words[:m].copy()
    for j in range(1, n):
        out *= U64(base)
        out += words[j:j + m]
    return mix(out)


def planes(a: np.ndarray) -> bytes:
    """Byte planes of an integer array: slowly changing high bytes compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(data, np.uint8, n * dtype.itemsize).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(n)


def pack(*arrays: np.ndarray) -> bytes:
    """One blob of equally long arrays; the reader knows the types."""
    return b"".join(planes(np.ascontiguousarray(a)) for a in arrays)


def unpack(blob, *dtypes) -> list[np.ndarray]:
    width = sum(np.dtype(d).itemsize for d in dtypes)
    n, at, out, view = len(blob) // width, 0, [], memoryview(blob)
    for d in dtypes:
        size = n * np.dtype(d).itemsize
        out.append(unplanes(view[at:at + size], d, n))
        at += size
    return out


def deal(bucket: np.ndarray, n_buckets: int, *arrays: np.ndarray):
    """Yields (bucket, packed arrays) for every bucket that has positions."""
    order = np.argsort(bucket.astype(np.uint16 if n_buckets < 65536 else np.int64), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    sorted_arrays = [a[order] for a in arrays]
    for b in range(n_buckets):
        lo, hi = ends[b], ends[b + 1]
        if hi > lo:
            yield b, pack(*(a[lo:hi] for a in sorted_arrays))


def text_slices(batches, size: int = 1 << 20):
    """(ids, encoded texts) in slices of about ``size`` bytes, whole texts each."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        part_ids, part, held = [], [], 0
        for i, t in zip(ids, texts):
            data = t.as_py().encode("utf-8", "surrogatepass")
            part_ids.append(i)
            part.append(data)
            held += len(data)
            if held >= size:
                yield part_ids, part
                part_ids, part, held = [], [], 0
        if part:
            yield part_ids, part


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: true at the first row of each run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new
