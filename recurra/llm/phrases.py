"""Phrase collocation mining (operator 11).

Words are numbered per language, n-grams of word ids are counted in counting
quotient filters (``quotient.py``), and the filters of all tasks are merged by
ranges of the permuted keys.

1. Texts are cut into slices of at most ``slice_words`` words. A slice keeps
   its words as numbers of its own, and a list of its distinct words. Both are
   written, so that a lost executor costs a part of one job.
2. The lists give the counts of all words of a language. Words with
   ``min_count`` occurrences are numbered over all languages; no phrase with
   as many occurrences holds another word. The list of a slice meets the
   numbers in a join, so no task holds the vocabulary.
3. Each slice's n-grams are packed, permuted and counted; a task merges its
   slices' filters as long as they fit and deals them out by ranges of the
   keys. There are as many ranges as the corpus has words by ``range_words``.
   The filters of a range are merged in one task, and keys that occur
   ``min_count`` times are turned back into word ids.
4. Scores are exact decimals. The first ``top`` of a language are taken in two
   steps, first within salted parts of it.

Defined cases: null and empty texts have no words; a null language is ``und``;
repeated rows count as often as they occur; doc_id is not read; a text of any
length is cut into slices, which know the two words after their last one; an
empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurra.llm import quotient
from recurra.llm.common import U64, materialize, numbered, planes, shuffle_partitions, unplanes

#: Upper-case letters become lower case, what ends a piece a line break, tabs blanks.
FOLD = bytes(range(256)).translate(bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "))
TOKEN = re.compile(rb"\n|[^ \n]+")
GAP = re.compile(rb"[ \n]")
#: Bytes of a text that are split at a time.
CHUNK = 1 << 20
#: Keys that a task holds before it deals them out.
HELD = 1 << 21
#: Parts of a language in the first step of the ranking.
SALTS = 64


class _Numbers(dict):
    """Numbers the words of one language within a slice; the counter is shared between languages."""

    def __init__(self, words: list):
        super().__init__({b"\n": 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        n = self[word] = len(self.words)
        return n


class _Slice:
    def __init__(self):
        self.words: list[bytes] = []
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.starts = 0

    def of(self, lang: str) -> _Numbers:
        return self.numbers.setdefault(lang, _Numbers(self.words))

    def rows(self, slice_id: int):
        seq = np.concatenate(self.parts)
        n = np.bincount(seq[seq > 0], minlength=len(self.words) + 1)[1:]
        lang = [None] * len(self.words)
        for name, numbers in self.numbers.items():
            for k in numbers.values():
                if k:
                    lang[k - 1] = name
        m = len(self.words)
        yield _batch([slice_id], [planes(seq)], [None], [None], [None], [None])
        for at in range(0, m, 65536):
            part = slice(at, min(at + 65536, m))
            size = part.stop - at
            yield _batch([slice_id] * size, [None] * size, lang[part], self.words[part], n[part], np.arange(at + 1, part.stop + 1))


def _batch(slice_id, seq, lang, word, n, local):
    return pa.RecordBatch.from_arrays(
        [pa.array(slice_id, pa.int64()), pa.array(seq, pa.binary()), pa.array(lang, pa.string()), pa.array(word, pa.binary()),
         pa.array(n, pa.int64()), pa.array(local, pa.int32())], ["slice", "seq", "lang", "word", "n", "local"])


def _split(data: bytes, chunk: int):
    """Words and line breaks of a folded text, a part of it at a time."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + chunk)
        end = gap.start() if gap else len(data)
        yield TOKEN.findall(data, at, end)
        at = end


def _slices(slice_words: int, chunk: int = CHUNK):
    """Cuts texts into slices: a row with the sequence of word numbers, and a row for each distinct word.

    In the sequence 0 ends a piece. A negative number is a word that another slice counts: the two words after
    the last one of a slice that ends within a text.
    """
    def run(batches):
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        made, cur = 0, _Slice()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data, words = text.as_py().translate(FOLD), []
                for found in _split(data, chunk):
                    words += found
                    while len(words) >= max(slice_words - cur.starts, 1) + 2:
                        own = max(slice_words - cur.starts, 1)
                        ids = np.fromiter(map(cur.of(lang).__getitem__, words[:own + 2]), np.int32, own + 2)
                        ids[own:] *= -1
                        cur.parts += [ids, np.zeros(1, np.int32)]
                        yield from cur.rows(base + made)
                        made, cur, words = made + 1, _Slice(), words[own:]
                if words:
                    cur.parts += [np.fromiter(map(cur.of(lang).__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                    cur.starts += len(words)
        if cur.parts:
            yield from cur.rows(base + made)
    return run


def _filters(bits: int, range_bits: int, most: int):
    """Counts the n-grams of slices and deals sorted filters out by ranges of the permuted keys."""
    keys = quotient.Keys(bits)
    w = keys.w

    def deal(parts):
        hi, lo, n = quotient.merge(parts, w)
        part = (hi >> U64(w - range_bits)).astype(np.int64)
        at = np.flatnonzero(quotient.run_starts(part))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
            blob = quotient.write(hi[a:b] & quotient.mask(w - range_bits), lo[a:b], n[a:b], w - range_bits, w)
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int64()), pa.array([blob], pa.binary())], ["part", "filter"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for seq, ids in zip(batch.column("seq"), batch.column("ids")):
                flat = ids.values
                look = np.zeros(max(len(flat) and int(np.max(np.asarray(flat.field("local")))), 0) + 1, U64)
                look[np.asarray(flat.field("local"))] = np.asarray(flat.field("id")).astype(U64)
                blob = seq.as_buffer()
                seq = unplanes(blob, np.int32, len(blob) // 4)
                known = np.where(np.abs(seq) < len(look), np.abs(seq), 0)
                g = look[known]
                two = (seq[:-1] > 0) & (g[:-1] > 0) & (g[1:] > 0)
                three = two[:-1] & (g[2:] > 0)
                a, b, c = (np.concatenate(x) for x in (
                    (g[:-1][two], g[:-2][three]), (g[1:][two], g[1:-1][three]), (np.zeros(int(two.sum()), U64), g[2:][three])))
                if len(a):
                    held.append(quotient.count(*keys.pack(a, b, c), None, w))
                    size += len(held[-1][0])
                if size > most:
                    held = [quotient.merge(held, w)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from deal(held)
                        held, size = [], 0
        if held:
            yield from deal(held)
    return run


def _merged(bits: int, range_bits: int, min_count: int, most: int):
    """Merges the filters of each range; rows come range by range."""
    keys = quotient.Keys(bits)
    w = keys.w

    def finish(part, held):
        hi, lo, n = quotient.merge(held, w)
        often = n >= min_count
        a, b, c = keys.unpack(hi[often] | (U64(part) << U64(w - range_bits)), lo[often])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c, n[often])], ["i1", "i2", "i3", "a"])

    def run(batches):
        part, held, size = None, [], 0
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("filter")):
                if p != part:
                    if held:
                        yield finish(part, held)
                    part, held, size = p, [], 0
                held.append(quotient.read(blob.as_buffer(), w - range_bits, w))
                size += len(held[-1][0])
                if size > 2 * most and len(held) > 1:
                    before, held = size, [quotient.merge(held, w)]
                    size = 0 if len(held[0][0]) < before // 2 else -2 * most  # next merge after as many new keys
        if held:
            yield finish(part, held)
    return run


def mine(docs: DataFrame, min_count: int = 10, top: int = 2000, covered: int = 50, slice_words: int = 1 << 19,
         range_words: int = 1 << 22, held: int = HELD) -> DataFrame:
    """Phrases of two and three words by language and rank, with the counts that make their score.

    A phrase within a longer one that occurs at least ``covered`` times in a hundred of its occurrences is left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    cut = materialize(spark, rows.mapInArrow(_slices(slice_words), "slice long, seq binary, lang string, word binary, n long, local int"), "phrases-slices")
    words = cut.where("word IS NOT NULL").drop("seq")
    counted = materialize(spark, words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrases-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = materialize(spark, numbered(counted.where(F.col("f") >= min_count), "phrases-kept", "id"), "phrases-vocabulary")
    size, all_words = vocabulary.agg(F.count("*")).first()[0], counted.agg(F.sum("f")).first()[0] or 0

    bits = max(int(size).bit_length(), 4)
    n_ranges = max(shuffle_partitions(docs), all_words // range_words + 1)
    range_bits = min(int(n_ranges - 1).bit_length(), quotient.Keys(bits).w - 1)
    ids = words.join(vocabulary, ["lang", "word"]).groupBy("slice").agg(F.collect_list(F.struct("local", "id")).alias("ids"))
    filters = cut.where("seq IS NOT NULL").select("slice", "seq").join(ids, "slice").mapInArrow(_filters(bits, range_bits, held), "part long, filter binary")
    by_range = filters.repartition(1 << range_bits, "part").sortWithinPartitions("part")
    grams = materialize(spark, by_range.mapInArrow(_merged(bits, range_bits, min_count, held), "i1 long, i2 long, i3 long, a long"), "phrases-grams")

    def word(k):
        return vocabulary.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))

    two = materialize(spark, grams.where("i3 = 0").drop("i3").join(word(1), "i1").join(word(2), "i2"), "phrases-pairs")
    three = grams.where("i3 > 0")
    longer = three.select("a", F.inline(F.array(F.struct("i1", "i2"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2")))))
    longer = longer.groupBy("i1", "i2").agg(F.max("a").alias("longest"))
    pairs = (two.join(longer, ["i1", "i2"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered))
             .select("lang", F.concat("w1", F.lit(b" "), "w2").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts")))
    head = two.select("i1", "i2", "lang", "w1", "w2", F.col("f1").alias("l1"), F.col("a").alias("l2"))
    tail = two.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2"))
    triples = three.join(head, ["i1", "i2"]).join(tail, ["i2", "i3"]).select(
        "lang", F.concat("w1", F.lit(b" "), "w2", F.lit(b" "), "w3").alias("phrase"), "a",
        F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"))).alias("cuts"))

    # 1000000 * a * a and l * r may pass 64 bits; decimals of 38 digits hold them.
    score = "(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(c.l AS DECIMAL(15,0)) * CAST(c.r AS DECIMAL(15,0)))"
    best = F.expr(f"array_min(transform(cuts, (c, k) -> struct({score} AS score, k AS k, c.l AS l, c.r AS r)))")
    scored = pairs.unionByName(triples).withColumn("best", best).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "salt"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"),
                                              "a", "l", "r", "n", "score")
