"""Compression classifier (operator 2).

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text is compressed in pieces against each; the difference of the two
compressed sizes, divided by the size of the text, says which kind it
resembles. A rising step curve (isotonic regression, interpolated), fitted on
other labelled texts than those of the dictionaries and weighted to the true
shares of the labels, turns it into a probability of label 1.

Fitting reads a bounded sample of the labelled rows: ``per_class`` texts of
each class for the dictionaries and as many for the curve, chosen by a hash of
the doc_id; texts of more than ``max_bytes`` are left out of the sample. Scoring reads every whole text.
Labels, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts get the score of a difference of zero;
without labelled texts of both classes (an empty table) every score is the
share of good labels, or 0.5 without labels; repeated rows each get a row;
rows whose doc_id is null count as held out (their label cannot be looked up).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import clean_docs

#: Bytes of a piece that is compressed on its own, so that the dictionary counts in long texts too.
PIECE = 512
THRESHOLD = 0.3


def held_out(col="doc_id"):
    """True where crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Coder:
    """Compressors with the two dictionaries; made once per task."""

    def __init__(self, model: dict):
        self.model = model
        level = model["level"]
        self.pair = []
        for raw in model["dicts"]:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: bytes) -> float:
        """(bad size - good size) per byte of the text: higher if it resembles the good texts."""
        good, bad = (c.compress for c in self.pair)
        g = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at:at + PIECE]
            g += len(good(piece))
            b += len(bad(piece))
        return (b - g) / max(len(text), 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[list[float], list[float]]:
    """Rising curve through weighted 0/1 labels (pooled neighbours), as points to interpolate between.

    The shares of the pools are smoothed by one row of the prior.
    """
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # label weight, weight, least x, largest x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = hi
    return [(p[2] + p[3]) / 2 for p in pools], [(p[0] + prior) / (p[1] + 1) for p in pools]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 16384,
        dict_bytes: int = 32768, level: int = 1) -> dict:
    """Model from the labelled rows that are not held out."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
              .select("doc_id", "quality").distinct())
    share = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = share.get(0, 0) + share.get(1, 0)
    model = {"level": level, "prior": share.get(1, 0) / total if total else 0.5, "dicts": None}
    texts = clean_docs(docs).where((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes))
    taken = []
    for q in (1, 0):
        # The sample is drawn from the labels, so that texts are met by a list of bounded length and never shuffled.
        ids = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).select("doc_id")
        # An id counts once, with its smallest text, however many rows have it.
        own = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toLocalIterator()
        taken.append([r["text"].encode("utf-8", "surrogatepass") for r in rows])
    if min(map(len, taken)) < 4:
        return model
    dicts = []
    for side in taken:
        pieces = [t[i:i + PIECE] for t in side[::2] for i in range(0, len(t), PIECE)]
        dicts.append(_dictionary(pieces, dict_bytes))
    model["dicts"] = dicts
    coder = Coder(model)
    x = np.array([coder.difference(t) for side in taken for t in side[1::2]])
    y = np.array([1.0 - k for k, side in enumerate(taken) for _ in side[1::2]])
    # The sample holds at most per_class rows of each label; weights bring the true shares back.
    w = np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum()))
    model["x"], model["y"] = isotonic(x, y, w, model["prior"])
    return model


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    size = min(size, max(512, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples for the trainer: their own text serves as dictionary
        return b"".join(pieces)[-size:]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id with held_out, score and predicted."""

    def run(batches):
        coder = Coder(model) if model["dicts"] else None
        for b in batches:
            texts = b.column("text")
            if coder:
                d = np.array([coder.difference(t.as_py().encode("utf-8", "surrogatepass")) for t in texts])
                p = np.interp(d, model["x"], model["y"])
            else:
                p = np.full(len(texts), model["prior"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = clean_docs(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    return score(docs, fit(docs, labels, **fitting))
