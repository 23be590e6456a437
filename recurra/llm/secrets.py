"""Secret scans by dictionary-primed zstandard novelty (operator 13).

Three patterns find the plain cases: assignments to names such as ``token``,
access key ids and long hexadecimal strings. Beside them, each string of
``min_chars`` or more key characters that holds a run of letters and digits (ten
or more, of both) and stands shortly behind a sensitive word is a candidate. Its
novelty is measured: the text around it is compressed with and without it by
zstandard, primed with a dictionary of the corpus' most frequent identifiers,
and the difference in bytes is divided by its length; of several widths of the
surroundings the median counts. Names made of known words, sequences and
repetitions cost little; a random key costs its length. Candidates of
``novelty`` or more are reported as kind ``novel``, unless a plain span overlaps
them. On made-up keys within the given texts 0.85 finds some 97 of 100 random
keys of 20 letters and digits, and takes one of 100 names of four known words.

The dictionary holds the ``identifiers`` words (letters and underscores, 4 to 24
of them) with the most occurrences over all texts, counted by Spark; only these,
at most 24 bytes each, reach the driver and the tasks. Letters beside digits are
left out, so that a key that is copied often does not hide itself.

Defined cases: null and empty texts have no spans; each row gets a row, repeated
rows and rows without doc_id too; spans are code points, end exclusive, in texts
of any length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from statistics import median

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import clean_docs

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
#: A short match of these two ends where a run of their characters ends, so a least length loses nothing.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
SENSITIVE = re.compile(rb"key|secret|token|passw|passphrase|pwd|auth|credential|bearer|private|signature|cookie|session", re.IGNORECASE)
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9_])[A-Za-z_]{4,24}(?![A-Za-z0-9_])")
KEY_RUN = re.compile(rb"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{10,}")
#: Bytes before a candidate in which a sensitive word is looked for, and bytes on both sides it is measured against.
NEAR, AROUND = 64, (64, 128, 192, 256)
HELD = 1 << 19


def identifiers(docs: DataFrame, n: int) -> list[bytes]:
    """The n most frequent identifiers of all texts, ties by their bytes."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            words = list(held)
            for at in range(0, len(words), 65536):
                part = words[at:at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column("text"):
                held.update(IDENTIFIER.findall(text.as_py()))
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    texts = docs.select(F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    counted = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()]


class Novelty:
    """Marginal compressed bytes of a string within its surroundings, per byte of it."""

    def __init__(self, words: list[bytes], level: int):
        # Near the end of a dictionary references are cheap: the most frequent words come last.
        raw = b" ".join(reversed(words))
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
        if primed:
            primed.precompute_compress(level=level)
            self.size = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False, write_checksum=False)
        else:
            self.size = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def of(self, data: bytes, start: int, end: int) -> float:
        costs = []
        for width in AROUND:
            before, after = data[max(0, start - width):start], data[end:end + width]
            with_it, without = (len(self.size.compress(x)) for x in (before + data[start:end] + after, before + after))
            costs.append((with_it - without) / (end - start))
        return median(costs)


def spans_of(data: bytes, novelty: Novelty, candidate: re.Pattern, least: float) -> list[tuple[int, int, int, float]]:
    """(start, kind's place, end, novelty) in bytes, sorted."""
    found = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(data)]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(data)]
    near = -1
    sensitive = SENSITIVE.finditer(data)
    word = next(sensitive, None)
    plain = sorted((s, e) for s, _, e, _ in found)
    at = 0
    for m in candidate.finditer(data) if word else ():
        start, end = m.span()
        while word and word.end() <= start:
            near, word = word.end(), next(sensitive, None)
        if near < 0 or start - near > NEAR:
            continue
        while at < len(plain) and plain[at][1] <= start:
            at += 1
        if any(s < end and e > start for s, e in plain[at:at + 3]):
            continue
        if not KEY_RUN.search(m[0]):
            continue
        cost = novelty.of(data, start, end)
        if cost >= least:
            found.append((start, 3, end, round(cost, 6)))
    return sorted(found)


def code_points(data: bytes, offsets: list[int]) -> list[int]:
    if data.isascii():
        return offsets
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return starts[offsets].tolist()


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, identifier_words: int = 4096, min_chars: int = 16, novelty: float = 0.85, level: int = 9) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, novelty), by start and then by kind."""
    words = identifiers(docs, identifier_words)

    def run(batches):
        measure = Novelty(words, level)
        candidate = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % min_chars)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                data = text.as_py()
                found = spans_of(data, measure, candidate, novelty)
                points = code_points(data, [x for s, _, e, _ in found for x in (s, e)]) if found else []
                out.append([{"kind": KINDS[k], "start": points[2 * i], "end": points[2 * i + 1], "novelty": cost} for i, (_, k, _, cost) in enumerate(found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, SPANS)], ["doc_id", "spans"])

    rows = clean_docs(docs).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,`end`:long,novelty:double>>")
