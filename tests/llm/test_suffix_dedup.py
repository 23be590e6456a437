"""Passages that many documents share, with texts around them that part within a unit."""

from __future__ import annotations

import random

from recurra.llm import suffix_dedup
from tests.llm import brute


def test_shared_passage(spark):
    random.seed(5)

    def text(n, letters="abcdefghijklmnopqrstuvwxyz"):
        return "".join(random.choices(letters, k=n))

    passage, short = text(300), text(110)
    texts = {i: text(random.randrange(150)) + passage + text(random.randrange(150)) for i in range(200)}
    # Ends and starts within the reach of an anchor, and bytes that equal the filling of a short unit.
    texts |= {200 + i: text(random.randrange(20), "a\0") + short + text(random.randrange(20), "a\0") for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute.suffix_dedup(texts)


def test_equal_hashes_are_not_equal_texts(spark):
    """Whatever the rolling hash says: with a hash that makes all contexts and anchors equal, no byte is lost."""
    random.seed(6)
    texts = {i: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=160)) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # A base of 1 makes the rolling hash a sum of letters, and 2**32 one of the first few bytes: clashes abound.
    before = suffix_dedup.BASE
    for base in (1, (1 << 32) + 1):
        suffix_dedup.BASE = (base, before[1])
        try:
            anchors = suffix_dedup.Anchors(100)
            parts = [t.encode() for t in texts.values()]
            t, pos, h, c1, c2 = anchors.of(parts, [(0, len(p)) for p in parts])
            assert len(set(zip(c1.tolist(), c2.tolist()))) == len(c1)
        finally:
            suffix_dedup.BASE = before
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute.suffix_dedup(texts) and not any(v[1] for v in got.values())
