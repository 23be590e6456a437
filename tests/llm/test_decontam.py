"""Shingles that repeat weigh on all bits of a fingerprint."""

from __future__ import annotations

import random

from recurra.llm import decontam
from tests.llm import brute


def test_repeated_shingles(spark):
    random.seed(7)
    items, docs = [], []
    for k in range(6):
        words = [f"k{k}w{i}" for i in range(420)]
        other = [f"k{k}o{i}" for i in range(50)]
        run = {"item": [f"x{k}"] * 50, "doc": [f"y{k}"] * 50}
        # Repeats on both sides, in the item only, in the document only; the similarity is 0.806.
        item = words + (other if k % 3 == 2 else run["item"])
        doc = words + (other if k % 3 == 1 else run["doc"])
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([f"a{random.random()}" for _ in range(30)] + doc + ["end", "of", "text"])))
        # Too few shared shingles; a document shorter than the item; a passage that comes twice.
        docs += [(100 + k, " ".join(words[:380] + run["doc"] * 2)), (200 + k, " ".join(item[5:])), (300 + k, " ".join(item + item))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.contaminated(docs, items)
    assert {(k, k) for k in range(6)} <= set(want)
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
