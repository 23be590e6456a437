"""The joined stages on a small corpus against plain versions (the classifier's predictions are its own)."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from recurra.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"größe{i}é passage{i * 7}" for i in range(15))


def without_repeats(texts, window=100):
    """What is left of each text; a character that is partly covered stays."""
    seen, out = set(), {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = [False] * len(data)
        for s in range(len(data) - window + 1):
            w = data[s:s + window]
            if w in seen:
                gone[s:s + window] = [True] * window
            seen.add(w)
        left, at = [], 0
        for c in texts[d]:
            n = len(c.encode())
            if not all(gone[at:at + n]):
                left.append(c)
            at += n
        if "".join(left) or not any(gone):
            out[d] = "".join(left)
    return out


def test_pipeline(spark, tmp_path):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' WHERE text <> '' ORDER BY item_id LIMIT 3").fetchall()
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 150").fetchall()
    docs = {}
    for k, (d, text, lang, source) in enumerate(rows):
        text += (f" {k}x {PASSAGE} y{k}" if k % 3 == 1 else "") + (f" {items[k % len(items)][1]} z{k}" if k % 5 == 2 else "")
        docs[d] = (text, lang, source)
    top = max(docs)
    docs |= {top + 1 + k: docs[d] for k, d in enumerate(sorted(docs)[:40])}
    docs |= {top + 100 + k: (f"buy{k % 7} cheap pills click here now!!! $$$ {k} " * 20, "en", f"src{k % 5}") for k in range(80)}
    # Rows without an id, or with an id that another row has, get ids above all others, in order of id and text.
    table = [(d, *r, len(r[0])) for d, r in docs.items()] + [(None, "no id " + docs[top][0][:300], "en", "s", 5), (min(docs), "~ second row of an id", "en", "s2", 20)]
    most = max(docs)
    docs |= {most + 1: table[-2][1:4], most + 2: table[-1][1:4]}
    pq.write_table(pa.table(dict(zip(corpus_pipeline.COLUMNS, map(list, zip(*table))))), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    marks = [(d, int(d < top + 100), int(d >= top + 100)) for d in docs if d <= most]
    pq.write_table(pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*marks))))), tmp_path / "labels.parquet")

    named = spark.createDataFrame([(d, *r) for d, r in docs.items()], "doc_id long, text string, lang string, source string")
    good = {r.doc_id for r in quality.classify(named, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted == 1}
    texts = {d: docs[d][0] for d in good}
    groups = brute.components({d: brute.fingerprint(t) for d, t in texts.items()})
    apart = {d: t for d, t in texts.items() if groups[d] == d}
    left = without_repeats(apart)
    leaks = {d for d, _ in brute.contaminated(list(left.items()), items)}
    clean = {d: t for d, t in left.items() if d not in leaks}
    # Every stage has something to do.
    assert len(docs) > len(texts) > len(apart) and left != apart and len(left) > len(clean) > 0

    laid, bins = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        laid[r.doc_id] = laid.get(r.doc_id, 0) + r.length
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert laid == {d: len(brute.SPACE.findall(t.encode())) for d, t in clean.items()}
    for held in bins.values():
        assert sum(r.length for r in held) + held[0].free == 2048
        names = [docs[r.doc_id][2] for r in held if r.length and docs[r.doc_id][2] is not None]
        assert len(names) == len(set(names))
