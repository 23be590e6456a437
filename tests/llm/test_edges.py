"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recurra.llm import chat, decontam, packing, quality, simhash, substring, suffix_dedup, token_counts, topk, url_filter
from tests.llm import brute

LONG = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(60_000))
PASSAGE = " ".join(f"alpha{i} beta{i * 7}" for i in range(40))
ROWS = [(1, "Some text. " + PASSAGE + " end"), (2, None), (3, ""), (4, LONG), (5, PASSAGE + " other end"), (6, LONG), (None, "no id"),
        (7, "a" * 700), (8, "é" * 150 + PASSAGE)]
CLASH = ("bucket", "kind", "data", "fp", "h", "component", "hits", "starts", "key", "n", "shard", "cluster")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "s1" if i else None, 0) for i, t in ROWS],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


TEXTS = {i: t for i, t in ROWS if i is not None}


def by_row(rows):
    """{own id: (given id, text)}: rows that lack an id, or repeat one with a later text, count as documents after all others."""
    first = {}
    for i, t in rows:
        if i is not None and (i not in first or (t or "") < first[i]):
            first[i] = t or ""
    extra = list(rows)
    for i, t in first.items():
        extra.remove(next(r for r in extra if r[0] == i and (r[1] or "") == t))
    extra = sorted(((i is not None, i or 0, t or "") for i, t in extra))
    out = {i: (i, t) for i, t in first.items()}
    return out | {max(first) + k: (i if known else None, t) for k, (known, i, t) in enumerate(extra, 1)}


def rows_of(want, own):
    return sorted(((own[k][0], *v) for k, v in want.items()), key=str)


def spark_rows(docs, rows):
    return docs.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))


def test_suffix_dedup(docs, none):
    def result(rows, **options):
        return sorted((tuple(r) for r in suffix_dedup.dedup(rows, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)

    own = by_row(ROWS)
    got = result(docs)
    assert got == rows_of(brute.suffix_dedup({k: t for k, (_, t) in own.items()}), own)
    twice = ROWS + [(1, PASSAGE), (6, "short"), (None, LONG[:5000])]
    own = by_row(twice)
    assert result(spark_rows(docs, twice)) == rows_of(brute.suffix_dedup({k: t for k, (_, t) in own.items()}), own)
    # Hot anchors take the way by window digests, found in their bucket or by one map task of several; the result is the same.
    for rows, hot, held in ((docs, 1, 512), (docs, 20_000, 1), (docs.repartition(3, "doc_id"), 20_000, 1), (docs.repartition(3, "doc_id"), 2, 2)):
        assert result(rows, hot=hot, hot_held=held) == got
    assert suffix_dedup.dedup(none).count() == 0


def test_substring(docs, none):
    twice = ROWS + [ROWS[0], (6, PASSAGE + " z"), (None, "no id")]
    own = by_row(twice)
    got = substring.dedup(spark_rows(docs, twice)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == rows_of(brute.substring_dedup({k: t for k, (_, t) in own.items()}), own)
    assert substring.dedup(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    fps = {i: brute.fingerprint(t) for i, t in TEXTS.items()}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == brute.components(fps)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_cut_buckets(spark):
    """Buckets that are cut into pivot cells give the same components."""
    import random
    random.seed(3)
    fps = set()
    for _ in range(60):
        f = random.getrandbits(64)
        fps.add(f)
        for _ in range(20):
            fps.add(f ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute.components({f: f for f in fps})
    for rows in (8192, 2):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for u, v in simhash.links(df, 3, bucket_rows=rows).collect():
            a, b = root(u & (1 << 64) - 1), root(v & (1 << 64) - 1)
            parent[max(a, b)] = min(a, b)
        assert {f: root(f) for f in fps} == want


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(none, labels.where("doc_id = -1")).count() == 0


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, PASSAGE.upper()), (2, None), (3, ""), (4, "alpha0 beta0"), (None, PASSAGE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == set(brute.contaminated(ROWS, items.collect()))
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(docs, items.where("item_id = -1")).count() == 0


def test_token_edits(docs, none, spark):
    edits = spark.createDataFrame([(1, 1, 5, 3, "xyz  "), (1, 2, 0, 0, None), (3, 1, 9, 9, "new"), (4, 1, 1000, 7, " 't "), (99, 1, 0, 0, "a")],
                                  "doc_id long, seq int, start int, removed int, inserted string")
    counts = token_counts.counter(*token_counts.default_vocabulary())
    rows = token_counts.apply_edits(token_counts.trees(docs), edits).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.tree[1] == len(counts.encoding.encode_ordinary(r.text))
    assert token_counts.apply_edits(token_counts.trees(none), edits).count() == 0


def test_chat(spark):
    data = [(1, 0, "user", "a\\#<b\n"), (1, 0, "user", "a\\#<b\n"), (1, 1, None, None), (None, 2, "assistant", "x" * 5000), (3, 0, "user", "\\#<" * 300_000 + "y" * 2_000_000),
            (3, 1, "assistant", "é\n\\🙂<" * 300_000), (3, 2, "assistant", ""),
            (2, None, "assistant", "</turn>\n### user\n"), (2, 1, "a:\n#b", "é"),
            (4, 1, "user", "a b"), (4, 1, "user", "a"), (4, 1, "user", "a\n"), (4, 1, "user", "#"), (4, 1, "user", "!"), (4, 1, "user", "a<")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("msg", F.lit(2))
    got = {r[0]: tuple(r[1:5]) for r in chat.digests(chat.format_conversations(chat.events_of(df))).collect()}
    assert got == brute.chat(data)
    assert chat.digests(chat.format_conversations(chat.events_of(df.where("conv_id = -1")))).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, capacity=100).collect()
    laid = {}
    for r in rows:
        laid[r.doc_id] = laid.get(r.doc_id, 0) + r.length
    assert laid == {i: len(brute.SPACE.findall((t or "").encode())) for i, t in ROWS}
    assert packing.pack_documents(none).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.NET", "https://x.example.net/en/1?q", "http://y.example.com/de/1", "http://org/fr/#z", "ftp://h/a/b/c7.html"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    marks = spark.createDataFrame([(1, True), (1, False), (None, True), (7, None)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(pages, marks).collect()}
    assert got == {i: brute.url(u)[:3] for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.where("page_id = -1"), marks).count() == 0


def test_url_templates(spark):
    """A node with many rare children becomes variable at every level; one very long path costs no levels."""
    urls = [f"http://h/{'abc'[i % 3]}/{chr(97 + i % 26)}{chr(97 + i // 26)}/end" for i in range(90)] + ["http://h/" + "/".join(["x"] * 2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    got = {r.page_id: r.template for r in url_filter.filter_urls(pages, marks).collect()}
    assert {got[i] for i in range(90)} == {"/a/*/end", "/b/*/end", "/c/*/end"}
    assert got[90] == "/" + "/".join(["x"] * 2000)


def test_top_k(spark):
    data = [(i, [float(i % 3), 1.0, -0.5 * (i % 2)]) for i in range(1, 130)] + [(150, None), (200, [1.0, None, 0.0]), (250, [float("nan"), 1.0, 1.0]),
            (300, []), (350, [1.0, 2.0]), (400, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("id", F.lit(2))
    assert {tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0).collect()} == brute.top_k(data)
    assert topk.top_k(df.where("vec_id = -1"), lambda i: i % 50 == 0).count() == 0


def test_top_k_repeats_and_large_components(spark):
    """Repeated rows have ranks of their own; ids with several vectors; components that pass 32 bits, products that pass 63."""
    import random
    r = random.Random(4)
    data = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(1, 160)] + [(13, [1.0, 1.0, 1.0, 1.0])] * 3
    data += [(50, [0.9, 0.9, 0.9, 0.9])] * 7 + [(50, [0.5, 0.5, 0.5, 0.5]), (50, [-1.0, 0.0, 0.5, 2.0]), (100, [1e8, -1e8, 3.0, 4.0]), (171, [1e8, 1e8, 1e8, -1e8]),
             (172, [1e15, 1.0, -1e15, 2.0]), (150, [1e17, 1e17, 0.0, -2.0]), (173, [1e17, 3.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for options in ({}, {"first_reads": 1}, {"cand_block": 7, "query_block": 2}):
        got = [tuple(x) for x in topk.top_k(df, lambda i: i % 50 == 0, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == brute.top_k(data)


def test_top_k_outlier_leaves_the_bounds_tight(spark):
    import numpy as np
    r = np.random.default_rng(5)
    data = [(i, r.normal(size=64).tolist()) for i in range(2000)] + [(5001, (r.normal(size=64) * 1e5).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 256)
    entries = topk._entries(vectors, 5).persist()
    queries = vectors.where("id % 50 = 0").groupBy("id").agg(F.min("ints").alias("ints"))
    assert topk.candidate_bounds(entries, queries, 5, 2048, 4096).count() < 0.05 * 40 * 2001


def test_token_edits_of_rows_that_share_an_id(spark, tmp_path):
    """Each row gets its own three edits."""
    from recurra.llm import queries
    rows = [(7, f"row {i} of one id", "en", "s") for i in range(300)] + [(None, "no id", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == 301 and sum(r.n_edits for r in got) == 903 and sum(r.doc_id is None for r in got) == 1


def test_quality_sample_is_bounded(spark):
    """An id that very many rows have counts once."""
    rows = [(1, f"the same id {i} " * 5) for i in range(500)] + [(i, f"good text number {i} " * 5) for i in range(2, 60)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 60)] + [(3, 9)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, made = [], quality._dictionary
    quality._dictionary = lambda pieces, size: seen.append(len(pieces)) or made(pieces, size)
    try:
        model = quality.fit(docs, labels, per_class=20)
    finally:
        quality._dictionary = made
    assert model["dicts"] and max(seen) <= 20
