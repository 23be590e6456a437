"""The registered queries on the smallest driver tables against plain versions."""

from __future__ import annotations

import os

import duckdb
import pytest

from recurra.llm import queries as Q
from recurra.llm import token_counts
from tests.llm import brute

SF = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return {t: con.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in
            ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")}


@pytest.fixture(scope="module")
def texts(tables):
    return {r[0]: r[1] for r in tables["documents"]}


def test_op1(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in Q.op1_suffix_array_dedup(spark, SF).collect()}
    assert got == brute.suffix_dedup(texts)


def test_op2_rows(spark, texts):
    rows = Q.op2_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op2_held_out_accuracy(spark):
    """sf0.1 has some 850 held-out labels."""
    sf = "/root/testdata/sf0.1"
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = [(r.score, label[r.doc_id], r.predicted) for r in Q.op2_quality_classifier(spark, sf).collect()
            if r.held_out and r.doc_id in label]
    good, bad = [s for s, q, _ in rows if q], [s for s, q, _ in rows if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98 and sum(q == p for _, q, p in rows) / len(rows) > 0.95


def test_op3(spark, tables):
    got = {(r.doc_id, r.item_id): r.similarity for r in Q.op3_benchmark_decontamination(spark, SF).collect()}
    want = brute.contaminated([r[:2] for r in tables["documents"]], tables["benchmark"])
    assert want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_op4(spark, tables):
    counts = token_counts.counter(*token_counts.default_vocabulary())
    got = {r.doc_id: r for r in Q.op4_token_counts(spark, SF).collect()}
    assert len(got) == len(tables["documents"])
    for doc_id, text, lang, source, _ in tables["documents"]:
        text, r = text or "", got[doc_id]
        assert (r.n_before or 0) == len(counts.encoding.encode_ordinary(text))
        n = len(text)
        cut, drop = n // 3, n // 10
        text = text[:n // 2] + f" {lang or ''} " + text[n // 2 + 5:]
        text = text[:cut] + text[cut + drop:]
        text = text[:n + 100] + f"\n{source or ''}" + text[n + 100:]
        assert r.n_tokens == len(counts.encoding.encode_ordinary(text)) and r.n_chars == len(text)


def test_op5(spark, tables):
    rows = [*tables["conversations"], (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r[0]: tuple(r[1:5]) for r in Q.op5_chat_formatting(spark, SF).collect()}
    assert got == brute.chat(rows)


def test_op6(spark, texts):
    rows = Q.op6_simhash_near_dedup(spark, SF).collect()
    want = {d: brute.fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in want.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute.components(want)


def test_op7(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in Q.op7_substring_dedup(spark, SF).collect()}
    assert got == brute.substring_dedup(texts)


def test_op8(spark, tables, texts):
    rows = Q.op8_best_fit_packing(spark, SF).collect()
    source = {r[0]: r[3] for r in tables["documents"]}
    words = {d: len(brute.SPACE.findall((t or "").encode())) for d, t in texts.items()}
    laid, bins = dict.fromkeys(texts, 0), {}
    for r in rows:
        laid[r.doc_id] += r.length
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert laid == words
    for held in bins.values():
        assert sum(r.length for r in held) + held[0].free == 2048
        names = [source[r.doc_id] for r in held if r.length and source[r.doc_id] is not None]
        assert len(names) == len(set(names))


def test_op9(spark, tables):
    got = {r.page_id: r for r in Q.op9_url_filters(spark, SF).collect()}
    assert len(got) == len(tables["pages"])
    for page_id, u, _ in tables["pages"]:
        host, path, rule, verdict = brute.url(u)
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict or rule is None and r.verdict in ("allow", "block"))


def test_op10(spark, tables):
    got = {tuple(r) for r in Q.op10_exact_top_k(spark, SF).collect()}
    assert got == brute.top_k([r[:2] for r in tables["embeddings"]])
