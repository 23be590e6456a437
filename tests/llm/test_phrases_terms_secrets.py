"""Operators 11 to 13: small frames with nulls, ties, repeats and long texts, and the driver tables."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.llm import divergence, phrases, quotient, secrets
from recurra.llm import queries as Q
from recurra.llm.transducer import Transducer
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("word", "slice", "id", "n", "term", "ordinal", "idx", "p", "rank", "spans", "kind", "salt")})


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    words = [f"{chr(97 + i % 26)}{'é' * (i % 3)}{i}" for i in range(vocabulary)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ",\t", " \n", " A"]) for _ in range(n))


ROWS = [("en", "s1", prose(1, 1500, 12)), ("en", "s2", prose(2, 900, 14)), ("en", "s2", prose(2, 900, 14)), ("en", None, None), ("de", "s1", ""), (None, "s1", prose(3, 300, 8)),
        ("und", "s9", prose(4, 300, 8)), ("en", "s3", "the same words. " * 30), ("fr", "s1", "!?.,"), (None, None, "a b"), ("en", "s4", "x" * 70_000 + " " + "y z " * 20)]


def test_phrases(spark):
    df = table(spark, ROWS)
    want = brute.phrases([(a, t) for a, _, t in ROWS])
    assert len(want) > 80
    # A slice of few words cuts texts; many ranges and few ranges merge to the same.
    for options in ({}, {"slice_words": 7}, {"range_words": 16}, {"slice_words": 1}):
        assert {tuple(r) for r in phrases.mine(df, **options).collect()} == want
    assert {tuple(r) for r in phrases.mine(df, top=3).collect()} == brute.phrases([(a, t) for a, _, t in ROWS], top=3)
    assert phrases.mine(df.where("doc_id = -1")).count() == 0
    assert phrases.mine(df.where("lang = 'de'")).count() == 0


def test_phrases_of_parts(spark):
    """Tasks that hand their filters on early."""
    df = table(spark, ROWS)
    assert {tuple(r) for r in phrases.mine(df, slice_words=50, held=5).collect()} == brute.phrases([(a, t) for a, _, t in ROWS])


@pytest.mark.parametrize("bits", [4, 17, 21, 22, 32])
def test_quotient_filters(bits):
    """Keys come back whole from permuted, dealt and merged filters, whatever their width."""
    r = np.random.default_rng(bits)
    keys = quotient.Keys(bits)
    ids = [r.integers(0, 1 << bits, 3000, dtype=np.uint64) for _ in range(3)]
    ids = [np.concatenate([x, x[:1000], np.full(400, x[0])]) for x in ids]
    parts = []
    for piece in (slice(0, 1500), slice(1500, None)):
        part = quotient.count(*keys.pack(*(x[piece] for x in ids)), None, keys.w)
        parts.append(quotient.read(quotient.write(*part, keys.w, keys.w), keys.w, keys.w))
    hi, lo, n = quotient.merge(parts, keys.w)
    got = dict(zip(zip(*(x.tolist() for x in keys.unpack(hi, lo))), n.tolist()))
    want = {}
    for k in zip(*(x.tolist() for x in ids)):
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_transducer():
    terms = sorted({w.encode() for w in prose(5, 3000, 900).split()} | {b"a", b"ab", b"abc", "éé".encode(), b"z" * 300})
    t = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    words = terms + [b"", b"abcd", b"q", b"z" * 299, b"z" * 301, "é".encode()]
    data = np.frombuffer(b" ".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length + 1) - length - 1
    place = {w: i for i, w in enumerate(terms)}
    assert t.ordinals(data, start, length).tolist() == [place.get(w, -1) for w in words]
    # Minimal: the same endings are shared.
    assert len(Transducer.build([b"tapping", b"topping"]).final) == 8


def test_divergence(spark):
    rows = ROWS + [("en", f"t{i % 5}", prose(i, 30)) for i in range(60)] + [("de", "s1", None), ("de", "s0", "Nur ein Wort")]
    df = table(spark, rows)
    for least in (30, 3, 1):
        want = brute.divergence(rows, least)
        # Small blocks and passes of one transducer each give the same.
        for options in ({}, {"block_terms": 5, "pass_bytes": 1}):
            assert {tuple(r) for r in divergence.audit(df, least, **options).collect()} == want
    assert divergence.audit(df.where("doc_id = -1")).count() == 0


def test_divergence_tiles(spark):
    rows = [("en", f"t{i % 7}", prose(i, 40)) for i in range(40)]
    assert {tuple(r) for r in divergence.audit(table(spark, rows), 5, block=7, tile=2, held=3).collect()} == brute.divergence(rows, 5)


KEY = "kJ8s2LqPz91XbV7tRm4c"
TEXTS = [None, "", "api_key: abcdef", "API-KEY=abc\nPASSWORD = 'hunter22' token='x'", "é token=" + "ab12" * 10, "AKIA" + "Q" * 16 + " AKIA1 " + "0" * 23 + " " + "0" * 24,
         "ſecret=abcdefgh toKen=abcdefgh", f"Our signing secret {KEY} must stay here.", f"a name {KEY} without the word", "the private key 000000000000000000000000000a1b",
         "word " * 300_000 + f"auth {KEY}", f"token={KEY}", "session abcdefghijklmnopqrstuvwx"]


def test_secrets(spark):
    df = table(spark, [("en", "s", t) for t in TEXTS])
    got = {r.doc_id: [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans] for r in secrets.scan(df).collect()}
    assert {i: [s for s in spans if s[1] < 3] for i, spans in got.items()} == {i: brute.base_spans(t) for i, t in enumerate(TEXTS)}
    novel = {i: [TEXTS[i][s:e] for s, k, e in spans if k == 3] for i, spans in got.items()}
    assert {i: v for i, v in novel.items() if v} == {7: [KEY], 10: [KEY]}
    assert secrets.scan(df.where("doc_id = -1")).count() == 0
    assert secrets.scan(df.where("doc_id = 7").union(df.where("doc_id = 7"))).count() == 2


def test_secret_novelty():
    """Random keys cost about their length within prose, names made of known words less."""
    texts = [t.encode() for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) > 1500").fetchall()][:50]
    words = sorted({w for t in texts for w in secrets.IDENTIFIER.findall(t) if len(w) < 8})[:1000]
    measure, r = secrets.Novelty(words, 9), random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = names = 0
    for t in texts:
        key, name = "".join(r.choices(alphabet, k=24)).encode(), b"_".join(r.choices(words, k=4)) + b"2"
        keys += measure.of(t[:600] + key + t[600:], 600, 600 + len(key)) >= 0.85
        names += measure.of(t[:600] + name + t[600:], 600, 600 + len(name)) >= 0.85
    assert keys >= 0.9 * len(texts) and names <= 0.2 * len(texts)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def test_op11(spark, documents):
    assert {tuple(r) for r in Q.op11_phrase_collocations(spark, SF).collect()} == brute.phrases([(r[2], r[1]) for r in documents])


def test_op12(spark, documents):
    want = brute.divergence([(r[2], r[3], r[1]) for r in documents])
    assert want and {tuple(r) for r in Q.op12_source_divergence(spark, SF).collect()} == want


def test_op13(spark, documents):
    rows = {r.doc_id: r for r in Q.op13_secret_scans(spark, SF).collect()}
    assert len(rows) == len(documents)
    for doc_id, text, *_ in documents:
        spans, r = brute.base_spans(text), rows[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == brute.sha(brute.span_text(spans).encode())
        assert [s for s in r.spans.split(",") if not s.startswith("novel")] == brute.span_text(spans).split(",")
