"""Packing, url verdicts and quality scores against plain versions on the smallest driver tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import zstandard

from recurra.llm import packing, quality
from recurra.llm import queries as Q
from recurra.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_pack(items, capacity):
    """items: (size, source or None, cluster). Every bin as (its pieces, what it has left), looked through one by one."""
    bins, todo = [], []
    for i, (n, _, _) in enumerate(items):
        start = 0
        while n - start > capacity or (n - start == capacity and n > capacity):
            bins.append([{(i, start, capacity)}, 0, None, None])  # a full piece has its bin to itself
            start += capacity
        if n > start or not n:
            todo.append((-(n - start), i, start))
    for minus, i, start in sorted(todo):
        n, (_, source, cluster) = -minus, items[i]
        own_s, own_c = ({source} - {None}, {cluster}) if n else (set(), set())
        fits = [(b[1], k) for k, b in enumerate(bins) if b[2] is not None and b[1] >= n and not b[2] & own_s and not b[3] & own_c]
        if fits:
            held = bins[min(fits)[1]]
        else:
            held = [set(), capacity, set(), set()]
            bins.append(held)
        held[0].add((i, start, n))
        held[1] -= n
        held[2] |= own_s
        held[3] |= own_c
    return [(frozenset(b[0]), b[1]) for b in bins]


def test_pack_shard():
    for seed in range(30):
        r = random.Random(seed)
        items = [(r.choice([0, 1, 3, 7, 10, 20, 21, 40, 45]), r.choice([None, 1, 2, 3]), r.randrange(6)) for _ in range(120)]
        bins, free = packing.pack_shard([n for n, _, _ in items], [-1 if s is None else s for _, s, _ in items], [c for _, _, c in items], 20)
        assert [(frozenset(b), f) for b, f in zip(bins, free)] == plain_pack(items, 20)


def test_op8(spark):
    docs = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()}
    shards, got = defaultdict(set), defaultdict(set)
    for r in Q.op8_best_fit_packing(spark, SF).collect():
        shards[r.shard].add(r.doc_id)
        got[r.shard, r.bin, r.free].add((r.doc_id, r.start, r.length))
    want = {}
    for shard, ids in shards.items():
        ids = sorted(ids)
        items = []
        for d in ids:
            words = re.findall(r"[^\x20\x09-\x0D]+", (docs[d][0] or "").lower())
            items.append((len(words), docs[d][1], " ".join(words)))
        for b, (held, free) in enumerate(plain_pack(items, packing.CAPACITY)):
            want[shard, b, free] = {(ids[i], s, n) for i, s, n in held}
    assert dict(got) == want


def plain_verdicts(pages, bad_of, max_fan=20, rare=0.2, strength=20.0, threshold=0.5, z=1.96):
    """{page_id: (verdict, template)}. bad_of: {page_id: bool}."""
    shapes = defaultdict(lambda: [0, 0, 0])
    of_page = {}
    for page_id, url in pages:
        host, path, _, verdict = brute.url(url)
        shape = tuple(re.sub("[0-9]+", "*", s) for s in path.split("/") if s)
        of_page[page_id] = (host, shape, verdict)
        t = shapes[host, shape]
        t[0] += 1
        t[1] += page_id in bad_of
        t[2] += bad_of.get(page_id, False)
    template = {k: () for k in shapes}
    for level in range(max((len(s) for _, s in shapes), default=0)):
        nodes = defaultdict(lambda: defaultdict(int))
        for (host, shape), t in shapes.items():
            if len(shape) > level:
                nodes[host, template[host, shape]][shape[level]] += t[0]
        for host, shape in shapes:
            if len(shape) > level:
                kids = nodes[host, template[host, shape]]
                wide = len(kids) > max_fan and len(kids) >= rare * sum(kids.values())
                template[host, shape] += ("*" if wide else shape[level],)
    leaf, pool, hosts, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]

    def branch(t):
        places = [i for i, s in enumerate(t) if "*" not in s]
        return t[:places[-1]] + ("*",) + t[places[-1] + 1:] if places else t
    for (host, shape), (_, labelled, bad) in shapes.items():
        t = template[host, shape]
        for into in (leaf[host, t], pool[host, branch(t)], hosts[host], every):
            into[0] += labelled
            into[1] += bad
    out = {}
    for page_id, (host, shape, verdict) in of_page.items():
        t = template[host, shape]
        n, bad = leaf[host, t]
        pool_n, pool_bad = pool[host, branch(t)]
        p = pool_bad / max(pool_n, 1)
        if n == 0 or abs(bad / max(n, 1) - p) <= z * (p * (1 - p) / max(n, 1)) ** 0.5:
            n, bad = pool_n, pool_bad
        prior = (hosts[host][1] + strength * (every[1] / every[0] if every[0] else 0)) / (hosts[host][0] + strength)
        out[page_id] = (verdict or ("block" if (bad + strength * prior) / (n + strength) >= threshold else "allow"), "/" + "/".join(t))
    return out


def test_op9(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    want = plain_verdicts(pages, {d: q == 0 or t == 1 for d, q, t in labels})
    assert {r.page_id: (r.verdict, r.template) for r in Q.op9_url_filters(spark, SF).collect()} == want


def test_op2_scores(spark):
    """Each score from compressors of its own: sizes piece by piece, the curve by hand."""
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    assert model["dicts"]
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())

    def size(raw, data):
        c = zstandard.ZstdCompressor(level=model["level"], dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(data[i:i + 512])) for i in range(0, len(data), 512))

    def curve(x):
        points = list(zip(model["x"], model["y"]))
        if x <= points[0][0]:
            return points[0][1]
        for (a, p), (b, q) in zip(points, points[1:]):
            if x <= b:
                return p + (q - p) * (x - a) / (b - a) if b > a else q
        return points[-1][1]
    rows = quality.score(docs, model).collect()
    off = 0
    for r in rows:
        data = texts[r.doc_id].encode()
        x = (size(model["dicts"][1], data) - size(model["dicts"][0], data)) / max(len(data), 1)
        off += abs(curve(x) - r.score) > 0.02
    assert len(rows) == len(texts) and off <= 0.02 * len(rows)
