"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(docs, window=100):
    """docs: {doc_id: text}. Rows (doc_id, n_bytes, n_removed, n_spans, sha of the rest)."""
    seen, out = set(), {}
    for doc_id in sorted(docs):
        data = (docs[doc_id] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1):
            w = data[s:s + window]
            if w in seen:
                gone[s:s + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g)))
    return out


def substring_dedup(docs, window=13):
    first, words = {}, {d: SPACE.findall((t or "").encode()) for d, t in docs.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprint(text, k=3):
    words = SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    """fps: {doc_id: fingerprint}."""
    parent = {f: f for f in set(fps.values())}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(sorted(parent), np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ f) <= radius):
            a, b = root(int(f)), root(int(values[i + 1 + j]))
            parent[a] = b
    least = {}
    for d, f in fps.items():
        r = root(f)
        least[r] = min(least.get(r, d), d)
    return {d: least[root(f)] for d, f in fps.items()}


def chat(rows):
    """rows: (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0], t[1], t[2]))
        masked = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()), len(masked), sha(masked.encode()))
    return out


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url(u):
    """(host, path, rule, verdict of the rule)."""
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def top_k(rows, k=5, scale=256, is_query=lambda i: i % 50 == 0):
    """Rows with multiplicity; an id's smallest vector is the query."""
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    queries, out = {}, set()
    for q, v in good:
        if is_query(q):
            queries[q] = min(queries.get(q, v), v)
    for q, v in queries.items():
        scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def shingle_counts(words, k=5):
    return Counter(tuple(words[i:i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1))


def contaminated(docs, items, threshold=0.8):
    """{(doc_id, item_id): best similarity} over all item-sized windows."""
    def words(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    split = {d: words(t) for d, t in docs}
    for item, text in items:
        want = words(text)
        if item is None or not want:
            continue
        a, n = shingle_counts(want), len(want)
        for d, w in split.items():
            if not w or not set(want) & set(w):
                continue
            best = 0
            for s in range(max(1, len(w) - n + 1)):
                if n < 5 and len(w) < n:
                    continue
                part = w[s:s + n]
                if len(part) < 5 <= n:
                    continue
                b = shingle_counts(part)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                out[d, item] = best
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def phrases(rows, min_count=10, top=2000):
    """rows: (lang, text). {(lang, rank, phrase, a, l, r, n, score)}."""
    grams = {}
    for lang, text in rows:
        f = grams.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in grams.items():
        n, found = sum(c for g, c in f.items() if len(g) == 1), []
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        inside = Counter()
        for g, c in often.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], c)
        for g, a in often.items():
            if len(g) == 3 or 100 * inside[g] < 50 * a:
                score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return out


def divergence(rows, min_docs=30, top=50):
    """rows: (lang, source, text). {(lang, source, part, item, value, rank)}."""
    texts = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for a, s, t in rows]
    out = set()
    for lang in {t[0] for t in texts}:
        own = [(s, w) for a, s, w in texts if a == lang]
        docs = Counter(t for _, w in own for t in set(w))
        kept = sorted((t for t, c in docs.items() if c >= min_docs), key=str.encode)
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if docs[t] >= min_docs)
        whole = sum(counts.values(), Counter())

        def share(c):
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            marks = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def base_spans(text):
    """Spans of the plain patterns: (start, kind's place, end)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def span_text(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'novel')[k]}:{s}:{e}" for s, k, e in spans)
