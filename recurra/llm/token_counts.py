"""Edit-aware token counting (operator 4).

A text's tokens are those of a public byte-level BPE vocabulary (a tiktoken
ranks file, by default the one of ``public_tokenizers``). The pre-tokenizer
cuts a text into pre-tokens, which are encoded independently, so a text's
count is the sum over its pre-tokens. Per document a segment tree is kept: its
leaves are runs of ``LEAF`` pre-tokens with their characters and tokens, its
inner nodes are sums. An edit touches a few leaves: the text is cut again from
the start of the leaf before the edit (the cut of a pre-token may look at most
two characters past its end) until the new cuts meet a leaf border beyond the
edit, where old and new cuts agree from there on. Only that region is encoded;
the tree's other leaves stay and the sums on the paths to the root are
updated.

Trees are a table (doc_id, text, leaf_chars, tree); edits are a table (doc_id,
seq, start, removed, inserted) applied in seq order. A document's edits meet
its row in one group, so an edit list is bounded by its document's history.

Defined cases: null text is empty; an empty text has no leaves and count 0;
edits beyond the end are moved to the end, negative starts to 0, and a null
inserted text is empty; edits of unknown documents are ignored; a null doc_id
keeps its row and meets no edit; repeated rows each have a tree and get the
same edits; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import clean_docs

LEAF = 64
#: Characters past its end that the cut of a pre-token can depend on.
LOOK = 2
TREES = "doc_id long, text string, leaf_chars array<int>, tree array<long>"


def default_vocabulary() -> tuple[str, str]:
    """(path of the ranks file, pre-token pattern) of the public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pretokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, pre: str) -> int:
        n = self.known.get(pre)
        if n is None:
            if len(self.known) > 500_000:
                self.known.clear()
            n = self.known[pre] = len(self.encoding.encode_ordinary(pre))
        return n

    def leaves(self, pres: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run of LEAF pre-tokens."""
        chars, toks = [], []
        known, tokens = self.known, self.tokens
        for i in range(0, len(pres), LEAF):
            run = pres[i:i + LEAF]
            chars.append(sum(map(len, run)))
            toks.append(sum(known[p] if p in known else tokens(p) for p in run))
        return chars, toks


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def build(leaf_tokens: list[int]) -> list[int]:
    """Segment tree as an array: node 1 is the root, node i has children 2i and 2i + 1, leaves at the end."""
    size = 1 << max(0, (len(leaf_tokens) - 1).bit_length())
    level = np.zeros(size, np.int64)
    level[:len(leaf_tokens)] = leaf_tokens
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1)
        levels.append(level)
    return [0] + np.concatenate(levels[::-1]).tolist()


class Document:
    """A text with its leaves and tree; edits keep them in step."""

    def __init__(self, text: str, leaf_chars: list[int], tree: list[int], counts: Counter):
        self.text, self.chars, self.tree, self.counts = text, leaf_chars, tree, counts
        self.encoded = 0  # characters encoded again by edits

    @classmethod
    def of(cls, text: str, counts: Counter) -> "Document":
        chars, toks = counts.leaves(counts.cut.findall(text))
        return cls(text, chars, build(toks), counts)

    @property
    def total(self) -> int:
        return self.tree[1] if len(self.tree) > 1 else 0

    def leaf_tokens(self) -> list[int]:
        size = len(self.tree) // 2
        return self.tree[size:size + len(self.chars)]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(start + max(removed, 0), n)
        text = self.text[:start] + inserted + self.text[stop:]
        shift = len(text) - n
        borders = np.concatenate([[0], np.cumsum(self.chars, dtype=np.int64)])
        # The last border whose pre-tokens before it cannot have seen the edit.
        first = max(int(np.searchsorted(borders, start - LOOK, "right")) - 1, 0)
        at = int(borders[first])
        meet = {int(b) + shift: k for k, b in enumerate(borders.tolist()) if b >= stop and k >= first}
        pres, last = [], len(self.chars)
        changed_to = start + len(inserted)
        for m in self.counts.cut.finditer(text, at):
            if m.start() >= changed_to and m.start() in meet and (pres or meet[m.start()] > first):
                last = meet[m.start()]
                break
            pres.append(m.group())
        chars, toks = self.counts.leaves(pres)
        self.encoded += sum(chars)
        self.text = text
        if len(chars) == last - first:  # the leaves keep their places: only their paths to the root change
            self.chars[first:last] = chars
            size = len(self.tree) // 2
            dirty = set()
            for k, t in enumerate(toks):
                if self.tree[size + first + k] != t:
                    self.tree[size + first + k] = t
                    dirty.add((size + first + k) // 2)
            while dirty and 0 not in dirty:
                for x in dirty:
                    self.tree[x] = self.tree[2 * x] + self.tree[2 * x + 1]
                dirty = {x // 2 for x in dirty}
        else:  # leaves came or went: the sums above them move, their counts are kept
            kept = self.leaf_tokens()
            self.chars = self.chars[:first] + chars + self.chars[last:]
            self.tree = build(kept[:first] + toks + kept[last:])


def trees(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The tree table of ``docs``; tree[1] is the count (an empty text has the tree [0, 0])."""
    vocabulary = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches):
        counts = counter(*vocabulary)
        for b in batches:
            done = [Document.of(t.as_py(), counts) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array([d.chars for d in done], pa.list_(pa.int32())),
                 pa.array([d.tree for d in done], pa.list_(pa.int64()))], ["doc_id", "text", "leaf_chars", "tree"])

    return clean_docs(docs).mapInArrow(run, TREES)


def apply_edits(tree_rows: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The tree table after ``edits``, with the tokens before, n_edits and the characters encoded again."""
    vocabulary = (path, pattern) if path and pattern else default_vocabulary()
    own = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), F.coalesce("inserted", F.lit("")).alias("inserted")))).alias("edits"))
    rows = tree_rows.join(own, "doc_id", "left")
    schema = TREES + ", n_before long, n_edits int, encoded_chars long"

    def run(batches):
        counts = counter(*vocabulary)
        for b in batches:
            done, n, before = [], [], []
            for text, chars, tree, todo in zip(*(b.column(c).to_pylist() for c in ("text", "leaf_chars", "tree", "edits"))):
                d = Document(text, chars, tree, counts)
                before.append(d.total)
                for e in todo or ():
                    d.edit(e["start"] or 0, e["removed"] or 0, e["inserted"])
                done.append(d)
                n.append(len(todo or ()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([d.text for d in done], pa.string()),
                 pa.array([d.chars for d in done], pa.list_(pa.int32())), pa.array([d.tree for d in done], pa.list_(pa.int64())),
                 pa.array(before, pa.int64()), pa.array(n, pa.int32()), pa.array([d.encoded for d in done], pa.int64())],
                ["doc_id", "text", "leaf_chars", "tree", "n_before", "n_edits", "encoded_chars"])

    return rows.select("doc_id", "text", "leaf_chars", "tree", "edits").mapInArrow(run, schema)
