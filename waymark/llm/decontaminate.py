"""Operator 5: benchmark decontamination by a generalised suffix automaton.

The words of all test items build one suffix automaton.  A document's words
stream through it, which gives at every word the length of the longest match
that ends there; where it reaches a window, the window's words are hit.  Words
that no item holds end every match, so only runs of item words are walked.

The automaton is built from blocks of items of at most ``BLOCK_BYTES`` of text
(more items make more blocks, one pass after the other), which bounds what is
sent to the executors.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, resident, small_batches

BLOCK_BYTES = 1_000_000
GROUP_BYTES = 2_000_000

#: A-Z in lower case, everything between words a space; other bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over the word sequences of test items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        for item, words in items:
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.shortest = min(self.shortest, len(ids))
            last = 0
            for i in ids:
                last = self._extend(last, i)
        whole: dict[int, list[tuple[int, str]]] = {}
        owners = [set() for _ in self.next]
        # every state on an item's path, and all its suffixes, belong to the item
        for item, words in items:
            state = 0
            for w in words:
                state = self.next[state][self.vocabulary[w]]
                s = state
                while s > 0 and item not in owners[s]:
                    owners[s].add(item)
                    s = self.link[s]
            if 0 < len(words) < window:
                whole.setdefault(state, []).append((len(words), item))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        #: The state of the last ``window`` words of a match, 0 if it is shorter.
        self.at_window = [0] * len(order)
        #: Items shorter than a window that end where a match ends.
        self.short: list[list[tuple[int, str]]] = [[] for _ in order]
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.short[s] = self.short[up] + whole.get(s, [])
        self.owners = [frozenset(o) for o in owners]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the words to ``p`` and ``c`` alone, apart from ``q``."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans [first, end) of a document's words, merged, and the items."""
        n = len(words)
        if n < self.shortest or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[list[int]] = []
        items: set[str] = set()
        follow, link, length, window = self.next, self.link, self.length, self.window
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first < self.shortest:
                continue
            state = matched = 0
            for i, c in enumerate(ids[first:end].tolist(), first):
                while state and c not in follow[state]:
                    state = link[state]
                    matched = length[state]
                state = follow[state].get(c, 0)
                matched = matched + 1 if state else 0
                hit = 0
                if matched >= window:
                    hit = window
                    items |= self.owners[self.at_window[state]]
                for size, item in self.short[state]:
                    if size <= matched:
                        hit = max(hit, size)
                        items.add(item)
                if hit:
                    # a shorter match may begin before spans already found end
                    start = i + 1 - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, items


def _automaton(key: str, items, window: int) -> Automaton:
    return resident(("decontaminate", key), lambda: Automaton(items, window))


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """Test items in blocks of bounded size: (key, [(item, words)], whether it is the last)."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        found = sorted((r.item or "", words_of(bytes(r.text))) for r in block.toLocalIterator())
        yield hashlib.sha1(repr(found).encode()).hexdigest(), found, k == n - 1


def match_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words, spans, items``.

    ``spans`` are the hit words [first, end), merged and ascending; ``items``
    the ids (as strings, sorted) of test items of which a window occurs.  A
    window is ``window`` consecutive words of an item, or a whole item of
    fewer words.  Null and empty texts have no words; repeated rows give
    repeated results; empty tables give empty results or no hits; ``keep``
    names columns to carry along (in a struct ``row``) whatever their names.
    """
    return _matched(docs, items, id_col, text_col, item_col, item_text_col, window, keep).withColumnRenamed("id", id_col)


def _matched(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, keep: tuple, after=None, fields: tuple = ()) -> DataFrame:
    """Rows of ``match_benchmark``, or what ``after`` makes of batches of them: columns ``row`` and ``fields``.

    It runs where the last block is matched, so a task needs no further Python worker.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.ArrayType(T.LongType()))
    frame = small_batches(docs).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"), *([F.struct(*keep).alias("row")] if keep else []),
    )
    schema = frame.schema
    for key, block, last in _blocks(items, item_col, item_text_col):
        sent = spark.sparkContext.broadcast((key, block))

        finish = after if last and after else lambda batch: batch

        def match(batches, sent=sent, finish=finish):
            automaton = _automaton(f"{sent.value[0]}{window}", sent.value[1], window)
            for whole in batches:
                for batch in byte_slices(whole, "text", GROUP_BYTES):
                    n_words, spans, names = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
                    for i, text in enumerate(batch.column(1).to_pylist()):
                        words = words_of(text) if text else []
                        n_words.append(len(words))
                        found, hit = automaton.matches(words)
                        if found:
                            spans[i] = _union(spans[i] + found)
                            names[i] = sorted({*names[i], *hit})
                    done = pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string())), *(batch.column(i) for i in range(5, batch.num_columns))],
                        batch.schema.names,
                    )
                    yield finish(done)

        frame = frame.mapInArrow(match, T.StructType([schema["row"], *fields]) if last and after else schema)
    return frame


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def digests(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of ``match_benchmark`` as one flat row per document."""
    return matched.select(
        id_col, "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text less the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, end = [], 0
    for first, last in spans:
        out.append(text[end : at[first][0]])
        end = at[last - 1][1]
    return b"".join([*out, text[end:]])


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    A hit span of more than ``max_span`` words is cut out of the text; a
    document of whose words more than ``max_coverage`` are hit goes as a whole.
    Other rows come back as they were, nulls and repeated rows included.
    """

    def cut(batch):
        found = list(zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist()))
        batch = batch.filter(pa.array([sum(b - a for a, b in spans) <= max_coverage * n for n, spans in found], pa.bool_()))
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            long_spans = [s for s in spans if s[1] - s[0] > max_span]
            texts.append(_without(text, long_spans).decode() if long_spans else None)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "cut"])

    done = _matched(docs, items, id_col, text_col, item_col, item_text_col, window, tuple(docs.columns), cut, (T.StructField("cut", T.StringType()),))
    return done.select(*(F.coalesce("cut", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT g.r, g.i, g.n, win.item FROM g JOIN win ON g.n = win.n AND g.g = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
