"""Containment of sentences in texts, and label conflicts found with it.

A sentence of 2 ** c up to 2 ** (c + 1) bytes is known by a fingerprint of its
first 2 ** c bytes.  Fingerprints of all windows of a text follow from one
running sum, so a text is looked at once for each class of short sentences and
once for all longer ones, of which only places that fit the first ``SHORT``
bytes of any sentence are looked at again.  A filter of fixed size tells which
fingerprints there are; the places that pass it are joined with the sentences
and compared byte by byte, so a chance meeting does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.staging import written_once

#: Bytes of the first window of all longer sentences.
SHORT = 8
#: Bits of the filter, 2 MB whatever the sentences are.
FILTER_BITS = 24
#: Text that is looked at at once, and different places that a task remembers where only existence is asked.
CHUNK, REMEMBERED = 1_000_000, 200_000

_BASE = 0x9E3779B97F4A7C55
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of any window follows."""
    letters = data.astype(np.uint64) + np.uint64(1)
    letters *= _table(len(data) + 1)[0][: len(data)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters)))


def _spread(x: np.ndarray, size: int) -> np.ndarray:
    x += np.uint64(size * 0xD6E8FEB86659FD93 % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x


def fingerprints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Of the windows of ``size`` bytes that begin at some places."""
    return _spread((sums[at + size] - sums[at]) * _table(len(sums))[1][at], size)


def all_fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """Of all windows of ``size`` bytes, in order."""
    n = max(0, len(sums) - size)
    x = sums[size:] - sums[:n]
    x *= _table(len(sums))[1][:n]
    return _spread(x, size)


def first_size(n: int) -> int:
    """Bytes of a sentence of ``n`` that its fingerprint sees: the largest power of two."""
    return 1 << (n.bit_length() - 1)


def _prints(needles: DataFrame) -> DataFrame:
    """``needle, size, print, short`` of distinct sentences; ``short`` is the print of the first bytes of longer ones."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                data = np.frombuffer(text.encode(), np.uint8)
                size, sums, zero = first_size(len(data)), running(data), np.zeros(1, np.int64)
                own = fingerprints(sums, zero, size).view(np.int64)[0]
                out.append((text, size, int(own), int(fingerprints(sums, zero, min(size, SHORT)).view(np.int64)[0])))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["needle", "size", "print", "short"])

    return needles.mapInArrow(run, "needle string, size long, print long, short long")


def _filter(prints: DataFrame) -> np.ndarray:
    """A bit for every fingerprint that there is; at most 2 ** 18 numbers come to the driver."""
    place = F.call_function("shiftrightunsigned", F.col("p"), F.lit(64 - FILTER_BITS))
    every = prints.select(F.explode(F.array("print", "short")).alias("p")).select(F.call_function("shiftright", place, F.lit(6)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table = every.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def _passing(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - FILTER_BITS)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def places(data: np.ndarray, edges: np.ndarray, sizes: list[int], words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``size``, places and fingerprints that pass the filter; no window crosses an edge between texts."""
    sums = running(data)
    end = np.repeat(edges[1:], np.diff(edges))  # where each byte's text ends
    longer = None
    for size in sizes:
        if size <= SHORT or longer is None:
            first = min(size, SHORT)
            found = all_fingerprints(sums, first)
            at = np.flatnonzero(_passing(words, found))
            at = at[at + first <= end[at]]
            found = found[at]
            if size >= SHORT:
                longer = at
        if size > SHORT:
            at = longer[longer + size <= end[longer]]
            found = fingerprints(sums, at, size)
            keep = _passing(words, found)
            at, found = at[keep], found[keep]
        yield size, at, found


def pieces(texts: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in groups of about ``CHUNK`` bytes; longer ones in pieces that overlap, so that no window is cut."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        for a in range(0, max(1, len(text)), CHUNK):
            owners.append(i)
            held.append(text[a : a + CHUNK + overlap])
            size += len(held[-1])
            if size >= CHUNK:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def _met(sentences: DataFrame, rows: DataFrame, keys: list[str], sentence: str, with_id: bool) -> DataFrame:
    """``needle`` (and ``id``) of sentences found in ``rows(id, text)``, and the keys of the sentences."""
    checked = F.when(F.col(sentence) == "", F.raise_error(F.lit("an empty sentence")).cast("string")).otherwise(F.col(sentence))
    wanted = sentences.where(F.col(sentence).isNotNull()).select(*keys, checked.alias("needle"))
    prints = written_once(_prints(wanted.select("needle").distinct()))
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # powers of two: some dozens
    sent = rows.sparkSession.sparkContext.broadcast(_filter(prints))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        seen: set = set()
        for whole in batches:
            for owners, part in pieces(whole.column(1), 2 * sizes[-1] if sizes else 0):
                edges = np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64)
                raw = b"".join(part)
                out: dict[tuple, None] = {}
                for size, at, found in places(np.frombuffer(raw, np.uint8), edges, sizes, sent.value):
                    owner = np.searchsorted(edges, at, side="right") - 1
                    for a, p, o in zip(at.tolist(), found.view(np.int64).tolist(), owner.tolist()):
                        place = (p, raw[a : min(a + 2 * size - 1, int(edges[o + 1]))])
                        if not with_id:
                            if place in seen:
                                continue
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(place)
                        out[(owners[o], *place)] = None
                at = pa.array([o for o, _, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(0).take(at), pa.array([p for _, p, _ in out], pa.int64()), pa.array([r for _, _, r in out], pa.binary())], ["id", "print", "rest"])

    if not with_id:
        rows = rows.select(F.lit(0).alias("id"), "text")
        kind = "int"
    hits = rows.mapInArrow(run, f"id {kind}, print long, rest binary")
    needle = F.col("needle").cast("binary")
    same = hits.join(prints.select("needle", "print"), "print").where(F.substring("rest", 1, F.octet_length("needle")) == needle)
    return same.select("id", "needle").distinct().join(wanted, "needle")


def contained(sentences: DataFrame, texts: DataFrame, keys: list[str], sentence: str, id_col: str, text: str) -> DataFrame:
    """Keys of sentences and ids of texts that hold them as substrings.

    Not a loop over all pairs, and one pass over the texts however many
    sentences there are.  Only places that fit a sentence's first half are
    shuffled.  A text that holds a sentence several times gives one row, and so
    do rows that share an id; null sentences and texts give none; an empty
    sentence is an error, since it is in every text.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return _met(sentences, rows, keys, sentence, True).select(*keys, F.col("id").alias(id_col))


def present(sentences: DataFrame, texts: DataFrame, keys: list[str], sentence: str, text: str) -> DataFrame:
    """Keys of sentences that any text holds, once each.

    A task hands a place on once, whatever the number of texts that have it.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.lit(0).alias("id"), F.col(text).alias("text"))
    return _met(sentences, rows, keys, sentence, False).select(*keys).distinct()


def conflicts(sentences: DataFrame, hits: DataFrame, keys: list[str], part: str, kept_label: Column) -> DataFrame:
    """``conflict``: all parts of a row are covered though its label says otherwise.

    One way only: rows that the label already takes for sufficient never conflict.
    """
    found = hits.select(*keys, part).distinct().withColumn("_hit", F.lit(1))
    whole = sentences.join(found, [*keys, part], "left").groupBy(*keys).agg((F.count("_hit") == F.count("*")).alias("complete"))
    return whole.withColumn("conflict", F.col("complete") & ~kept_label)


def supporting(rows: DataFrame, id_col: str) -> DataFrame:
    """``id, title, index, sentence`` of ``facts`` looked up in ``context``.

    A title given twice takes its last sentences; a fact given twice counts
    once; an index out of bounds or a blank sentence is an error.
    """
    facts = rows.select(id_col, "context", F.explode(F.array_distinct("facts")).alias("f"))
    titled = F.filter("context", lambda c: c["title"] == F.col("f.title"))
    sentences = F.element_at(titled, F.when(F.size(titled) > 0, F.lit(-1)))["sentences"]
    found = facts.select(id_col, F.col("f.title").alias("title"), F.col("f.index").alias("index"), F.get(sentences, F.col("f.index").cast("int")).alias("sentence"))
    checked = F.when(F.coalesce(F.btrim("sentence") != "", F.lit(False)), F.col("sentence")).otherwise(F.raise_error(F.lit("no such supporting sentence")))
    return found.withColumn("sentence", checked)
