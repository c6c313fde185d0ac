"""Operator 6: passages that repeat across documents, by sparse suffix arrays.

Of every run of ``min_words`` words, the place whose next ``K`` words have the
smallest hash is retained; equal passages retain equal places, so a passage
that repeats meets itself there.  Retained suffixes whose first ``K`` words
stand in one document only are dropped.  The others are sorted among those
that share ``K`` words and a further stretch to the left or right of them;
neighbours in that order give the longest common extensions to the right, and
the same order of the reversed left contexts to the left.  Where both together
may reach ``min_words``, the extended runs themselves are sorted and neighbours
compared, which makes the result exact also in groups of many suffixes.

Equal contexts are one row from the first shuffle on, and equal documents one
document, so common passages and large groups of copies stay small.  The
contexts of a very common stretch are no one task's memory: beyond ``MOST`` of
them, their runs meet in sums that Spark combines before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, discard, sifted, small_batches, split_by, staged
from .wordhash import mix, shingle_hashes, word_hashes

#: Words of a retained suffix that must repeat at once.
K = 8
GROUP_BYTES = 1_000_000
#: Contexts of one stretch that are sorted together.
MOST = 1000
#: Low bits of a place's key that hold the place itself.
PLACE = np.uint64((1 << 22) - 1)
FACTORS = mix(np.arange(100, 612, dtype=np.uint64)) | np.uint64(1)


def retained(words: np.ndarray, edges: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Retained places of texts: ``(text, place, first run, last run)``, hashes.

    Every run of ``span`` words belongs to one retained place within it.
    """
    hashes = shingle_hashes(words, K)
    runs = len(words) - span + 1
    if runs <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    # sliding minimum of (hash, place) over the K-word places of a run
    best = (mix(hashes) & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, need = 1, span - K + 1
    while width * 2 <= need:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < need:
        best = np.minimum(best[: -(need - width)], best[need - width :])
    place = (best[:runs] & PLACE).astype(np.int64)
    text = np.searchsorted(edges, np.arange(runs), side="right") - 1
    whole = edges[text + 1] >= np.arange(runs) + span
    starts = np.flatnonzero(whole)
    place, text = place[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1 if len(first) else first
    base = edges[text[first]]
    return text[first], place[first] - base, starts[first] - base, starts[last] - base, hashes[place[first]]


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """``id, t, n, s1, s2, h, p, a, b``: a row per document, its retained places.

    ``(s1, s2)`` is a digest of the word sequence, ``n`` its length; ``t``
    comes along and tells the texts of one id apart.
    """

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                words, edges = word_hashes(batch.column(1))
                if len(words) > int(PLACE):  # one text of so many words: its places are found piece by piece
                    pieces = [retained(words[x : x + int(PLACE)], np.array([0, len(words[x : x + int(PLACE)])]), span) for x in range(0, len(words), int(PLACE) - span + 1)]
                    shift = np.concatenate([np.full(len(q[0]), x) for q, x in zip(pieces, range(0, len(words), int(PLACE) - span + 1))])
                    text, p, a, b, h = (np.concatenate(c) for c in zip(*pieces))
                    p, a, b = p + shift, a + shift, b + shift
                    text = text + int(np.argmax(np.diff(edges) > 0))
                else:
                    text, p, a, b, h = retained(words, edges, span)
                n = np.diff(edges)
                order = np.arange(len(words), dtype=np.uint64) - np.repeat(edges[:-1], n).astype(np.uint64)
                sums = [np.zeros(len(words) + 1, np.uint64) for _ in range(2)]
                for s, salt in zip(sums, (11, 13)):
                    np.cumsum(mix(words + order * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)), out=s[1:])
                cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (h.view(np.int64), p, a, b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n), *(pa.array((s[edges[1:]] - s[edges[:-1]]).view(np.int64)) for s in sums), *lists],
                    ["id", "t", "n", "s1", "s2", "h", "p", "a", "b"],
                )

    return docs.select("id", "text", "t").mapInArrow(run, "id long, t long, n long, s1 long, s2 long, h array<long>, p array<long>, a array<long>, b array<long>")


def contexts(texts: DataFrame, span: int, with_words: bool) -> DataFrame:
    """Contexts of the retained places ``places(p, a, b)`` of ``(id, t, most, text, places)``.

    Runs that reach ``span * 2 // 5`` words left of their place share that
    stretch, the others one to the right; it is their ``key``.  ``digest``
    names the whole context, ``lo .. hi`` its runs relative to the place, and
    ``words`` are 32-bit codes of all its words.
    """
    far = span * 2 // 5

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                words, edges = word_hashes(batch.column(1))
                codes = (words >> np.uint64(32)).astype(np.uint32)
                weight = mix(words)
                out = []
                for doc, base, places, t, most in zip(batch.column(0).to_pylist(), edges[:-1].tolist(), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
                    for q in places:
                        p, a, b = q["p"] + base, q["a"] + base, q["b"] + base
                        for side, lo, hi, stretch in ((1, a, min(b, p - far - 1), slice(p - far - 1, p + K)), (2, max(a, p - far), b, slice(p, p - far + span))):
                            if lo > hi:
                                continue
                            part = weight[stretch]
                            key = int((part * FACTORS[: len(part)]).sum(dtype=np.uint64) + np.uint64(side)) & 0x7FFFFFFFFFFFFFFF
                            part = weight[lo : hi + span]
                            digest = int((part * FACTORS[: len(part)]).sum(dtype=np.uint64) + np.uint64(1000 * (p - lo) + side)) & 0x7FFFFFFFFFFFFFFF
                            out.append((key, digest, doc, t, most, p - base, lo - p, hi - p, codes[lo : hi + span].tobytes() if with_words else None))
                types = [*[pa.int64()] * 8, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "digest", "id", "t", "most", "p", "lo", "hi", "words"])

    return texts.select("id", "text", "places", "t", "most").mapInArrow(run, "key long, digest long, id long, t long, most long, p long, lo long, hi long, words binary")


def _common(matrix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For rows in sorted order: the longest prefix shared with either neighbour."""
    rows = matrix[order]
    same = rows[1:] == rows[:-1]
    shared = np.where(same.all(1), same.shape[1], np.argmin(same, 1))
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = shared
    np.maximum.at(out, order[:-1], shared)
    return out


def compare(rows: list[tuple[int, int, int, int, np.ndarray]], span: int) -> list[list[list[int]]]:
    """Repeated runs (first, last, relative to the place) of each context.

    ``rows`` have ``lo, hi`` (neither above 0), the least and the largest id of
    the documents with the context, and its word codes.  They share a key, and
    all contexts are different.
    """
    out: list[list[list[int]]] = [[[lo, hi]] if least != most else [] for lo, hi, least, most, _ in rows]
    if len({x for row in rows for x in row[2:4]}) == 1 or len(rows) == 1:
        return out
    left = max(-lo for lo, *_ in rows)
    right = max(row[1] + span for row in rows)
    # the words after the place, and those before it in reverse; places past a context's end differ from all
    ahead = np.tile(np.arange(len(rows), dtype=np.int64)[:, None] + (1 << 40), (1, max(right, 1)))
    behind = np.tile(np.arange(len(rows), dtype=np.int64)[:, None] + (1 << 40), (1, max(left, 1)))
    for x, (lo, _, _, _, codes) in enumerate(rows):
        ahead[x, : len(codes) + lo] = codes[-lo:]
        behind[x, :-lo] = codes[:-lo][::-1]
    reach = _common(ahead, np.lexsort(ahead.T[::-1]))
    back = _common(behind, np.lexsort(behind.T[::-1]))
    firsts, hashes, owner = [], [], []
    for x, (lo, hi, _, _, codes) in enumerate(rows):
        a, b = max(lo, -int(back[x])), min(hi, int(reach[x]) - span)
        if a > b:
            continue
        runs = np.lib.stride_tricks.sliding_window_view(codes, span)[a - lo : b - lo + 1]
        firsts.append(np.arange(a, b + 1))
        hashes.append((mix(runs.astype(np.uint64)) * FACTORS[:span]).sum(1, dtype=np.uint64))
        owner.append(np.full(b - a + 1, x))
    if not firsts:
        return out
    first, hashed, own = np.concatenate(firsts), np.concatenate(hashes), np.concatenate(owner)
    # neighbours in the order of whole runs, and whether several documents hold them
    order = np.lexsort((own, hashed, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
    heads = np.flatnonzero(new)
    least, most = (np.array([r[i] for r in rows])[own[order]] for i in (2, 3))
    several = np.minimum.reduceat(least, heads) != np.maximum.reduceat(most, heads)
    for at in order[np.repeat(several, np.diff(np.append(heads, len(order))))]:
        out[own[at]].append([int(first[at]), int(first[at])])
    return [_joined(runs) for runs in out]


def single_runs(groups: DataFrame, span: int) -> DataFrame:
    """``digest, key, runs`` as ``repeated_runs`` finds them, whatever the groups' sizes."""

    def run(batches):
        for batch in batches:
            for key, digest, lo, hi, least, most, words in zip(*(batch.column(i).to_pylist() for i in range(7))):
                runs = np.lib.stride_tricks.sliding_window_view(np.frombuffer(words, np.uint32), span)
                hashed = (mix(runs.astype(np.uint64)) * FACTORS[:span]).sum(1, dtype=np.uint64).view(np.int64)
                n = len(hashed)
                same = [pa.array(np.full(n, x)) for x in (key, digest, least, most)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, hi + 1)), pa.array(hashed)], ["key", "digest", "least", "most", "first", "run"])

    rows = groups.select("key", "digest", "lo", "hi", "least", "most", "words").mapInArrow(run, "key long, digest long, least long, most long, first long, run long")
    several = rows.groupBy("key", "first", "run").agg(F.min("least").alias("x"), F.max("most").alias("y")).where("x <> y").drop("x", "y")
    found = rows.join(several, ["key", "first", "run"])
    return found.groupBy("digest", "key").agg(F.collect_set(F.array("first", "first")).alias("runs"))  # at most a run a place of a context


def _joined(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def repeated_runs(groups: DataFrame, span: int) -> DataFrame:
    """``digest, key, runs`` of contexts that hold repeated runs."""

    def run(batches):
        held: list[tuple] = []

        def closed():
            found = compare([(*row[1:5], np.frombuffer(row[5], np.uint32)) for row in held], span)
            out = [(d[0], last, r) for d, r in zip(held, found) if r]
            held.clear()
            types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["digest", "key", "runs"])

        last = None
        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and key != last:
                    yield closed()
                last = key
                held.append(tuple(row))
        if held:
            yield closed()

    return groups.select("key", "digest", "lo", "hi", "least", "most", "words").mapInArrow(run, "digest long, key long, runs array<array<long>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``id, text_hash, first_word, end_word, n_words``: passages that other documents hold too.

    A word (between ASCII white space, A-Z in lower case) is in a passage if
    some run of ``min_words`` words around it occurs in a document of another
    id; touching and overlapping runs are one passage.  A row per passage, by
    word positions [first, end).  Texts that are null or shorter have none;
    rows that repeat an id are texts of one document, of which each is looked
    at (``text_hash`` tells them apart) and none is another one's repeat;
    repeats of a whole row give no more rows; null ids are left out; an empty
    table gives an empty result; other columns are not read.
    """
    span = min_words
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("t")).where("id is not null")
    rows = staged(anchors(texts, span).where(F.col("n") >= span))
    by_text = ["s1", "s2", "n"]
    classes = staged(rows.groupBy(*by_text).agg(F.min("id").alias("rep"), F.max("id").alias("most")))
    # one row stands for all of a class
    reps = staged(rows.join(classes.withColumnRenamed("rep", "id"), [*by_text, "id"]).dropDuplicates(by_text))
    places = reps.select("id", "t", "most", F.explode(F.arrays_zip("h", "p", "a", "b")).alias("q")).select("id", "t", "most", "q.*")
    shared = places.groupBy("h").agg(F.min("id").alias("x"), F.max("most").alias("y")).where("x <> y").select("h")
    shared = staged(shared)  # read back, a frequent place can be split in the join
    surviving = places.join(shared, "h").groupBy("id", "t", "most").agg(F.collect_list(F.struct("p", "a", "b")).alias("places"))
    surviving = staged(surviving)
    full = staged(sifted(texts, surviving).join(surviving, ["id", "t"]).dropDuplicates(["id", "t"]))
    members = staged(contexts(full, span, False).select("key", "digest", "id", "t", "p"))
    common = staged(members.select("key", "digest").distinct().groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > MOST).select(F.col("key").alias("id")))
    distinct = contexts(full, span, True).groupBy("key", "digest", "lo", "hi").agg(F.min("id").alias("least"), F.max("most").alias("most"), F.any_value("words").alias("words"))
    large, small = split_by(distinct, common, "key")
    found = repeated_runs(small.repartition("key").sortWithinPartitions("key", "digest"), span)
    if not common.isEmpty():
        found = found.unionByName(single_runs(large, span))
    found = staged(found)
    hits = members.join(found, ["key", "digest"]).select("id", "t", "p", F.explode("runs").alias("r"))
    runs = hits.select("id", "t", (F.col("p") + F.col("r")[0]).alias("a"), (F.col("p") + F.col("r")[1] + span).alias("b"))
    # the spans of a text, touching ones joined
    order = Window.partitionBy("id", "t").orderBy("a", "b")
    so_far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.distinct().withColumn("new", (so_far.isNull() | (F.col("a") > so_far)).cast("int")).withColumn("k", F.sum("new").over(order))
    spans = marked.groupBy("id", "t", "k").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    of_reps = staged(spans)
    # a text that several documents hold repeats as a whole
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    by_class = reps.select("id", "t", "most", *by_text).join(of_reps, ["id", "t"], "left").select(*by_text, F.when(F.col("id") != F.col("most"), whole).otherwise(F.col("runs")).alias("runs"))
    result = rows.select("id", "t", *by_text).distinct().join(by_class.where("runs is not null"), by_text).select("id", "t", F.explode("runs").alias("r"))
    for done in (full, found, shared, surviving, members, common):
        discard(done)
    return result.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("r.a").alias("first_word"), F.col("r.b").alias("end_word"), (F.col("r.b") - F.col("r.a")).alias("n_words"))
