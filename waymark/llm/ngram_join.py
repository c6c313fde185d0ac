"""Operator 7: n-gram Jaccard join with adaptive multi-match prefixes.

Sets are ordered by rarity: a shingle is at most as frequent as its rarest
word, whose count over all documents is known if it is among the
``MOST_COUNTED`` most frequent (others are rare).  Two sets that are similar
enough share a shingle within their prefixes, and ``m`` shingles if both
prefixes are longer by ``m - 1``.  Each document lengthens its prefix as long
as the estimated cost of its candidates falls, and as many shared shingles are
then asked for before a pair is verified on whole sets.

Documents meet by the smallest id that shares a prefix shingle, so a group of
near copies meets in one or a few places instead of as pairs.  Places with many
documents are cut into blocks, and the document of the smallest id stands in
each of them; what a block connects with it need not be compared across blocks.
Only the rest is then compared with the other blocks.  Within a block, pairs
that are connected already are not verified again, and only a star of each
connected part leaves it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, resident, sifted, small_batches, staged, without
from .components import components
from .wordhash import PLACES, mix, shingle_hashes, word_hashes

GROUP_BYTES = 1_000_000
#: Words counted before a task hands its counts on.
COUNTED_WORDS = 4_000_000
#: Size of the table of word counts that is broadcast (16 bytes a word), and
#: the count from which a word is worth a place in it.
MOST_COUNTED, LEAST_COUNT = 1_000_000, 32
#: A place with more documents or text bytes than this is cut into blocks.
BLOCK_DOCS, BLOCK_BYTES = 400, 4_000_000
MOST_MATCHES = 4
#: Cost of verifying a candidate against that of reading a posting.
VERIFY_COST = 20.0


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (hash), ``n`` of the words with ``n >= LEAST_COUNT``."""

    def count(batches):
        resident(("ngram_join",), dict)  # what an operator before this one remembers goes
        held: list[np.ndarray] = []

        def closed():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                held.append(word_hashes(batch.column(0))[0])
                if sum(map(len, held)) >= COUNTED_WORDS:
                    yield closed()
        if held:
            yield closed()

    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_words(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of at most ``MOST_COUNTED`` words."""
    counts = staged(word_counts(docs, text_col))
    level = F.floor(F.log2("n") * 8).alias("level")
    levels = counts.groupBy(level).count().orderBy(F.desc("level")).collect()  # a few hundred rows
    held, least = 0, 0
    for row in levels:
        if held + row["count"] > MOST_COUNTED:
            break
        held, least = held + row["count"], row["level"]
    kept = counts.where(F.floor(F.log2("n") * 8) >= least).limit(MOST_COUNTED).toArrow() if held else None
    discard(counts)
    if kept is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, n = kept.column("word").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of ``n`` with a set that is similar enough."""
    return -(-n * num // den)


def set_hashes(words: np.ndarray, a: int, b: int, shingles: np.ndarray, k: int) -> np.ndarray:
    """All shingles of the document whose words are ``[a, b)``, with repeats."""
    if b - a >= k:
        return shingles[a : b - k + 1]
    if b == a:
        return np.zeros(0, np.uint64)
    return mix(np.array([np.sum(words[a:b] * PLACES[: b - a], dtype=np.uint64) + np.uint64(b - a)], np.uint64))


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """``id, t, n, s1, s2, bytes, matches, prefix``: a row per row of ``docs``.

    ``t`` tells the texts of one id apart, ``n`` is the size of the set, ``(s1, s2)`` its digest, ``prefix`` its
    rarest shingles, ``matches`` how many of them a partner must share.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text_col))

    def rarity(hashes: np.ndarray) -> np.ndarray:
        known, counts = sent.value
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, counts[at], 0)

    def profile(batches):
        resident(("ngram_join",), dict)
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                words, edges = word_hashes(batch.column(1))
                shingles = shingle_hashes(words, k)
                counts = rarity(words)
                rare = counts[: len(shingles)].copy()
                for j in range(1, k):
                    np.minimum(rare, counts[j : j + len(shingles)], out=rare)
                out = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    found = set_hashes(words, a, b, shingles, k)
                    distinct, at = np.unique(found, return_index=True)
                    n = len(distinct)
                    if not n:
                        out.append((0, 0, 0, 0, distinct))
                        continue
                    cost = rare[a + at] if b - a >= k else np.zeros(1, np.int64)
                    base = n - needed(n, num, den)
                    order = np.lexsort((distinct, cost))[: base + MOST_MATCHES]
                    read = np.cumsum(np.maximum(cost[order], 1)).astype(float)
                    most = min(MOST_MATCHES, len(order) - base)
                    m = np.arange(1, most + 1)
                    matches = int(np.argmin(read[base + m - 1] * (1 + VERIFY_COST / m**2))) + 1
                    spread = mix(distinct)
                    out.append((n, int(spread.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(spread + np.uint64(1)))), matches, distinct[order[: base + matches]]))
                sizes = np.cumsum([0, *(len(x[4]) for x in out)])
                flat = np.concatenate([x[4] for x in out]) if out else np.zeros(0, np.uint64)
                signed = lambda i: pa.array(np.array([x[i] for x in out], np.uint64).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(3), signed(0), signed(1), signed(2), batch.column(2), signed(3), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))],
                    ["id", "t", "n", "s1", "s2", "bytes", "matches", "prefix"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(text_col).alias("t"))
    return rows.mapInArrow(profile, "id long, t long, n long, s1 long, s2 long, bytes long, matches long, prefix array<long>")


class Forest:
    """Disjoint sets over 0 .. n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def compare(ids: np.ndarray, block: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], texts: pa.Array, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links (document, smallest connected document) among those of one place.

    With two blocks only pairs across them are looked at.
    """
    n = len(ids)
    words, edges = word_hashes(texts)
    shingles = shingle_hashes(words, k)
    sets = [np.unique(set_hashes(words, a, b, shingles, k)) for a, b in zip(edges[:-1], edges[1:])]
    sizes = np.array([len(s) for s in sets])
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    tokens, at = np.unique(np.concatenate(prefixes), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])
    order = np.argsort(at, kind="stable")
    posts, first = owner[order], np.searchsorted(at[order], np.arange(len(tokens) + 1))
    cuts = np.cumsum([0, *(len(p) for p in prefixes)])
    across = block.min() != block.max()
    marked = np.zeros(local.max() + 1, bool)
    forest = Forest(n)
    for x in range(n - 1):
        shared = np.bincount(np.concatenate([posts[first[t] : first[t + 1]] for t in at[cuts[x] : cuts[x + 1]]]), minlength=n)
        small, large = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        able = (shared >= np.minimum(matches, matches[x])) & (small * den >= large * num)
        able[: x + 1] = False
        if across:
            able &= block != block[x]
        candidates = np.flatnonzero(able)
        if len(candidates):
            up = forest.roots()
            candidates = candidates[up[candidates] != up[x]]
        if not len(candidates):
            continue
        own = slice(starts[x], starts[x] + sizes[x])
        marked[local[own]] = True
        if len(candidates) * 4 > n:
            both = np.add.reduceat(marked[local], starts, dtype=np.int64)[candidates]
        else:
            both = np.array([np.count_nonzero(marked[local[starts[c] : starts[c] + sizes[c]]]) for c in candidates])
        marked[local[own]] = False
        for c in candidates[both * den >= (sizes[candidates] + sizes[x] - both) * num]:
            forest.join(x, int(c))
    roots = forest.roots()
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(roots) if i != r]


def links(places: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges ``a, b`` found in every place; its rows come in one run of a task."""

    def run(batches):
        resident(("ngram_join",), dict)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[pa.RecordBatch] = []

        def closed():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            t = t.sort_by("id")
            prefix = t.column("prefix").combine_chunks()
            flat, cut = prefix.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(prefix).to_numpy())))
            found = compare(
                t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("matches").to_numpy(),
                [flat[a:b] for a, b in zip(cut[:-1], cut[1:])], t.column("text").combine_chunks(), k, num, den,
            )
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

        last = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            bounds = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
                if b == a:
                    continue
                key = tuple(keys[:, a])
                if held and key != last:
                    yield closed()
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield closed()

    return places.mapInArrow(run, "a long, b long")


def _verified(tiles: DataFrame, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges ``a, b`` among the documents ``(id, t)`` of each tile ``(leader, i, j)``."""
    full = tiles.join(reps.select("id", "t", "matches", "prefix"), ["id", "t"]).join(texts, ["id", "t"])
    dealt = full.select("leader", "i", "j", "block", "id", "matches", "prefix", "text").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return staged(links(dealt, k, num, den))


def _met(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``leader, id, t, bytes``: where documents meet, by the smallest id that shares a shingle."""
    base = (F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1).cast("int")
    tokens = reps.select("id", "t", "n", "bytes", F.explode(F.slice("prefix", F.lit(1), base)).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    # similar sets have similar sizes: they share a size bucket or stand in adjacent ones
    level = F.floor(F.log(F.col("n").cast("double") * (1 + 1e-9)) / math.log(den / num) if num < den else F.col("n")).cast("long")
    sized = staged(tokens.join(common, "token").withColumn("level", F.explode(F.array(level, level + 1))).drop("n"))
    least = sized.groupBy("token", "level").agg(F.min("id").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = staged(sized.join(least, ["token", "level"]).select("leader", "id", "t", "bytes").distinct())
    discard(sized)
    return met


def _edges(docs: DataFrame, reps: DataFrame, several: bool, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Edges ``a, b`` (ids) that connect whatever links connect."""
    met = _met(reps, num, den)
    texts = sifted(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("t")), met.select("id"))
    if several:
        texts = texts.join(met.select("id", "t").distinct(), ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
    sizes = met.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("bytes").alias("held"))
    number = lambda n, held: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK_DOCS)), F.ceil(F.col(held) / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    large = staged(sizes.select("leader", number("docs", "held").alias("blocks")).where("blocks > 1"))
    own = lambda n: F.pmod(F.xxhash64("id", "t"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = met.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = F.explode(F.when(F.col("id") == F.col("leader"), every("blocks")).otherwise(F.array(own("blocks")))).alias("i")
    edges = _verified(cut.select("leader", blocks, F.lit(0).alias("j"), F.lit(0).alias("block"), "id", "t"), reps, texts, k, num, den)
    if not large.isEmpty():
        # what its block did not connect with the leader meets all blocks
        every_doc = met.join(large, "leader")
        rest = staged(every_doc.where("id <> leader").join(edges.select(F.col("a").alias("id"), F.col("b").alias("leader")), ["leader", "id"], "left_anti"))
        parts = rest.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("bytes").alias("held")).select("leader", number("docs", "held").alias("parts"))
        left = rest.join(parts, "leader").select("leader", own("parts").alias("i"), F.explode(every("blocks")).alias("j"), F.lit(0).alias("block"), "id", "t")
        right = every_doc.join(parts, "leader").select("leader", F.explode(every("parts")).alias("i"), own("blocks").alias("j"), F.lit(1).alias("block"), "id", "t")
        edges = edges.unionByName(_verified(left.unionByName(right), reps, texts, k, num, den))
    return edges


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``.

    Documents link when ``den * intersection >= num * union`` of their sets of
    word shingles; ``component_id`` is the smallest id reachable by links.  A
    text with fewer words is one shingle as a whole; null and empty texts have
    none and link with nothing; copies of a text always link.  Rows that share
    an id are one document that has the links of all its texts, and repeated
    rows come back as often.  A row with a null id links with nothing and has
    a null component.  An empty table gives an empty result; other columns are
    not read.
    """
    k = shingle_words
    rows = staged(profiles(small_batches(docs), id_col, text_col, k, num, den))
    real = rows.where("n > 0 and id is not null")
    # equal sets are one class, whose smallest id stands for it
    by_set = ["s1", "s2", "n"]
    classes = staged(real.groupBy(*by_set).agg(F.min("id").alias("rep")))
    again = staged(real.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    several = not again.isEmpty()
    reps = real.join(classes.withColumnRenamed("rep", "id"), [*by_set, "id"])
    reps = staged(reps.dropDuplicates([*by_set, "id"]) if several else reps)
    edges = _edges(docs, reps, several, id_col, text_col, k, num, den)
    if several:  # the classes of an id's texts are connected
        edges = edges.unionByName(real.join(again, "id").join(classes, by_set).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    tops = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*by_set, F.coalesce("component", "rep").alias("component"))
    out = rows.drop("prefix").join(tops, by_set, "left")
    same_id = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    discard(reps)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), same_id.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each similar group: that of the smallest id.

    Same columns.  Texts are what is compared, so rows that repeat an id (or
    have none) are documents of their own; of equal ids the text of the smaller
    hash comes first.  Repeats of a whole (id, text) go.  Texts without words
    link with nothing and stay.
    """
    counts = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("c"))
    if counts.where("c > 1 or id is null").isEmpty():
        groups = similar_groups(docs, id_col, text_col, shingle_words, num, den)
        return without(docs, staged(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id"))), id_col)
    t = F.xxhash64(text_col)
    pairs = docs.select(F.col(id_col).alias("id"), t.alias("t")).distinct()
    numbers = staged(pairs.repartitionByRange("id", "t").sortWithinPartitions("id", "t").withColumn("_number", F.monotonically_increasing_id()))
    same = F.col(id_col).eqNullSafe(F.col("numbers.id")) & (t == F.col("numbers.t"))
    numbered = staged(docs.alias("docs").join(numbers.alias("numbers"), same).select("docs.*", "_number").dropDuplicates(["_number"]))
    groups = similar_groups(numbered, "_number", text_col, shingle_words, num, den)
    return numbered.join(groups.where("_number <> component_id"), "_number", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 3),
t AS (
  SELECT r, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS t FROM x WINDOW p AS (PARTITION BY r ORDER BY i)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)
), d AS MATERIALIZED (SELECT r, list_sort(list(DISTINCT t)) AS s, md5(string_agg(DISTINCT t, chr(31) ORDER BY t)) AS h FROM t WHERE t IS NOT NULL GROUP BY r),
c AS MATERIALIZED (SELECT h, any_value(s) AS s, min(doc_id) AS rep FROM d JOIN w USING (r) GROUP BY h),
u AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS t FROM c),
f AS MATERIALIZED (SELECT t, count(*) AS df FROM u GROUP BY t),
o AS (SELECT u.rep, u.t, u.n, row_number() OVER (PARTITION BY u.rep ORDER BY f.df, u.t) AS p FROM u JOIN f USING (t)),
p AS MATERIALIZED (SELECT rep, t, n FROM o WHERE p <= n - CAST(ceil(n * 90 / 100.0) AS BIGINT) + 1),
q AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT q.a, q.b, count(*) AS m, any_value(x.n) AS na, any_value(y.n) AS nb FROM q JOIN u x ON x.rep = q.a JOIN u y ON y.rep = q.b AND y.t = x.t GROUP BY q.a, q.b)
  WHERE 100 * m >= 90 * (na + nb - m)
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
top AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(len(d.s), 0) AS BIGINT) AS n_shingles, coalesce(top.component, w.doc_id) AS component_id
FROM w LEFT JOIN d USING (r) LEFT JOIN c ON c.h = d.h LEFT JOIN top ON top.rep = c.rep
"""
