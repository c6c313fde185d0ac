"""Operator 4: near-duplicate embeddings by a robust-pruned flat graph.

Every vector goes to the ``overlap`` nearest of some centroids that a bounded
sample gave, so shards overlap; large shards are cut into blocks that meet
pairwise.  In a block each vector's near neighbours are robust-pruned to few
edges that point in different directions.  The adjacency lists that a vector has
in its shards, and the edges of both directions, are united into one flat graph.
Every vector is then searched in each of its shards over the united lists:
greedily from the shard's medoid (and from its own node), and from there on
through everything within range.  All cosines are computed in double precision
from the vectors themselves, so no link below the threshold is ever counted.

A pair that meets in several shards counts in the first one only, so counts
add up without a list of pairs, and only a star of each connected part leaves
a shard.  Equal vectors are one class from the start: the graph holds one of
them, and a link to it counts as often as the class has members.

At the end a sample of the vectors is compared with all rows by brute force; if
fewer than ``LEAST_RECALL`` of its links were found, among all or among the
vectors of any one magnitude of link counts, the index is built again
with twice the overlap, and if that does not help either, all pairs that can
link are compared: each vector meets, in the cell of its nearest centroid,
every vector that is near enough to that cell.  What was found is logged.

Vectors of different widths cannot link, so each width has its own graph; rare
widths are compared pair by pair.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .components import components

#: Vectors (and numbers) of the sample that gives the centroids.
SAMPLE, SAMPLE_NUMBERS = 65_536, 4_000_000
#: Vectors that a centroid should draw, and the most centroids.
SHARD, MOST_CENTROIDS = 1000, 8192
#: Vectors of a block; a task compares at most two blocks.
BLOCK = 1500
#: Widths of fewer vectors are compared pair by pair, unless they are the commonest.
FEW_OF_A_WIDTH = 1000
#: Edges of a node, neighbours they are chosen from, and the pruning slack.
DEGREE, CANDIDATES, ALPHA = 16, 64, 1.2
#: Greedy steps of a search, and searches that step together.
STEPS, QUERIES = 12, 256
#: Nodes a little out of range are still passed through.
PASS_THROUGH = 0.1
#: Vectors that are audited; if under ``FEW`` of them have 1 to 16 links, the larger number.
AUDITED, MORE_AUDITED, FEW, LEAST_RECALL = 256, 4096, 64, 0.9
#: Vectors of a cell, and of each side of a tile, where all pairs are compared.
EXACT_BLOCK = 10_000


log = logging.getLogger(__name__)


def prune(x: np.ndarray, node: int, near: np.ndarray, degree: int = DEGREE) -> list[int]:
    """Robust pruning: of ``near`` (closest first) those no kept one stands before."""
    kept: list[int] = []
    gap = 1 - x[near] @ x[node]
    alive = near != node
    while len(kept) < degree and alive.any():
        k = int(np.argmax(alive))
        kept.append(int(near[k]))
        alive &= ALPHA * (1 - x[near] @ x[near[k]]) > gap
        alive[k] = False
    return kept


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists, edges of both directions united."""
    n = len(x)
    edges: list[set[int]] = [set() for _ in range(n)]
    for a in range(0, n, 500):
        score = x[a : a + 500] @ x.T
        k = min(CANDIDATES, n)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        for i, row in enumerate(near):
            order = row[np.argsort(-score[i, row], kind="stable")]
            edges[a + i].update(prune(x, a + i, order))
    for i in range(n):
        for j in list(edges[i]):
            edges[j].add(i)
    # a node that many point to keeps the most diverse of its edges
    out = []
    for i, e in enumerate(edges):
        near = np.array(sorted(e), np.int64)
        if len(near) > 3 * DEGREE:
            near = np.array(prune(x, i, near[np.argsort(-(x[near] @ x[i]), kind="stable")], 3 * DEGREE), np.int64)
        out.append(near)
    return out


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Neighbour lists as a table (-1: none)."""
    table = np.full((len(lists), max(1, *map(len, lists))), -1, np.int64)
    for i, near in enumerate(lists):
        table[i, : len(near)] = near
    return table


def local_lists(ids: np.ndarray, near: list[np.ndarray], more: list[np.ndarray] | None) -> list[np.ndarray]:
    """Of lists of ids: the places, among ascending ``ids``, of those that are there; and ``more`` places."""
    out = []
    for i, own in enumerate(near):
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        own = at[ids[at] == own]
        out.append(np.unique(np.concatenate((own, more[i]))) if more else own)
    return out


def search(x: np.ndarray, edges: np.ndarray, medoid: int, queries: np.ndarray, least: float) -> np.ndarray:
    """Which nodes have a cosine of ``least`` or more with each query node.

    All queries take their steps together: greedy ones from the medoid and the
    query's own node, then the range grows from every near node on.  ``edges``
    is a padded table of neighbours (-1: none).
    """
    score = np.full((len(queries), len(x)), -2.0)
    opened = np.zeros(score.shape, bool)

    def visit(q: np.ndarray, v: np.ndarray) -> None:
        new = np.zeros(score.shape, bool)
        new[q, v] = True
        new &= score == -2
        q, v = np.nonzero(new)
        for a in range(0, len(q), 50_000):
            part = slice(a, a + 50_000)
            score[q[part], v[part]] = np.einsum("ij,ij->i", x[v[part]], x[queries[q[part]]])

    def open_up(q: np.ndarray, v: np.ndarray) -> None:
        opened[q, v] = True
        near = edges[v]
        there = near >= 0
        visit(np.repeat(q, there.sum(1)), near[there])

    every = np.arange(len(queries))
    visit(np.tile(every, 2), np.concatenate((np.full(len(queries), medoid), queries)))
    for _ in range(STEPS):
        best = np.argmax(np.where(opened, -3.0, score), axis=1)
        able = score[every, best] > -2
        able &= ~opened[every, best]
        if not able.any():
            break
        open_up(every[able], best[able])
    while True:
        front = (score >= least - PASS_THROUGH) & ~opened
        if not front.any():
            return score >= least
        open_up(*np.nonzero(front))


def compare(x: np.ndarray, ids: np.ndarray, weights: np.ndarray, block: np.ndarray, shards: np.ndarray, near: list[np.ndarray], shard: int, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per vector that this shard counts, and (id, least connected id).

    ``near`` are the united lists of the graph (ids); two blocks that meet add
    their own edges.  A link counts as often as ``weights`` says of the vector
    at its other end.
    """
    n = len(x)
    edges = padded(local_lists(ids, near, build(x) if block.min() != block.max() else None))
    medoid = int(np.argmax(x @ x.sum(0)))
    count = np.zeros(n, np.int64)
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    linked = np.concatenate([search(x, edges, medoid, np.arange(a, min(a + QUERIES, n)), least) for a in range(0, n, QUERIES)])
    linked |= linked.T  # found from either end
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    for i in np.flatnonzero(linked.any(1)).tolist():
        hits = np.flatnonzero(linked[i])
        same = (shards[hits][:, :, None] == shards[i][None, None, :]).any(2)
        count[i] = weights[hits][np.where(same, shards[hits], np.iinfo(np.int64).max).min(1) == shard].sum()
        for j in hits[hits > i].tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    tops = [root(i) for i in range(n)]
    return count, [(int(ids[i]), int(ids[t])) for i, t in enumerate(tops) if t != i]


def compare_all(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """As ``compare``, for every pair of a vector of ``x`` and one of ``y``."""
    nodes, place = np.unique(np.concatenate((ids, others)), return_inverse=True)
    left, right = place[: len(ids)], place[len(ids) :]
    top = np.arange(len(nodes))
    count = np.zeros(len(ids), np.int64)
    for a in range(0, len(x), 500):
        hit = x[a : a + 500] @ y.T >= least
        hit &= left[a : a + 500, None] != right[None]
        for i in np.flatnonzero(hit.any(1)).tolist():
            hits = np.flatnonzero(hit[i])
            count[a + i] = weights[hits].sum()
            parts = np.unique(np.append(top[right[hits]], top[left[a + i]]))
            if len(parts) > 1:
                top[np.isin(top, parts)] = parts[0]
    return count, [(int(nodes[i]), int(nodes[t])) for i, t in enumerate(top.tolist()) if t != i]


def centroids_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors, started at evenly spaced ones."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(8):
        near = np.concatenate([np.argmax(sample[a : a + 2000] @ centres.T, axis=1) for a in range(0, len(sample), 2000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors that can link, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def unit(column) -> np.ndarray:
    """A matrix of unit vectors from an Arrow list column of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small numbers
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _counted(rows: DataFrame, centres: np.ndarray, overlap: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and edges ``a, b`` found with each vector in ``overlap`` shards."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    overlap = min(overlap, len(centres))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.sort(np.argpartition(-(unit(batch.column(1)) @ sent.value.T), overlap - 1, axis=1)[:, :overlap], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, overlap), pa.int32()), pa.array(near.ravel().astype(np.int64)))], ["id", "v", "w", "shards"])

    placed = staged(rows.mapInArrow(assign, "id long, v array<double>, w long, shards array<long>"))
    spread = placed.withColumn("shard", F.explode("shards"))
    sizes = spread.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    cut = spread.join(F.broadcast(sizes), "shard")  # a row a centroid
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    blocks = cut.withColumn("block", own)
    # a vector has a list in each of its shards; they are united
    graph = staged(_adjacent(blocks).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    tiles = blocks.join(graph, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v", "w", "shards", "near")
    dealt = tiles.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "id")

    def run(batches):
        for t in _tiles(batches):
            shard = t.column("shard")[0].as_py()
            ids = t.column("id").to_numpy()
            shards = t.column("shards").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            yield _links(ids, *compare(unit(t.column("v").combine_chunks()), ids, t.column("w").to_numpy(), t.column("block").to_numpy(), shards, _lists(t.column("near")), shard, least))

    return _summed(dealt.mapInArrow(run, "a long, n long, b long"), placed)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks()
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy())[:-1]
    return np.split(column.flatten().to_numpy(), ends)


def _adjacent(blocks: DataFrame) -> DataFrame:
    """``id, near``: the pruned neighbours of each vector in each of its blocks."""
    dealt = blocks.select("shard", "block", F.lit(0).alias("j"), "id", "v").repartition("shard", "block").sortWithinPartitions("shard", "block", "id")

    def run(batches):
        for t in _tiles(batches):
            ids, lists = t.column("id").to_numpy(), build(unit(t.column("v").combine_chunks()))
            ends = np.cumsum([0, *map(len, lists)])
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[np.concatenate(lists)]))], ["id", "near"])

    return dealt.mapInArrow(run, "id long, near array<long>")


def _tiles(batches):
    """Tables of the rows that agree in the first three columns; rows are sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]) if batch.num_rows else np.zeros((3, 0))
        bounds = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows]):
            if a == b:
                continue
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held.clear()
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _links(ids: np.ndarray, count: np.ndarray, stars: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(int(i), int(c), None) for i, c in zip(ids, count) if c] + [(a, 0, b) for a, b in stars]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "n", "b"])


def _summed(links: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and edges ``a, b``; ``placed`` is not read after that."""
    found = staged(links)
    discard(placed)
    return found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("b is not null").select("a", "b")


def _all_pairs(rows: DataFrame, centres: np.ndarray, least: float) -> tuple[DataFrame, DataFrame]:
    """As ``_counted``, but no pair is lost.

    A vector's links are counted in the cell of its nearest centroid, c.  A
    vector v nearest to another one, b, can only link into that cell if it is
    within a link's angle of the plane between them, that is if v (b - c) is at
    most sin(angle) |b - c|.  All that are go there as well.
    """
    reach = (1 - least**2) ** 0.5 if least > 0 else 1.0
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    sent = rows.sparkSession.sparkContext.broadcast((centres, reach * apart + 1e-7))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = unit(batch.column(1)) @ sent.value[0].T
            home = np.argmax(score, axis=1)
            near = score.max(1)[:, None] - score <= sent.value[1][home]
            ends = np.concatenate(([0], np.cumsum(near.sum(1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(near)[1].astype(np.int64)))], ["id", "v", "w", "home", "shards"])

    placed = staged(rows.mapInArrow(assign, "id long, v array<double>, w long, home long, shards array<long>"))
    cells = placed.select(F.col("home").alias("shard"), "id", "v", "w")
    spread = placed.select(F.explode("shards").alias("shard"), "id", "v", "w")
    blocks = lambda df, name: df.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(EXACT_BLOCK)).cast("int").alias(name))
    sizes = F.broadcast(blocks(cells, "rows").join(blocks(spread, "others"), "shard"))  # a row a centroid
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cells.join(sizes, "shard").select("shard", own("rows").alias("i"), every("others").alias("j"), F.lit(0).alias("side"), "id", "v", "w")
    right = spread.join(sizes, "shard").select("shard", every("rows").alias("i"), own("others").alias("j"), F.lit(1).alias("side"), "id", "v", "w")
    dealt = left.union(right).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "side", "id")

    def run(batches):
        for t in _tiles(batches):
            n = int(np.count_nonzero(t.column("side").to_numpy() == 0))
            if 0 < n < t.num_rows:
                ids, w, x = t.column("id").to_numpy(), t.column("w").to_numpy(), unit(t.column("v").combine_chunks())
                yield _links(ids[:n], *compare_all(x[:n], ids[:n], x[n:], ids[n:], w[n:], least))

    return _summed(dealt.mapInArrow(run, "a long, n long, b long"), placed)


def audit(rows: DataFrame, counts: DataFrame, least: float) -> float | None:
    """Least recall of the links of drawn vectors: of all, and by how many they have.

    ``None`` if no drawn vector has a link: then recall is not measured.
    Vectors of few links have a recall of their own, whatever a large group
    adds to the sum; more are drawn if there are hardly any in the first draw.
    """
    for queries in (AUDITED, MORE_AUDITED):
        found = _audited(rows, counts, least, queries)
        if sum(1 for true, _ in found if true <= 16) >= FEW:
            break
    sums: dict[int, list[int]] = {}
    for true, n in found:
        for key in (0, true.bit_length()):
            s = sums.setdefault(key, [0, 0])
            s[0] += true
            s[1] += n
    return min((n / true for true, n in sums.values()), default=None)


def _audited(rows: DataFrame, counts: DataFrame, least: float, queries: int) -> list[tuple[int, int]]:
    """(true, found) links of those of some vectors, drawn by hash, that have any.

    The vectors are compared with all rows, a batch at a time.
    """
    drawn = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(queries).toArrow()
    if not drawn.num_rows:
        return []
    ids, q = drawn.column("id").to_numpy(), unit(drawn.column("v").combine_chunks())
    sent = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        total = np.zeros(len(sent.value[0]), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own, w = unit(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float)
                for a in range(0, len(total), AUDITED):
                    part = slice(a, a + AUDITED)
                    hit = sent.value[1][part] @ x.T >= least
                    hit &= sent.value[0][part, None] != own[None]
                    total[part] += (hit @ w).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[0]), pa.array(total)], ["id", "true"])

    true = rows.mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    both = true.where(F.col("true") > 0).join(counts, "id", "left").select("true", F.coalesce("n", F.lit(0)).alias("n"))
    return [(r["true"], r["n"]) for r in both.collect()]  # at most a row a drawn vector


def _of_few(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and edges ``a, b`` of vectors of rare widths, compared pair by pair."""
    dealt = rows.select(F.size("v").alias("width"), F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "v", "w").repartition("width").sortWithinPartitions("width", "id")

    def run(batches):
        for t in _tiles(batches):
            ids, w, x = t.column("id").to_numpy(), t.column("w").to_numpy(), unit(t.column("v").combine_chunks())
            yield _links(ids, *compare_all(x, ids, x, ids, w, least))

    found = staged(dealt.mapInArrow(run, "a long, n long, b long"))
    return found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("b is not null").select("a", "b")


def _of_width(classes: DataFrame, width: int, n: int, least: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and edges ``a, b`` of the ``n`` vectors of one width."""
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(1, SAMPLE_NUMBERS // width))).select("v").toArrow()
    sample = unit(drawn.column("v").combine_chunks())
    centres = centroids_of(sample, max(1, min(MOST_CENTROIDS, -(-n // SHARD), len(sample) // 4)))
    for shards in (overlap, 2 * overlap) if overlap < len(centres) else (overlap,):
        counts, edges = _counted(classes, centres, shards, least)
        recall = audit(classes, counts, least)
        shown = "unmeasured, no drawn vector has a link" if recall is None else f"{recall:.4f}"
        log.info("width %d: recall %s with %d of %d shards a vector", width, shown, min(shards, len(centres)), len(centres))
        if recall is None or recall >= LEAST_RECALL:
            return counts, edges
    log.warning("width %d: all pairs that can link are compared", width)
    return _all_pairs(classes, centroids_of(sample, max(1, min(MOST_CENTROIDS, -(-n // EXACT_BLOCK), len(sample)))), least)


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, overlap: int = 3) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links, component_id, kept``.

    Vectors that are null, zero or hold null or non-finite numbers link with
    nothing; vectors of different widths do not link; rows that share an id
    count as one vector (the smallest by value) and all come back; a null id
    links with nothing and has a null component; an empty table gives an empty
    result; other columns are not read.
    """
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"))
    rows = staged(usable(vectors, id_col, vector_col))
    classes = staged(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "v", "w"))
    widths = classes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width"))
    large = widths.where(F.col("n") > FEW_OF_A_WIDTH).collect() or widths.limit(1).collect()  # at most a row for that many vectors
    if not large:
        return all_rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = [_of_width(classes.where(F.size("v") == x["width"]), x["width"], x["n"], least, overlap) for x in large]
    rest = classes.where(~F.size("v").isin([x["width"] for x in large]))
    if not rest.isEmpty():
        found.append(_of_few(rest, least))
    counts, edges = found[0]
    for c, e in found[1:]:
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    tops = components(edges).withColumnRenamed("node", "id")
    links = (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")
    by_class = classes.select("id", "w").join(counts, "id", "left").join(tops, "id", "left").select(F.col("id").alias("first"), links, "component")
    out = all_rows
    several = classes.where("w > 1").select(F.col("id").alias("first"), "v")
    if not several.isEmpty():
        out = out.join(rows.join(several, "v").select("id", "first"), "id", "left").withColumn("first", F.coalesce("first", "id"))
    else:
        out = out.withColumn("first", F.col("id"))
    out = out.join(by_class, "first", "left")
    component = F.coalesce("component", "first")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
