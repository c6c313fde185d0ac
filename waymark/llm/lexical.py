"""Operator 11: ranked lexical search over a table of postings.

Every document becomes postings ``(bucket, term, row, tf, n)``: a term it
holds, how often, and how many terms the document has.  ``bucket`` is a hash
of the term; a stored index is laid out by it, so a search reads the buckets of
its terms only.  A posting with the empty term stands for the document itself.

A search joins the terms of its items with the postings, scores every match in
64-bit integers, sums by item and document, and ranks with ``row_number``.
Postings are dealt by document before the join, so that the sums need no
shuffle of (item, document) pairs: what is shuffled is one row per document and
asked term, and the first ``k`` rows of each task and item.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, sifted, small_batches, staged
from .decontaminate import words_of

BUCKETS = 64
#: Postings of an index file, roughly: rows are dealt in blocks of so many documents.
BLOCK_ROWS = 1 << 20
GROUP_BYTES = 2_000_000
#: Asked terms up to so many are sent to the tasks that read texts; with more, a filter of fixed size sifts postings.
SENT_TERMS = 200_000
#: Rows (item, term) up to so many are broadcast to the postings; more are joined by shuffling.
SENT_ROWS = 500_000

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHAPE = "row long, id {id}, term string, tf long, n long"


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: frozenset[bytes] | None = None) -> DataFrame:
    """``row, id, term, tf, n``: one row per document and distinct term, in document order.

    Documents with terms have one more, of the empty term, whose ``tf`` is
    ``n``, the number of all terms with repeats; others have none.  ``row``
    tells rows of ``docs`` apart that share an id or are equal; it holds for
    one evaluation, so the frame is to be written before it is used twice.
    With ``terms`` only those have postings; ``n`` counts all.  Null and empty
    texts have no terms; an empty table has no postings; other columns are not
    read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                owners, names, counts, sizes = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    words = words_of(text) if text else ()
                    if not words:
                        continue
                    held = Counter(words if sent is None else filter(sent.value.__contains__, words))
                    names += [b"", *held]
                    counts += [len(words), *held.values()]
                    owners.append(np.full(len(held) + 1, i))
                    sizes.append(np.full(len(held) + 1, len(words)))
                if owners:
                    at = pa.array(np.concatenate(owners))
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(np.concatenate(sizes), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "term", "tf", "n"])

    return rows.mapInArrow(run, SHAPE.format(id=rows.schema["id"].dataType.simpleString()))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All postings of ``docs`` as Parquet, a folder a bucket of terms.

    Buckets are dealt in blocks of documents, so a very frequent term is
    written by as many tasks as there are blocks.
    """
    found = postings(docs, id_col, text_col).withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(bucket_of("term")))
    # the high bits of ``row`` number the task that read it
    block = F.xxhash64(F.shiftright("row", 33), F.floor(F.col("row") / BLOCK_ROWS))
    found.repartition("bucket", block).write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Postings of a written index whose terms ``asked(item, term)`` may hold, and one row a document.

    At most ``BUCKETS`` folders are named, so the list of those to read is
    small; folders of other terms are not opened.  An index of no documents has
    no folders and is an error of the reader.
    """
    wanted = [r[0] for r in asked.select(bucket_of("term").alias("bucket")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin([-1, *wanted])).drop("bucket")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term``: the distinct terms of each item; items without any have no row."""
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(id_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERMS), F.lit(0)))).alias("term")).distinct()


def match_score(weight: str, tf: str, n: str, docs: int, words: int) -> Column:
    """Integer score of a term in a document: ``w * (1e9 tf div (1000 tf + 8 m))``."""
    m = f"(10L + (90L * {n} * {docs}L) div {words}L)"
    return F.expr(f"{weight} * ((1000000000L * {tf}) div (1000L * {tf} + 8L * {m}))")


def rank(found: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """``item, rank, id, score`` of the ``k`` best documents of each item.

    ``found`` are written postings that hold at least those of the asked terms
    and the empty ones; ``asked(item, term)`` is a written table too.  Equal
    scores by ascending id, null last; rows of equal id and score each have a
    rank.  Terms that all documents hold weigh nothing.
    """
    whole = found.where("term = ''").agg(F.count("*").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).first()
    own = found.where("term <> ''")
    held = own.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi") if asked.count() <= SENT_ROWS else own
    weight = F.floor(1000 * F.log((F.lit(2 * whole.docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    weighed = asked.join(held.groupBy("term").agg(F.count("*").alias("df")), "term").select("item", "term", weight.cast("long").alias("w")).where("w > 0")
    weighed = staged(weighed)
    if weighed.count() <= SENT_ROWS:
        matches = own.repartition("row").join(F.broadcast(weighed), "term")
    else:
        matches = own.join(weighed, "term")
    scored = matches.select("item", "row", "id", match_score("w", "tf", "n", whole.docs, max(1, whole.words)).alias("s"))
    sums = scored.groupBy("item", "row").agg(F.sum("s").alias("score"), F.any_value("id").alias("id")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item id, ``rank``, document id, ``score``.

    One row per item and document with a score above 0.  Rows of ``items`` that
    share an id are one item with the terms of all its rows; a null item id is
    an item of its own.  Null and empty texts match nothing; repeated documents
    each have a rank; either table may be empty.  Texts are read whole, of any
    length; other columns are not read.
    """
    asked = staged(item_terms(items, item_col, text_col))
    terms = asked.select("term").distinct()
    few = terms.count() <= SENT_TERMS
    sent = frozenset(r[0].encode() for r in terms.collect()) if few else None
    found = postings(docs, id_col, text_col, sent)
    if not few:
        found = sifted(found, terms.union(asked.sparkSession.sql("SELECT ''")).select(F.col("term").alias("id")), "term")
    best = rank(staged(found), asked, k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), x AS MATERIALIZED (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM x GROUP BY r, doc_id, n, term),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
g AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM p JOIN w USING (term), s GROUP BY item_id, r, doc_id
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
