"""Operator 12: how far the sources of a language lie apart, by shards in DuckDB.

Texts become counts: every task hands its texts to DuckDB in blocks, which
counts the terms by language and source in SQL; Spark adds the counts up.  The
counts are dealt to shards by a hash of language and term, so a shard holds all
counts of its terms.  A shard's SQL finds the terms that are kept, and later
the shard's share of what every pair of sources adds up to and the best terms
of every source; Spark merges the sums and ranks them.

With ``p`` and ``q`` a term's shares in two sources, the value of a pair is the
sum of ``f(p, q) = (p - q) ** 2 div q`` over all kept terms.  Most terms do not
occur in most sources, where ``p`` is a constant ``p0`` of the source; so

    sum f(p, q) = sum over terms in the first source   f(p, q0)
                + sum over terms in the second source  f(p0, q)
                + (terms - those in the first - those in the second) f(p0, q0)
                + sum over terms in both   f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

and only the last line needs a term's counts in two sources at once.  The
others need how many terms have which count, which is a small table.  All of it
is in whole numbers of 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, small_batches, staged

LEAST_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Text that is counted by one statement, and counts that a task holds before it hands them on.
GROUP_BYTES, HELD_ROWS = 4_000_000, 400_000
#: Rows of a shard, but for those of its last term.
SHARD_ROWS = 500_000
#: Memory of one statement in DuckDB.
MEMORY = "512MB"
TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WIDE = "decimal(38,0)"
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def connection() -> duckdb.DuckDBPyConnection:
    """A database in memory for one task: one thread, no files, no progress bar."""
    c = duckdb.connect(":memory:", config={"threads": 1})
    c.execute(f"SET memory_limit = '{MEMORY}'")
    c.execute("SET temp_directory = ''")
    c.execute("SET enable_progress_bar = false")
    c.execute("SET preserve_insertion_order = false")
    return c


def query(c: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema, **tables) -> list[pa.RecordBatch]:
    """Rows of a statement over Arrow tables, as batches of ``schema``."""
    for name, data in tables.items():
        c.register(name, data)
    found = c.sql(sql).to_arrow_table().cast(schema).to_batches()
    for name in tables:
        c.unregister(name)
    return found


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNT_SQL = f"""
WITH w AS (
  SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM texts
), d AS (SELECT lang, source, term, r, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM d GROUP BY lang, source, term
"""
#: The pieces of one text.
PIECES_SQL = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(1 AS BIGINT) AS docs FROM counts GROUP BY lang, source, term"
MERGE_SQL = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY lang, source, term"


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about ``GROUP_BYTES``, cut between terms."""
    at = 0
    while at < len(text):
        gap = BETWEEN.search(text, at + GROUP_BYTES) if at + GROUP_BYTES < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def counted(c: duckdb.DuckDBPyConnection, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Counts of the texts of a batch ``lang, source, text``."""
    numbered = lambda part: pa.Table.from_batches([part]).append_column("r", pa.array(range(part.num_rows), pa.int64()))
    if batch.num_rows > 1 or batch.column(2).nbytes <= 2 * GROUP_BYTES:
        return query(c, COUNT_SQL, COUNTED, texts=numbered(batch))
    held: list[pa.RecordBatch] = []
    for piece in pieces(batch.column(2)[0].as_py().encode()):
        part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([piece.decode()])], batch.schema.names)
        held += query(c, COUNT_SQL, COUNTED, texts=numbered(part))
        held = query(c, PIECES_SQL, COUNTED, counts=pa.Table.from_batches(held, COUNTED))
    return held


def counts(rows: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: partial counts of rows ``lang, source, text``.

    A key has a row for each ``HELD_ROWS`` counts of a task at most.
    """

    def run(batches):
        c = connection()
        held: list[pa.RecordBatch] = []
        try:
            for whole in batches:
                for batch in byte_slices(whole, "text", GROUP_BYTES):
                    held += counted(c, batch)
                    if sum(b.num_rows for b in held) >= HELD_ROWS:
                        held = query(c, MERGE_SQL, COUNTED, counts=pa.Table.from_batches(held, COUNTED))
                        if sum(b.num_rows for b in held) >= HELD_ROWS // 2:
                            yield from held
                            held = []
            if held:
                yield from query(c, MERGE_SQL, COUNTED, counts=pa.Table.from_batches(held, COUNTED))
        finally:
            c.close()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shards(rows: DataFrame, sql: str, schema: pa.Schema) -> DataFrame:
    """What ``sql`` gives for each shard of ``rows``, which is its table ``shard``.

    Rows are dealt by a hash of language and term; a term's rows, one for each
    source, lie in one shard, and a task cuts its rows into shards of about
    ``SHARD_ROWS``, one after the other.
    """
    dealt = rows.repartition("lang", "term").sortWithinPartitions("lang", "term")
    at = [dealt.columns.index(c) for c in ("lang", "term")]

    def run(batches):
        c = connection()
        held: list[pa.RecordBatch] = []
        try:
            for batch in batches:
                if sum(b.num_rows for b in held) >= SHARD_ROWS:
                    last = [held[-1].column(i)[-1] for i in at]
                    new = next((k for k in range(batch.num_rows) if [batch.column(i)[k] for i in at] != last), None)
                    if new is not None:
                        yield from query(c, sql, schema, shard=pa.Table.from_batches([*held, batch.slice(0, new)]))
                        held, batch = [], batch.slice(new)
                if batch.num_rows:
                    held.append(batch)
            if held:
                yield from query(c, sql, schema, shard=pa.Table.from_batches(held))
        finally:
            c.close()

    kinds = {pa.string(): "string", pa.int64(): "long", pa.decimal128(38, 0): WIDE}
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
KEPT_SQL = f"""
SELECT lang, source, term, n FROM shard
WHERE (lang, term) IN (SELECT (lang, term) FROM shard GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS})
"""

_F = "((({p}) - ({q})) * (({p}) - ({q}))) // ({q})"
PAIRS = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("p", pa.decimal128(38, 0)), ("k", pa.int64()), ("value", pa.decimal128(38, 0))])
#: Three kinds of rows: what a pair adds for terms in both; how many terms have a share in a source; a source's best terms.
PAIRS_SQL = f"""
WITH x AS MATERIALIZED (SELECT lang, source, term, n, CAST(p AS HUGEINT) AS p, CAST(p0 AS HUGEINT) AS p0, CAST(total AS HUGEINT) AS total, terms FROM shard),
l AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n)::HUGEINT + 1)) // (any_value(total) + any_value(terms)) AS q FROM x GROUP BY lang, term),
t AS (SELECT lang, source, term, {_F.format(p="p", q="q")} AS value FROM x JOIN l USING (lang, term) WHERE p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS k FROM t)
SELECT 'pair' AS kind, a.lang, a.source, b.source AS other, 0::DECIMAL(38, 0) AS p, 0::BIGINT AS k,
  CAST(sum({_F.format(p="a.p", q="b.p")} - {_F.format(p="a.p", q="b.p0")} - {_F.format(p="a.p0", q="b.p")} + {_F.format(p="a.p0", q="b.p0")}) AS DECIMAL(38, 0)) AS value
FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
UNION ALL SELECT 'share', lang, source, '', CAST(p AS DECIMAL(38, 0)), count(*), 0 FROM x GROUP BY lang, source, p
UNION ALL SELECT 'term', lang, source, term, 0, 0, CAST(value AS DECIMAL(38, 0)) FROM r WHERE k <= {TOP_TERMS}
"""


def share(n: Column | str, total: str, terms: str) -> Column:
    """``1 + 1e9 (n + 1) div (total + terms)`` in whole numbers; null if a language keeps no terms."""
    return F.expr(f"CAST(1 + (CAST({UNIT} AS {WIDE}) * ({n} + 1)) div NULLIF({total} + {terms}, 0) AS {WIDE})")


def distance(p: str, q: str) -> Column:
    """``(p - q) ** 2 div q``; shares stay under 19 digits, so that squares fit."""
    p, q = f"CAST({p} AS decimal(19,0))", f"CAST({q} AS decimal(19,0))"
    return F.expr(f"CAST((({p} - {q}) * ({p} - {q})) div {q} AS {WIDE})")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Part ``pair``: the other sources of the language, part ``term``: the terms
    that are more frequent in the source than in the language, the first
    ``TOP_TERMS``.  Null texts, languages and sources count as empty ones;
    documents without terms still make their source appear; where a language
    keeps no terms, its pairs have value 0; repeated rows are counted each;
    equal values are ranked by item; an empty table gives an empty result.
    Texts are read whole, of any length; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), text.alias("text"))
    summed = counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = staged(shards(summed, KEPT_SQL, KEPT))
    # every source of every language, with its words, and each language's
    groups = rows.select("lang", "source").distinct()
    by_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("total"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    totals = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *(zero(c) for c in ("words", "held", "terms", "total")))
    totals = staged(totals.withColumn("p0", share("0", "words", "terms")))
    shares = kept.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "words", "terms").alias("p"), "p0", "total", "terms")
    parts = staged(shards(shares, PAIRS_SQL, PAIRS))

    both = totals.alias("a").join(totals.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    both = both.select("a.lang", "a.source", F.col("b.source").alias("other"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("q0"), (F.col("a.terms") - F.col("a.held") - F.col("b.held")).alias("rest"))
    both = staged(both)
    # how many terms have which share in one source, against the zero share of the other
    levels = parts.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("k").alias("k"))
    first = both.join(levels, ["lang", "source"]).select("lang", "source", "other", (F.col("k") * distance("p", "q0")).cast(WIDE).alias("value"))
    second = both.join(levels.select("lang", F.col("source").alias("other"), F.col("p").alias("q"), "k"), ["lang", "other"])
    second = second.select("lang", "source", "other", (F.col("k") * distance("p0", "q")).cast(WIDE).alias("value"))
    neither = both.select("lang", "source", "other", F.coalesce(F.col("rest") * distance("p0", "q0"), F.lit(0)).cast(WIDE).alias("value"))
    in_both = parts.where("kind = 'pair'").select("lang", "source", "other", "value")
    pairs = neither.unionAll(first).unionAll(second).unionAll(in_both).groupBy("lang", "source", "other").agg(F.sum("value").cast("long").alias("value"))

    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part, item: rows.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), F.col("value").cast("long").alias("value")).withColumn("rank", order)
    # apart, so that every task hands on a source's first terms only
    terms = ranked(parts.where("kind = 'term'"), "term", "other").where(F.col("rank") <= TOP_TERMS)
    return ranked(pairs, "pair", "other").unionAll(terms)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), x AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY lang, source, term),
cells AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p FROM cells JOIN t USING (lang, source) JOIN v USING (lang)),
lt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term),
q AS MATERIALIZED (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM lt JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200
"""
