"""Operator 11 against a plain ranking, and its edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from waymark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names clash with the operator's own.
DOCS, ITEMS = "doc_id long, text string, term string, row int, n int, tf string", "item_id long, text string, item int, score int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS).repartition(3)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], ITEMS)


def plain(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made():
    r = random.Random(5)
    words = ["a", "B", "Ä", "ä", "it's", "x1", "漢字", "the", "The", "of,of", "é-É", "z_z"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs += [(7, "the B B"), (7, "the B B"), (7, "other"), (None, "B ä"), (None, None), (61, None), (62, ""), (63, "\x00 .. !"), (64, "漢字 " * 40_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 5)))) for i in range(20)]
    return docs, [*items, (3, "x1"), (None, "the a"), (30, None), (31, ""), (32, "unheard")]


@pytest.mark.parametrize("setting", [{}, {"SENT_TERMS": 0}, {"SENT_ROWS": 0}])
def test_ranking_against_plain_loops(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = made()
    got = [tuple(r) for r in lexical.search(docs_of(spark, docs), items_of(spark, items)).collect()]
    assert sorted(got, key=str) == plain(docs, items)


def test_ties_and_copies_each_have_a_rank(spark):
    docs = [(i % 4, "same words here") for i in range(24)] + [(9, "other text")] * 30
    got = lexical.search(docs_of(spark, docs), items_of(spark, [(1, "same Words")]), k=7).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1)]
    assert len({r.score for r in got}) == 1


def test_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "a b")]), items_of(spark, [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs_of(spark, [(1, None)]), items)):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_a_stored_index_gives_the_same_ranks(spark, tmp_path):
    docs, items = made()
    path = str(tmp_path / "index")
    lexical.write_index(docs_of(spark, docs), path)
    asked = lexical.item_terms(items_of(spark, items)).cache()
    found = lexical.read_index(spark, path, asked)
    got = [tuple(r) for r in lexical.rank(found, asked).collect()]
    assert sorted(got, key=str) == plain(docs, items)
    few = lexical.item_terms(items_of(spark, [(1, "the")]))
    assert len(lexical.read_index(spark, path, few).inputFiles()) > 0
    assert {r.term for r in lexical.read_index(spark, path, few).select("term").distinct().collect()} >= {"", "the"}
