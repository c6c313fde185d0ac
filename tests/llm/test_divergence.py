"""Operator 12 against plain loops, and its edge cases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from waymark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names clash with the operator's own.
DOCS = "doc_id long, text string, lang string, source string, term string, n int, p double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *row, "x", 1, 2.0) for i, row in enumerate(rows)], DOCS).repartition(3)


def plain(rows):
    held = defaultdict(lambda: defaultdict(Counter))
    seen = defaultdict(Counter)
    for text, lang, source in rows:
        words = Counter(TERM.findall((text or "").translate(LOWER)))
        held[lang or ""][source or ""].update(words)
        seen[lang or ""].update(words.keys())
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in held.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        for s, c in sources.items():
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:200])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed=2, n=150):
    r = random.Random(seed)
    words = ["a", "A", "Ä", "ä", "漢", "l'été", "x1y", "rare", *(f"w{chr(97 + i)}" for i in range(25))]
    rows = [(" ".join(r.choice(words[: 5 + 3 * (i % 8)]) for _ in range(r.randint(0, 20))), r.choice(["en", "de", "", None]), r.choice(["s1", "s2", "s3", "S1", "é", "", None])) for i in range(n)]
    return rows + [(None, "en", "bare"), ("", "xx", "one"), ("123 .", "xx", "two"), ("only here", "yy", "alone")] + [("same text again", "en", "s1")] * 5


@pytest.mark.parametrize("setting", [{}, {"SHARD_ROWS": 1}, {"HELD_ROWS": 2, "GROUP_BYTES": 10}])
def test_values_against_plain_loops(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(divergence, name, value)
    rows = made()
    df = divergence.divergence(docs_of(spark, rows))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in df.collect()) == plain(rows)


def test_only_so_many_terms_are_ranked(spark):
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04}")
    rows = [(" ".join(name(i) for i in range(300)), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    got = divergence.divergence(docs_of(spark, rows)).where("source = 'a' and part = 'term'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201)) and [r.item for r in got] == [name(i) for i in range(200)]


def test_languages_without_terms_and_empty_tables(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, None, None)]
    assert sorted(tuple(r) for r in divergence.divergence(docs_of(spark, rows)).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert divergence.divergence(docs_of(spark, rows).limit(0)).count() == 0


def test_a_long_text_is_one_document(monkeypatch):
    monkeypatch.setattr(divergence, "GROUP_BYTES", 1000)
    text = "Straße äöü word " * 2000 + "z" * 5000
    assert b"".join(divergence.pieces(text.encode())) == text.encode() and max(map(len, divergence.pieces(text.encode()))) < 7000
    batch = pa.RecordBatch.from_arrays([pa.array(["de"]), pa.array(["s"]), pa.array([text])], ["lang", "source", "text"])
    c = divergence.connection()
    got = sorted((r["term"], r["n"], r["docs"]) for b in divergence.counted(c, batch) for r in b.to_pylist())
    assert got == sorted([("straße", 2000, 1), ("äöü", 2000, 1), ("word", 2000, 1), ("z" * 5000, 1, 1)])
