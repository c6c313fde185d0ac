"""Operator 13: base spans against Python's patterns, revealing terms against plain counts, edge cases."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from waymark.llm import private_terms as pt

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names clash with the operator's own.
DOCS = "doc_id long, text string, h string, id int, emails string, row int, terms int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], DOCS).repartition(3)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def spans_of(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def odd_texts(n=400):
    r = random.Random(4)
    bits = ["a", "é", "😀", " ", ".", "@", "-", "+", "%", "_", "(", ")", "1", "25", "256", "000255", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "a@b.c", "x.y@z-1.co.uk", "@b.c", "10.0.0.1", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485", "+49 30 123456", "\n", "٣", "١٢"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = [*odd_texts(), "a" * 300_000, "1." * 60_000, "a@" + "b." * 60_000 + "c", "+1" + "." * 100_000, "1 " * 50_000, "a@b.c_d@e.f", "x@y.z@w.v", None, ""]
    got = {r.doc_id: r for r in pt.digests(pt.disclosures(docs_of(spark, enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = spans_of(text) if text is None or len(text) < 1000 else None
        if want is not None:
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert ",".join(x for x in got[i].spans.split(",") if x[:4] != "term") == listed, text
            assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
            assert [got[i][f"n_{k}"] for k in pt.KINDS] == [sum(s[0] == k for s in want) for k in pt.KINDS]
    long = len(odd_texts())
    assert [got[long + j].n_email for j in range(5)] == [0, 0, 1, 0, 0]
    assert got[long + 1].n_ip == 15_000 and got[long + 4].n_card == 0


def test_running_sums(spark):
    rows = [([random.Random(n).randint(0, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 128, 200, 5000)]
    df = spark.createDataFrame(rows, "a array<long>")
    for r in df.select("a", pt.running(F.col("a")).alias("s"), pt.running_max(F.col("a")).alias("m")).collect():
        total, most, sums, tops = 0, 0, [], []
        for x in r.a:
            total, most = total + x, max(most, x)
            sums.append(total)
            tops.append(most)
        assert r.s == sums and r.m == tops


def story(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"w{chr(97 + r.randint(0, 25))}" for _ in range(n))


def made():
    """Zorblax stands beside one address in many passages; other words stand beside it as they do elsewhere."""
    docs = [(i, story(i)) for i in range(200)]
    docs += [(300 + i, f"{story(500 + i)} Agent Zorblax {story(700 + i, 2)} of zb.{7}@mail.example.com {story(900 + i)}") for i in range(6)]
    docs += [(400 + i, f"{story(40)} copied Unicorn word me@copy.example.com {story(41)} {i}") for i in range(6)]  # one passage, copied
    docs += [(500, "Zorblax alone, without the address"), (501, "zorblax, wrote to ZB.7@mail.example.com and left ZORBLAX")]
    docs += [(502, docs[200][1]), (502, docs[200][1]), (None, docs[201][1])]
    return docs


def plain_pairs(docs, share, least):
    """Revealing (entity, form) pairs by plain loops over all texts."""
    texts = {t or "" for _, t in docs}
    near, passages, spread = defaultdict(set), defaultdict(set), defaultdict(set)
    held = defaultdict(set)
    forms = lambda terms: {f for t in terms for f in [t, *(t[:n] + "*" for n in pt.PREFIXES if len(t) > n)]}
    for text in texts:
        for f in forms(set(TERM.findall(text.translate(LOWER)))):
            spread[f].add(text)
        matches = list(re.finditer(PATTERNS["email"], text))
        for i, m in enumerate(matches):
            left = text[matches[i - 1].end() if i else 0 : m.start()]
            right = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
            if len(left) > pt.CONTEXT:
                left = re.sub("^" + TERM.pattern, "", left[-pt.CONTEXT :])
            if len(right) > pt.CONTEXT:
                right = re.sub(TERM.pattern + "$", "", right[: pt.CONTEXT])
            e = m.group().lower()
            held[e].add(text)
            for f in forms(set(TERM.findall(f"{left} {right}".translate(LOWER)))):
                near[e, f].add(text)
                passages[e, f].add((left, right))
    n = len(texts)
    told = lambda e, f: math.log2(n * len(near[e, f]) / (len(held[e]) * len(spread[f])))
    return {(f"email:{e}", f) for e, f in near if len(passages[e, f]) >= least and told(e, f) > 0 and told(e, f) >= share * math.log2(n / len(held[e])) - 1e-12}


def test_revealing_pairs_against_plain_counts(spark):
    docs = made()
    rows = docs_of(spark, docs).select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.coalesce("text", F.lit("")).alias("text")).cache()
    mentions = pt.mentions_of(pt.base_spans(rows)).cache()
    for share, least in ((pt.DISCLOSED, pt.LEAST_CONTEXTS), (0.5, 2), (0.3, 1)):
        got = pt.revealing(rows, rows.select("h").distinct().count(), mentions, pt.contexts(mentions), share, least).collect()
        got = {tuple(r) for r in got}
        want = plain_pairs(docs, share, least)
        if least == 1:  # pairs of one text are never looked at
            got, want = {p for p in got if p in want}, {p for p in want if p in got}
        assert got == want and ("email:zb.7@mail.example.com", "zorblax") in got


def test_revealing_terms_become_spans(spark):
    docs = made()
    got = {(r.doc_id, r.n_term): r for r in pt.digests(pt.disclosures(docs_of(spark, docs))).collect()}
    hit = lambda r, text: {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "term"}
    found = {i: hit(r, dict(docs)[i]) for (i, n), r in got.items() if n}
    assert all(found[300 + i] >= {"Zorblax"} for i in range(6)) and found[501] == {"zorblax", "ZORBLAX"}
    assert found[502] == found[300] and 500 not in found  # without the address nothing is given away
    assert not any(i is not None and i < 200 or i in range(400, 406) for i in found)  # clean texts, and copies of one passage
    assert all("w" != w[0] or len(w) > 2 for ws in found.values() for w in ws)


def test_texts_are_sanitised(spark):
    docs = [*made(), (600, None), (601, "call +1 (988) 555-2485 or 4111 1111 1111 1111, +10.20.30.40"), (602, "é😀 a@b.cc é" * 300)]
    df = docs_of(spark, docs)
    out = pt.sanitise(df)
    assert out.columns == df.columns and out.count() == len(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[600] is None and got[601] == "call [PHONE] or [CARD], [PHONE]" and got[602] == "é😀 [EMAIL] é" * 300
    assert "Zorblax" not in got[301] and "[EMAIL]" in got[301] and got[0] == docs[0][1]
    assert got[501] == "zorblax, wrote to [EMAIL] and left ZORBLAX".replace("zorblax", "").replace("ZORBLAX", "")
    # with many names that begin alike, a name is made general instead
    many = [(1000 + i, f"Zorbing{chr(97 + i)} {story(i)}") for i in range(20)]
    again = {r.doc_id: r.text for r in pt.sanitise(docs_of(spark, [*made(), *many])).collect()}
    assert " zor* " in again[301] and "zor*" not in got[301]


def test_empty_table_and_native_plan(spark):
    df = docs_of(spark, [(1, "a@b.c")])
    assert pt.disclosures(df.limit(0)).count() == 0 and pt.sanitise(df.limit(0)).count() == 0
    plan = pt.digests(pt.disclosures(df))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
