"""The pipeline stage by stage against plain loops, and the SQL twins of the operators."""

import glob
import os
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cell(v):
    return "null" if v is None or v != v else repr(round(float(v), 8)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert set(want.columns) <= set(columns)
    columns = sorted(want.columns)
    rows = lambda every, names: sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in every)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The small tables with rows planted: copies, near copies, benchmark passages, nulls, repeated ids, a long text."""
    folder = str(tmp_path_factory.mktemp("made"))
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    r = random.Random(1)
    prose = lambda seed, n: " ".join(f"word{random.Random(seed + i).randint(0, 900)}" for i in range(n))
    base = prose(10_000, 200)
    rows = [(100_000 + i, base, "en", "planted", 1) for i in range(3)]
    for i in range(4):
        words = base.split()
        words[r.randrange(200)] = f"changed{i}"
        rows.append((100_010 + i, " ".join(words), "en", "planted", 1))
    rows += [(100_020, f"{prose(20_000, 80)} {items[0]} {prose(21_000, 80)}", "en", "planted", 1), (100_021, items[1], "en", None, 1)]
    rows += [(100_030, None, "en", "s", None), (100_031, "", None, None, 0), (None, prose(30_000, 50), "en", "planted", 1), (None, prose(31_000, 50), "en", "planted", 1), (100_040, prose(32_000, 60), "en", "planted", 1), (100_040, prose(33_000, 60), "en", "planted", 1), (100_040, prose(33_000, 60), "en", "planted", 1)]
    rows += [(100_050, prose(40_000, 30_000), "en", "planted", 1)]
    spark.createDataFrame(docs + rows, SHAPE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, made, tmp_path_factory):
    """What goes into each stage, and the last one's result."""
    docs, out = spark.read.parquet(f"{made}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        out.append([tuple(r) for r in docs.collect()])
        stage(spark, docs, made).write.parquet(path)
        docs = spark.read.parquet(path)
        if len(out) < len(corpus_pipeline.STAGES):
            assert docs.columns == [x.split()[0] for x in SHAPE.split(", ")]
    return [*out, docs]


key = lambda rows: sorted(map(str, rows))


def test_toxic_documents_go(spark, made, stages):
    docs, labels = spark.read.parquet(f"{made}/documents.parquet"), spark.read.parquet(f"{made}/labels.parquet")
    said = toxicity.score(docs, toxicity.train(docs, labels), keep=tuple(docs.columns)).collect()
    assert key(stages[1]) == key(tuple(r.row) for r in said if r.predicted == 0)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    kept = {r[0] for r in stages[1]}
    assert sum(i in kept for i in toxic) <= 0.2 * len(toxic) and all(100_000 <= i <= 100_050 for i in {r[0] for r in stages[0] if r[0] and r[0] >= 100_000})
    assert {r[0] for r in stages[0] if r[0] is None or r[0] >= 100_000} == {i for i in kept if i is None or i >= 100_000}  # no planted one is toxic


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_document_of_each_group_stays(stages):
    rows = stages[1]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i in order:
        groups.setdefault(root(i), []).append(rows[i])
    first = [g[0][0] for g in groups.values()]  # the smallest id, null first
    assert sorted(first, key=str) == sorted((r[0] for r in stages[2]), key=str)
    assert {r[1] for r in stages[2]} <= {r[1] for r in rows}


def windows(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit = [False] * len(w)
    for k in {10, *(len(i) for i in items if len(i) < 10)}:
        mine = {tuple(i[a : a + k]) for i in items for a in range(len(i) - k + 1) if k == 10 or len(i) == k}
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in mine:
                hit[a : a + k] = [True] * k
    return hit


def test_benchmark_passages_are_cut_out(spark, made, stages):
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER)) for r in spark.read.parquet(f"{made}/benchmark.parquet").collect()]
    items = [i for i in items if i]
    hits = [(r, windows(r[1], items)) for r in stages[2]]
    assert any(any(h) for _, h in hits)
    gone = [r[0] for r, h in hits if 2 * sum(h) > len(h)]
    assert sorted((r[0] for r in stages[3]), key=str) == sorted((r[0] for r, h in hits if 2 * sum(h) <= len(h)), key=str) and 100_021 in gone
    clean = {(r[0], r[1]) for r, h in hits if not any(h)}
    assert clean <= {(r[0], r[1]) for r in stages[3]}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    cut = {r[0]: [w for w, x in zip(words(r[1]), h) if not x] for r, h in hits if any(h) and 2 * sum(h) <= len(h)}
    assert cut and all(words(r[1]) == cut[r[0]] for r in stages[3] if r[0] in cut)


def test_sources_come_near_their_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held, longest = {}, {}
    for r in stages[3]:
        held[r[3]] = held.get(r[3], 0) + size(r[1])
        longest[r[3]] = max(longest.get(r[3], 0), size(r[1]))
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(held.values()), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * held[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3 * held[s] for s in full}
        left -= sum(3 * held[s] for s in full)
        open_ -= full
    taken, copies = dict.fromkeys(names, 0), {}
    for r in stages[4]:
        taken[r[3]] += size(r[1])
        copies[str(r)] = copies.get(str(r), 0) + 1
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in names)
    times = {}
    for r in stages[3]:
        times[str(r)] = times.get(str(r), 0) + 1
    assert all(n <= 3 * times[k] for k, n in copies.items())


def test_records_hold_what_was_mixed(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in stages[4]:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = stages[5].orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_the_whole_run_and_empty_tables(spark, made, stages, tmp_path):
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, made).collect()}
    want = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect()}
    assert {r for r in got if r[0] not in (None, 100_040)} == {r for r in want if r[0] not in (None, 100_040)}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{made}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
