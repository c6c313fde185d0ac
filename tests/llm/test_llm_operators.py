"""Training-data operators: brute force on small fixtures, and edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat_format, decontaminate, html_extract, mixing, ngram_join, suffix_dedup, toxicity, vector_graph
from waymark.llm.components import components
from waymark.llm.records import Encoder, read_index, read_records, write_records
from waymark.llm.token_counts import Counter, token_counts

DOCS = "doc_id long, text string, id string, row int"
#: Pieces that are hard to cut or fold.
ODD = ["a", "b ", " ", "\n", "\t", "  ", "\xa0", "\x1c", "\x85", "'s", "it's", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "ß", "12", "!!", "%", "\r\n", "漢", "İ", "\x0b", "Don't", "́", "ᄀ", "ᅡ", ","]


def odd_texts(n=1500):
    r = random.Random(1)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)], DOCS)


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


# 1
def test_counts_equal_the_library():
    c = Counter.of(P.path("byte_bpe_50k.json"))
    texts = odd_texts()
    assert c.counts(texts) == [len(e) for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_edge_cases(spark):
    df = docs_of(spark, [None, "", "two words", "two words", "x " * 60_000], [1, 2, 3, 3, None])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, P.path("byte_bpe_50k.json")).collect())
    assert got[:4] == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 9, 2, False), ("3", 9, 2, False)]
    assert got[4][1:] == (120_000, 60_001, True)
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# 2
def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "x|<|end|>\\p\\"), (1, 0, "user", "</s>[INST]"), (1, 2, "assistant", None), (1, 2, "assistant", "more"), (2, None, None, "alone"), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat_format.format_chats(df).withColumn("read", chat_format.read_turns(F.col("formatted")))
    got = {r.conv_id: [tuple(t) for t in r.read] for r in out.collect()}
    assert got == {1: [("user", "</s>[INST]"), ("assistant", "x|<|end|>\\p\\"), ("assistant", ""), ("assistant", "more")], 2: [("", "alone")], None: [("user", "")]}
    d = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert d[1].loss_sha256 == hashlib.sha256("x|<|end|>\\p\\more".encode()).hexdigest() and d[1].n_turns == 4 and d[2].loss_chars == 0
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 3
def test_toxicity_generalises(spark):
    r = random.Random(3)
    insults = ["blorgish", "zemptard", "quaxling"]
    make = lambda bad: " ".join(r.choice(insults) if bad and r.random() < 0.15 else f"{r.choice(['lo', 'mi', 'ta'])}{r.choice(['ren', 'dal', 'vin', 'sor'])}{r.choice(['', 'a', 'es'])}" for _ in range(40))
    texts, labels = zip(*((make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)))
    df = docs_of(spark, list(texts) + [None, "", "loren b-l-o-r-g-i-s-h mital zemmptard quaxliing blorg.ish vinta", "x " * 5000], [*range(603), None])
    y = spark.createDataFrame([(i, 0, v) for i, v in enumerate(labels)] + [(601, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, y)
    rows = toxicity.score(df, model).collect()
    got = {x.doc_id: x for x in rows}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) > 0.95
    assert got[602].predicted == 1 and got[600].predicted == got[601].predicted == got[None].predicted == 0
    assert all(0 <= x.score <= 1 for x in rows)
    kept = toxicity.keep_clean(df, y)
    assert kept.columns == df.columns and kept.where("doc_id = 602").count() == 0


def test_toxicity_without_labels(spark):
    df = docs_of(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.score(df, toxicity.train(df, none)).collect()}) == 1
    assert toxicity.score(df.limit(0), toxicity.train(df, none)).count() == 0


def test_kernel_by_enumeration():
    """Kernels of words against all their common subsequences; sentences add them up."""

    def kernel(s, t):
        return sum(toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1) for a in itertools.combinations(range(len(s)), 3) for b in itertools.combinations(range(len(t)), 3) if all(s[i] == t[j] for i, j in zip(a, b)))

    words, marks = ["abcabc", "gfedcba", "aabc", "xyz"], ["abc", "cbag", "ßüö"]
    got = toxicity.Landmarks(marks).kernel(words)
    want = [[(kernel(u, m) / (kernel(u, u) * kernel(m, m)) ** 0.5) ** toxicity.POWER for m in marks] for u in words]
    assert np.allclose(got, want, atol=1e-5)
    marked = toxicity.Landmarks(marks)
    sums = toxicity.sentence_features([np.array([0, 1]), np.array([2])], words, marked.kernel, len(marks))
    assert np.allclose(sums, [got[0] + got[1], got[2]])


def test_features_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 4)).astype(np.float32)
    lists = [rng.integers(0, 50, rng.integers(1, 30)) for _ in range(40)]
    for block in (1, 7, 10_000):
        monkeypatch.setattr(toxicity, "WORD_BLOCK", block)
        got = toxicity.sentence_features(lists, [str(i) for i in range(50)], lambda names: rows[[int(n) for n in names]], 4)
        assert np.allclose(got, [rows[x].sum(0) for x in lists], atol=1e-4)


def test_machine_against_plain_descent():
    rng = np.random.default_rng(2)
    x, y, c = rng.normal(size=(300, 5)), np.where(rng.random(300) < 0.3, 1.0, -1.0), rng.random(300) * 2
    c[::17] = 0
    x[y > 0] += 0.7
    loss = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w + toxicity.BIAS)) ** 2).sum() / 2
    slope = lambda w: w - x.T @ (c * y * np.maximum(0, 1 - y * (x @ w + toxicity.BIAS)))
    plain = np.zeros(5)
    for _ in range(20_000):
        plain -= 1e-3 * slope(plain)
    got = toxicity._svm(x, y, c, np.zeros(5))
    assert np.abs(slope(got)).max() < 1e-6 and np.allclose(got, plain, atol=1e-4) and loss(got) <= loss(plain) + 1e-9


def test_sentences():
    starts = lambda text: toxicity.sentence_starts(np.array([t.endswith(toxicity.ENDS) for t in toxicity.tokens_of(text)[0]], bool)).tolist()
    assert starts("A b. C\nd e") == [0, 2, 4] and starts("") == []
    assert starts("w " * 90) == [0, toxicity.LONGEST, 2 * toxicity.LONGEST]
    assert toxicity.words_of("i-d.i*ot!") == ["idiot"] and toxicity.words_of("ab") == ["\x02ab\x03"] and toxicity.words_of("--") == []
    assert "".join(x[: toxicity.WINDOW // 2] for x in toxicity.words_of("abcdefghij" * 7))[:50] == "abcdefghij" * 5
    assert toxicity.tokens_of("an I d i o t x")[1] == ["i d i o t x"]


def test_scores_against_plain_sums(spark):
    """Scores of a model against sums over all words of all sentences, without memory or batches."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["blorg", "lo", "miren", "tasor.", "vindal\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    model = toxicity.fit(texts, [int("blorg" in t) for t in texts])
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts)):
        tokens = text.lower().replace("\n", " . ").split()
        parts, now = [], []
        for t in tokens:
            now.append(t)
            if t[-1] in ".!?:;" or len(now) == toxicity.LONGEST:
                parts.append(now)
                now = []
        parts += [now] * bool(now)
        margins = [sum(float(model.parts([w])[0]) for t in p for w in toxicity.words_of(t)) + toxicity.BIAS for p in parts]
        assert got == pytest.approx(1 / (1 + np.exp(-toxicity.doc_features(np.array(margins)) @ model.doc)), abs=1e-6)


# 4
def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[300:380] = x[0] + rng.normal(size=(80, 16)) * 0.15
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, [1.0], 0), (405, x[1].tolist(), 0), (405, x[1].tolist(), 0), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    u = np.vstack([x, x[1]]) / np.linalg.norm(np.vstack([x, x[1]]), axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_graph.similar_vectors(df).collect()]
    assert len(got) == len(rows)
    true, found = linked.sum(), sum(n for i, n, _, _ in set(got) if i is not None)
    assert 0.9 * true <= found <= true
    by_id = {g[0]: g for g in got}
    assert by_id[405][1:] == (1, 1, False) and by_id[1][1:] == (1, 1, True)
    assert all(by_id[i][1:] == (0, i, True) for i in range(400, 405)) and by_id[None][1:] == (0, None, False)
    assert by_id[300][2] == 0
    assert vector_graph.similar_vectors(df.limit(0)).count() == 0


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "BLOCK", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_graph.similar_vectors(df).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) >= 0.9 * 150 * 149


def test_groups_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    sizes = [20, 40, 70, 150, 600, 2000]
    x = np.vstack([np.repeat(rng.normal(size=(1, 64)), n, axis=0) for n in sizes] + [rng.normal(size=(300, 64))])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_graph.similar_vectors(df).collect()}
    ends = np.cumsum(sizes)
    for a, n in zip(ends - sizes, sizes):
        ids = np.flatnonzero((order >= a) & (order < a + n)).tolist()
        assert {got[i].n_links for i in ids} == {n - 1} and {got[i].component_id for i in ids} == {ids[0]}
        assert [i for i in ids if got[i].kept] == ids[:1]
    assert sum(r.n_links for r in got.values()) == sum(n * (n - 1) for n in sizes)


def test_all_pairs_are_compared_where_the_search_fails(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_graph, "EXACT_BLOCK", 60)
    # the search finds nothing
    monkeypatch.setattr(vector_graph, "_counted", lambda rows, *_: (rows.sparkSession.createDataFrame([], "id long, n long"), rows.sparkSession.createDataFrame([], "a long, b long")))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.8
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in vector_graph.similar_vectors(df, least=0.8).collect()}
    assert [got[i] for i in range(600)] == linked.sum(1).tolist()


def test_widths_do_not_mix(spark, monkeypatch, caplog):
    rng = np.random.default_rng(9)
    sets = {w: np.repeat(rng.normal(size=(n // 2, w)), 2, axis=0) + rng.normal(size=(n // 2 * 2, w)) * 0.01 for w, n in ((3, 120), (2, 4), (5, 60), (1, 2))}
    monkeypatch.setattr(vector_graph, "FEW_OF_A_WIDTH", 50)
    vectors = [v for x in sets.values() for v in x]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = []
    for v in vectors:
        same = [u for u in vectors if len(u) == len(v)]
        want.append(sum(bool(u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9) for u in same) - 1)
    with caplog.at_level("INFO", vector_graph.__name__):
        got = {r.vec_id: r.n_links for r in vector_graph.similar_vectors(df).collect()}
    assert [got[i] for i in range(len(vectors))] == want
    assert sum("recall" in r.message for r in caplog.records) >= 2


def test_recall_without_links_is_not_measured(spark, monkeypatch, caplog):
    monkeypatch.setattr(vector_graph, "FEW_OF_A_WIDTH", 10)
    x = np.eye(40)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    with caplog.at_level("INFO"):
        assert sum(r.n_links for r in vector_graph.similar_vectors(df).collect()) == 0
    assert "recall unmeasured" in caplog.text


def test_lists_are_united():
    ids = np.array([3, 5, 8, 9])
    lists = vector_graph.local_lists(ids, [np.array([8, 4, 9]), np.array([], int), np.array([3, 100]), np.array([5])], None)
    assert [x.tolist() for x in lists] == [[2, 3], [], [0], [1]]
    more = [np.array([1]), np.array([0]), np.array([3]), np.array([2])]
    assert [x.tolist() for x in vector_graph.local_lists(ids, [np.array([8]), np.array([], int), np.array([3]), np.array([5])], more)] == [[1, 2], [0], [0, 3], [1, 2]]


def test_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=(300, 64))
    x = np.vstack([rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.05, one, one + rng.normal(size=(300, 64)) * 0.1])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, w long")
    counts = lambda pairs: spark.createDataFrame([(i, 299 if i < 300 else 1) for i in range(900) if i < 300 or pairs], "id long, n long")
    assert vector_graph.audit(df, counts(True), 0.9) == 1 and vector_graph.audit(df, counts(False), 0.9) < 0.9


# 5
def brute_hits(items, text, window=10):
    words = decontaminate.words_of(text.encode())
    hit, names = set(), set()
    for name, item in items:
        w = decontaminate.words_of(item.encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    return sorted(hit), sorted(names)


def test_benchmark_matches(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(6)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 16)))) for i in range(25)]
    texts = [" ".join(r.choice([*words, "other"]) for _ in range(r.randint(0, 80))) for _ in range(60)] + [items[3][1] + ", " + items[7][1].upper()]
    benchmark = spark.createDataFrame([*items, ("n", None)], "item_id string, text string")
    df = docs_of(spark, [*texts, None, ""])
    got = {r.doc_id: r for r in decontaminate.match_benchmark(df, benchmark).collect()}
    for i, t in enumerate(texts):
        hit, names = brute_hits(items, t)
        assert sorted(x for a, b in got[i].spans for x in range(a, b)) == hit and got[i]["items"] == names
    assert got[len(texts)].n_words == 0
    assert decontaminate.match_benchmark(df, benchmark.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.match_benchmark(df.limit(0), benchmark).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = [(i, " ".join(prose(i, 14))) for i in range(6)]
    df = docs_of(spark, [f"pre {t} post" for _, t in items])
    got = decontaminate.match_benchmark(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in got} == {(i, ((1, 15),), (str(i),)) for i in range(6)}


def test_spans_are_removed(spark):
    item = " ".join(prose(1, 12))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "nothing here, to see "
    df = docs_of(spark, [clean * 8 + item + "; end.", clean, item, None, clean])
    out = decontaminate.remove_spans(df, benchmark)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(0, clean * 8 + "; end."), (1, clean), (4, clean)]
    assert out.where("doc_id = 3").count() == 1 and out.where("doc_id = 2").count() == 0


# 6
def brute_passages(texts, span):
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    owner = {}
    for i, w in words.items():
        for s in range(len(w) - span + 1):
            owner.setdefault(tuple(w[s : s + span]), set()).add(i)
    out = set()
    for i, w in words.items():
        runs = [s for s in range(len(w) - span + 1) if len(owner[tuple(w[s : s + span])]) > 1]
        spans = []
        for s in runs:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + span
            else:
                spans.append([s, s + span])
        out |= {(i, a, b, b - a) for a, b in spans}
    return out


@pytest.mark.parametrize("most", [1000, 2])
def test_passages_against_brute_force(spark, monkeypatch, most):
    shared = [prose(100 + i, 70) for i in range(4)]
    texts = {}
    r = random.Random(6)
    for i in range(60):
        w = prose(i, r.randint(0, 90))
        if i % 3 == 0:
            p = list(shared[i % 4])
            if i % 2:
                p[r.randrange(70)] = "edit"
            w = w + p[r.randint(0, 30) :] + prose(i + 500, 20)
        texts[i] = " ".join(w)
    texts[60] = texts[61] = " ".join(prose(900, 55))
    texts[62] = " ".join(prose(901, 60) * 2)  # repeats within itself only
    texts[63] = "w " * 200
    texts[64] = "w " * 120
    df = docs_of(spark, [*texts.values(), None, ""])
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = {tuple(r) for r in suffix_dedup.repeated_passages(df).drop("text_hash").collect()}
    assert got == brute_passages(texts, 50)
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_texts_that_share_an_id(spark):
    passage, other = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    texts = [f"a {passage} b", f"{other} end", f"{passage} {other}", f"c {other}", passage, passage]
    df = docs_of(spark, [*texts, texts[0]], [1, 1, 1, 2, 3, 4, 1])
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in suffix_dedup.repeated_passages(df).collect())
    assert got == [(1, 0, 60), (1, 0, 120), (1, 1, 61), (2, 1, 61), (3, 0, 60), (4, 0, 60)]
    alone = docs_of(spark, [f"a {passage}", f"b {passage}"], [1, 1])
    assert suffix_dedup.repeated_passages(alone).count() == 0


# 7
def brute_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    top = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min([top[i]] + [top[j] for j in range(len(sets)) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]) for i in range(len(sets))]
        if new == top:
            break
        top = new
    return [(i, len(s), t) for i, (s, t) in enumerate(zip(sets, top))]


@pytest.mark.parametrize(("k", "num", "small"), [(3, 90, False), (5, 80, True)])
def test_groups_against_brute_force(spark, monkeypatch, k, num, small):
    if small:
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
        monkeypatch.setattr(ngram_join, "LEAST_COUNT", 2)
    r = random.Random(7)
    base = [prose(i, 120) for i in range(5)]
    texts = []
    for i in range(90):
        w = list(base[i % 5])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 50)}"
        texts.append(" ".join(w[: r.randint(100, 120)]))
    texts += ["a b", "A  b", "a", None, "", texts[0], texts[0].upper()]
    df = docs_of(spark, texts)
    got = sorted(tuple(x) for x in ngram_join.similar_groups(df, shingle_words=k, num=num).collect())
    assert got == brute_groups(texts, k, num, 100)
    kept = ngram_join.keep_one(df, shingle_words=k, num=num)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted({t for _, _, t in got})
    assert ngram_join.similar_groups(df.limit(0)).count() == 0


def test_groups_with_odd_ids(spark):
    df = docs_of(spark, ["x y z q", "x y z q", "x y z q", "r s t u"], [5, 5, None, 7])
    got = sorted((str(x.doc_id), x.n_shingles, x.component_id) for x in ngram_join.similar_groups(df).collect())
    assert got == [("5", 2, 5), ("5", 2, 5), ("7", 2, 7), ("None", 2, None)]


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(prose(i, 120)) for i in (1, 2, 3))
    edit = lambda t: t.rsplit(" ", 1)[0] + " edited"
    df = docs_of(spark, [a, b, edit(b), edit(a), c, c], [5, 5, 6, 8, 9, 9])
    got = {x.doc_id: x.component_id for x in ngram_join.similar_groups(df).collect()}
    assert got == {5: 5, 6: 5, 8: 5, 9: 9}
    df = docs_of(spark, [a, b, edit(b), c, c, None, None, c + " more", a], [5, 5, 6, 9, 9, None, 7, None, None])
    kept = ngram_join.keep_one(df).collect()
    assert len(kept) == 5 and {x.text for x in kept} >= {None} and len({x.text for x in kept if x.text}) == 3
    again = ngram_join.keep_one(df).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_rest_of_a_large_place_meets_all_blocks(spark, monkeypatch):
    """Chains whose ends are not similar to the first document, over many small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    w = prose(1, 400, 10_000)
    texts = [" ".join([*(f"e{j}" for j in range(i)), *w[i:]]) for i in range(0, 120, 2)]
    random.Random(2).shuffle(texts)
    df = docs_of(spark, texts)
    assert sorted(tuple(x) for x in ngram_join.similar_groups(df, num=97).collect()) == brute_groups(texts, 3, 97, 100)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 8
PAGE = '<html><head><title>T</title><script>x="</p>"</script></head><body><div class="top">Site of {h}</div><nav><a href=/>Home</a></nav><div id="c{i}"><h2>{t}</h2><p>One &amp; <b>two</b>\n {t}<p>{u}<ul><li>x{i}</ul><div class="comments"><p>nice</p></div></div><div class="cookie-notice">We use {i}</div><aside>s</aside><footer>f{i}</footer>'


def test_pages(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(h=i % 2, i=i, t=f"title {i}", u=" ".join(prose(i, 30))), "x") for i in range(40)]
    rows += [(100, None, None, "x"), (101, "odd", "", "x"), (102, "https://h0.example/a", "<article><p>A&nbsp;b<br>c<p>d</article><p>out", "x"), (102, "https://h0.example/a", "<article><p>A&nbsp;b<br>c<p>d</article><p>out", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_texts(df).collect()]
    assert len(got) == 44
    by_id = {g[0]: g for g in got}
    for i in range(40):
        assert by_id[i][1] == f"title {i}\nOne & two title {i}\n{' '.join(prose(i, 30))}\nx{i}"
    assert by_id[100][1:] == ("", 0) and by_id[101][1:] == ("", 0) and by_id[102][1:] == ("A b c\nd", 7)
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_names_of_layout_are_no_parts():
    for name in ("content has-sidebar", "no-sidebar", "with-menu", "page-with-header", "share-enabled", "sidebar", "menu x"):
        assert html_extract.extract(f'<div class="{name}"><div><article><h1>T</h1><p>a</article></div></div>') == "T\na"
    assert html_extract.extract('<div class="entry-header"><h1>T</h1></div><div class="content"><p>a</div>') == "T\na"
    assert html_extract.extract('<div class="cookie-notice">n</div><div id="ad-1">n</div><div class="box ad">n</div><p>a') == "a"
    assert html_extract.extract('<div class="sidebar"><main><p>a</main></div><div>x</div>') == "a"
    assert html_extract.extract('<div class="content"><p>a</div><div class="related"><article><p>n</article></div>') == "a"
    assert html_extract.extract('<div class="comments"><footer><article><p>n</article></footer></div><nav><article><p>n</article></nav><p>a') == "a"


def skeleton(tree):
    """Of nested (label, children) pairs."""
    parents, paths = [], []

    def add(node, parent, path):
        parents.append(parent)
        paths.append(hash((path, node[0])))
        at, own = len(parents) - 1, paths[-1]
        for c in node[1]:
            add(c, at, own)

    add(tree, -1, 0)
    return html_extract.Skeleton(parents, paths, [0] * len(parents), [0] * len(parents))


def brute_match(a, b):
    """Size of the largest match by plain recursion."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_match(x[0], y[0]))

    return 1 + best(a[1], b[1])


def test_alignment_is_largest(monkeypatch):
    r = random.Random(8)
    tree = lambda depth: (r.choice("abc"), [tree(depth - 1) for _ in range(r.randint(0, 4))] if depth else [])
    for _ in range(300):
        a, b = ("r", [tree(2) for _ in range(4)]), ("r", [tree(2) for _ in range(4)])
        x, y = skeleton(a), skeleton(b)
        for cells in (200_000, 3):
            monkeypatch.setattr(html_extract, "CELLS", cells)
            pairs = html_extract.tree_match(x, y)
            assert all(x.paths[u] == y.paths[v] for u, v in pairs) and len(dict(pairs)) == len({v for _, v in pairs}) == len(pairs)
            assert [v for _, v in sorted(pairs)] == sorted(v for _, v in pairs)
            assert len(pairs) == brute_match(a, b) if cells > 3 else len(pairs) <= brute_match(a, b)


def test_deep_and_wide_pages(spark):
    deep = lambda i: "<div>" * 1500 + f"<p>deep {i}" + "</div>" * 1500 + "<i>x</i>" * i
    wide = lambda i: "".join(f"<p class=c{'ab'[j % (i + 2) == 0]}>w{i} {j}</p>" for j in range(20_000))
    pages = [(i, f"http://{h}/{i}", f"<body>{make(i)}</body>") for h, make in (("deep", deep), ("wide", wide)) for i in range(4)]
    df = spark.createDataFrame([(k, u, p) for k, (_, u, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert [got[i].split("\n")[0] for i in range(4)] == [f"deep {i}" for i in range(4)]
    assert all(got[4 + i] == "\n".join(f"w{i} {j}" for j in range(20_000)) for i in range(4))


def test_wrapper_decides(spark):
    """Nothing but the alignment tells what is constant and where the text is."""
    page = lambda i: f'<div class="a"><p>Same on all pages</p><p>v{i}</p></div><div class="b"><p>{" ".join(prose(i, 40))}</p><p>{" ".join(prose(i + 99, 30))}</p></div><div class="c"><p>Constant too</p></div>'
    df = spark.createDataFrame([(i, "http://x/", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert got == {i: " ".join(prose(i, 40)) + "\n" + " ".join(prose(i + 99, 30)) for i in range(12)}
    assert html_extract.extract(page(3)).startswith("Same on all pages\nv3\n")  # without a wrapper
    # an article around the slot is meant as a whole, whatever its links and class names
    page = lambda i: f'<article><h1>t{i}</h1><div class="side-effects">s{i}</div><div class="form-factor"><a href=x>a long link {i}</a></div><div class="body"><p>{" ".join(prose(i, 40))}</p></div></article><div><p>out{i}</p></div>'
    df = spark.createDataFrame([(i, "http://x/", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert got == {i: f"t{i}\ns{i}\na long link {i}\n" + " ".join(prose(i, 40)) for i in range(12)}


def test_broken_pages():
    for page in ("<p>a<", "<p>a<b", "<p>a<!-- x", "</div></p>a", "<p>a<script>b", '<p class="x>a', "<table><tr><td>a<td>b<tr><td>c", "&am", "<<p>>"):
        assert isinstance(html_extract.extract(page), str)
    assert html_extract.extract("<p>a<!-- x") == "a" and html_extract.extract("<table><tr><td>a<td>b<tr><td>c") == "a\nb\nc"


# 9
def test_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 2, None: 500}
    df = docs_of(spark, ["w " * n for n in sizes.values()]).drop("id")
    df = df.withColumn("source", F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("doc_id") + 1).cast("int")))
    weights, total = dict(zip(["a", "b", "c", "d", None], itertools.cycle(mixing.WEIGHTS))), sum(sizes.values())
    open_, left, want = set(sizes), float(total), {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    got = {r.source: r.target for r in mixing.source_targets(df.select("source", F.size(F.split(F.btrim("text"), " ")).cast("long").alias("size"))).collect()}
    assert got == {s: pytest.approx(v) for s, v in want.items()}


def test_mix_reaches_targets(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", None, "c"])) for i in range(2000)] + [(5, None, "a"), (5, None, "a"), (None, "w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("h", F.lit("x"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and all(x.taken == x.copies * x.size <= 3 * x.size for x in out)
    by = {}
    for x in out:
        by.setdefault((x.target, x.source_size), []).append(x.taken)
    assert len(by) == 4 and all(abs(sum(v) - t) <= 15 for (t, _), v in by.items())
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


# 10
def test_ids_equal_the_library():
    c = Encoder.of(P.path("word_bpe_49k.json"), 2)
    texts = odd_texts()
    got = [np.frombuffer(x, np.uint16).tolist() for x in c.encode([x.encode() for x in texts])]
    assert got == [[*e.ids, 2] for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_letters_and_marks_are_words_of_their_own():
    c = Encoder(P.path("word_bpe_49k.json"), 2)
    around = [chr(i) for i in [*range(128), *range(0xA0, 0x250), 0x307, 0x338, 0x300, 0x3A3, 0x3C2, 0x4E2D, 0x212A, 0x2028, 0x3000, 0x1F600, 0x10400]]
    texts = [x.join(y) for x in around for y in ("a.", ".a", "..", "\u00e9,", "=\u00c9", "1a", "'.", ".'", "a'", "'s", " <")]
    texts += ["", " ", "\n\t", ".", "a", "it's.'s,'ll!'LL", "<|endoftext|>.", "A.<|endoftext|>a. <|ENDOFTEXT|>", "<|x", "|>.a", "\u0130. \u0130\u0130.\u0130", " ".join(around), "".join(around)]
    want = [[*e.ids, 2] for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in c.encode([x.encode() for x in texts])] == want
    assert [c.encode([x.encode()])[0] for x in texts[-13:]] == [np.array(x, np.uint16).tobytes() for x in want[-13:]]
    assert c.encode([]) == [] and c.encode([None, b"", b" "]) == [c.end] * 3
    c.known.clear()
    c.encode([b"river. (river) River, b\xc3\xa9ta! b\xc3\xa9ta\xc3\x97"])
    assert set(c.known) == {b"river", b"b\xc3\xa9ta", b"b\xc3\xa9ta\xc3\x97", b".", b",", b"!", b"(", b")"}


def test_a_word_is_looked_up_once_a_group():
    class Counted(dict):
        looked_up = 0

        def get(self, key):
            self.looked_up += 1
            return super().get(key)

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    c = Encoder(P.path("word_bpe_49k.json"), 2)
    c.known = Counted()
    texts = [b"one two three. " * 500, None, b"Two one, " * 500] * 10
    got = c.encode(texts)
    assert got == [np.array([*c.tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids, 2], np.uint16).tobytes() for t in texts]
    assert c.known.looked_up < 20


def test_memory_that_starts_anew_changes_no_id(monkeypatch):
    from waymark.llm import records

    c = Encoder(P.path("word_bpe_49k.json"), 2)
    texts = [x.encode() for x in odd_texts()]
    want = c.encode(texts)
    monkeypatch.setattr(records, "MEMORY_WORDS", 5)
    assert [x for i in range(0, len(texts), 7) for x in c.encode(texts[i : i + 7])] == want


def test_records_round_trip(spark, tmp_path, monkeypatch):
    from waymark.llm import records

    monkeypatch.setattr(records, "SHARD_BYTES", 300)
    monkeypatch.setattr(records, "PARTITION_BYTES", 2000)
    texts = [" ".join(prose(i, i % 40)) for i in range(200)]
    df = docs_of(spark, [*texts, None, "", "null id"], [*range(200, 0, -1), 201, 202, None])
    write_records(df, str(tmp_path / "out"), P.path("word_bpe_49k.json"), 2)
    got = sorted(read_records(spark, str(tmp_path / "out"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(1, 203)]
    tokenizer = Encoder.of(P.path("word_bpe_49k.json"), 2).tokenizer
    start = 0
    for r in got:
        text = "null id" if r.doc_id is None else texts[200 - r.doc_id] if r.doc_id <= 200 else ""
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = read_index(spark, str(tmp_path / "out")).collect()
    one = next(r for r in index if r.doc_id == 77)
    data = next((tmp_path / "out/kind=data" / f"shard={one['shard']}").glob("part-*")).read_bytes()
    assert records.parse(data, one["offset"])[0] == 77
    with pytest.raises(ValueError, match="damaged"):
        records.parse(data[: one["offset"] + 14] + b"\xff\xff\xff" + data[one["offset"] + 17 :], one["offset"])
    write_records(df.limit(0), str(tmp_path / "none"), P.path("word_bpe_49k.json"), 2)
    assert read_records(spark, str(tmp_path / "none")).count() == 0


def test_a_join_frees_what_the_worker_remembers(spark):
    from waymark.llm import ngram_join

    docs = spark.createDataFrame([(i, "one two three four") for i in range(8)], "doc_id long, text string").coalesce(1)

    def held(batches):
        from waymark.llm import common

        common._resident[("another", "operator")] = {}
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array([-1 - (("another", "operator") in common._resident)]), pa.array([""])], ["doc_id", "text"])

    def kept(batches):
        from waymark.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(sorted(common._resident))] * batch.num_rows)], ["kept"])

    assert docs.mapInArrow(held, docs.schema).where("doc_id = -2").count() == 1
    assert ngram_join.profiles(docs, "doc_id", "text", 3, 90, 100).count() == 8
    assert "another" not in {r.kept for r in docs.mapInArrow(kept, "kept string").collect()}.pop()


def test_learning_a_word_does_not_walk_through_all_known_words():
    import time

    encoder = Encoder(P.path("word_bpe_49k.json"), 2)
    encoder.known = {b"w%d" % i: b"" for i in range(700_000)}
    took = []
    for k in range(8):
        began = time.perf_counter()
        encoder.learn({b"Word%d," % k})
        took.append(time.perf_counter() - began)
        assert encoder.known[b"Word%d," % k]
    assert min(took) < 0.005  # the walk takes 13 ms
