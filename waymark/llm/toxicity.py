"""Operator 3: toxicity by a subsequence string kernel machine over sentences.

An instance is a sentence: the words between two sentence ends (or line ends),
at most ``LONGEST`` of them; a run of single letters with spaces between, as in
gapped insults, is a sentence of its own.  Marks are taken out of a word, so
``i-d.i*o t`` and ``idiot`` are the same.  The kernel of two words sums over
their common subsequences of three characters, each weighted by ``DECAY`` to the
length it spans in either word, is normalised and raised to ``POWER``; so a word
with inserted characters stays near the plain one.  The kernel of two sentences
is the sum over their pairs of words.

Sentences of labelled documents carry the document's label.  Landmarks are
words of these sentences (those that the labels' sentences use most unequally,
and random ones); the Nystroem features of a sentence are the sums of those of
its words.  A support vector machine with squared hinge loss is trained on the
sentences.  Since only some sentences of a toxic document are toxic, it is
trained again on those that it takes for toxic, at least one a document, until
these stay the same.  Disguised copies of them are learnt as well.  A document's
score is a logistic function of its sentences' margins, fitted to the
documents' labels.

Training reads at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents of
at most ``TRAIN_BYTES`` bytes, drawn by hash, in one task; scoring reads every
whole text.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, resident, small_batches

TOXIC_DOCS, CLEAN_DOCS, TRAIN_BYTES = 1500, 2500, 20_000
DECAY, POWER, LANDMARKS = 0.8, 3, 128
#: The margin of a sentence of words that nothing is known of: clean.
BIAS = -1.0
#: What a wrong sentence costs the machine against the size of its weights.
COST = 1.0
#: Times the machine chooses the toxic sentences anew.
ROUNDS = 6
#: Words of more characters are looked at through overlapping windows.
WINDOW = 20
#: Words of a sentence.
LONGEST = 40
#: Keys of triples: hashes of so many bits.
KEY_BITS = 20
MEMORY_WORDS = 500_000
#: Words whose features are held at a time while the machine learns.
WORD_BLOCK = 10_000
GROUP_BYTES = 1_000_000
N_FEATURES = 9

SPELT = re.compile(r"(?<!\S)(?:\S[^\S\n]){2,}\S(?!\S)")
MARKS = re.compile(r"[\W_]+")
ENDS = (".", "!", "?", "…", "。", "！", "？", ":", ";")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def tokens_of(text: str) -> tuple[list[str], list[str]]:
    """Lower-case tokens, a line end as a token that ends a sentence, and spelt-out runs."""
    text = text.lower()
    return text.replace("\n", " . ").split(), SPELT.findall(text)


def words_of(token: str) -> list[str]:
    """What the kernel sees of a token: its letters and digits, long ones in windows."""
    word = MARKS.sub("", token)
    if len(word) <= WINDOW:
        return [word] if len(word) > 2 else [f"\x02{word}\x03"] if word else []  # at least three characters
    return [word[a : a + WINDOW] for a in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Where sentences begin; ``ends`` tells which tokens end one."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], ends[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero((np.arange(n) - first) % LONGEST == 0)


_triples: dict[int, tuple[np.ndarray, ...]] = {}


def triples(n: int) -> tuple[np.ndarray, ...]:
    """Places of all subsequences of three among ``n``, and their weights."""
    if n not in _triples:
        at = np.array(list(combinations(range(n), 3)), np.int32).reshape(-1, 3)
        _triples[n] = (at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32))
    return _triples[n]


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself; ``codes`` has a row per word."""
    n, size = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    before = np.ones((n, size, size), np.float32)
    for _ in range(2):
        step = same * before
        for b in range(1, size):
            step[:, :, b] += np.float32(DECAY) * step[:, :, b - 1]
        for a in range(1, size):
            step[:, a] += np.float32(DECAY) * step[:, a - 1]
        before = np.zeros_like(step)
        before[:, 1:, 1:] = step[:, :-1, :-1]
    return (same * before).sum((1, 2), dtype=np.float64)


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def keys_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word's triples, and the triples' weights."""
    i, j, k, weight = triples(codes.shape[1])
    a, b, c = (codes * f for f in _FACTORS)
    keys = a[:, i] ^ (b[:, j] * np.uint32(31)) ^ (c[:, k] * np.uint32(961))
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x2C1B3C6D)
    return (keys >> np.uint32(32 - KEY_BITS)).astype(np.int32), weight


def by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for x, w in enumerate(words):
        groups.setdefault(len(w), []).append(x)
    for n, members in sorted(groups.items()):
        for a in range(0, len(members), 1000):
            yield n, members[a : a + 1000]


class Landmarks:
    """Words that others are compared with: a row of weights for each of their triples."""

    def __init__(self, words: list[str]):
        found = []
        for x, word in enumerate(words):
            codes = codes_of([word])
            keys, weight = keys_of(codes)
            found.append((keys[0], weight / np.sqrt(self_kernel(codes)[0]), np.full(len(weight), x)))
        keys, weights, columns = (np.concatenate(c) for c in zip(*found))
        self.keys, at = np.unique(keys, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, len(words)), np.float32)
        np.add.at(self.table, (at + 1, columns), weights)
        self.index()

    def index(self) -> None:
        self.row = np.zeros(1 << KEY_BITS, np.int32)  # row 0 holds no weights
        self.row[self.keys] = np.arange(1, len(self.keys) + 1)

    def __getstate__(self):
        return {"keys": self.keys, "table": self.table}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.index()

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for n, members in by_length(words):
            codes = codes_of([words[x] for x in members])
            keys, weight = keys_of(codes)
            rows = self.row[keys]
            sums = np.zeros((len(members), self.table.shape[1]), np.float32)
            for t in range(len(weight)):
                sums += self.table[rows[:, t]] * weight[t]
            out[members] = sums / np.sqrt(self_kernel(codes)).astype(np.float32)[:, None]
        return out**POWER


class Model:
    """A learnt scorer; small, of bounded size, and sent to the executors."""

    def __init__(self, rate: float, landmarks: Landmarks | None = None, weights: np.ndarray | None = None, doc: np.ndarray | None = None):
        self.rate, self.landmarks, self.weights, self.doc = rate, landmarks, weights, doc

    def parts(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of a sentence."""
        return np.concatenate([np.zeros(0), *(self.landmarks.kernel(words[a : a + 20_000]) @ self.weights for a in range(0, len(words), 20_000))])


def doc_features(margins: np.ndarray) -> np.ndarray:
    """What a document's score sees of the margins of its sentences.

    The largest three, how many are toxic or surely so, and how many there are.
    """
    top = np.array([-1.0, 0.0, 0.0])  # the second and third count only if they are toxic
    largest = np.sort(margins)[::-1][:3]
    top[: len(largest)] = np.clip(largest, top[: len(largest)], 3)
    toxic, sure = np.log1p([np.count_nonzero(margins > 0), np.count_nonzero(margins > 0.5)])
    scale = np.log1p(len(margins)) / 5
    return np.array([1.0, *top, toxic, sure, scale, scale * toxic, scale * sure])


def _newton(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model; ``share`` is what a row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Margins of all rows; numpy would hold a copy of them all in doubles, so blocks are taken."""
    return np.concatenate([np.zeros(0), *(x[a : a + 10_000] @ w for a in range(0, len(x), 10_000))]) + BIAS


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of a squared-hinge machine of bias ``BIAS``, by Newton steps from ``w``.

    ``c`` is what each row costs if it is wrong; rows of cost 0 do not count.
    """
    for _ in range(40):
        active = np.flatnonzero((c > 0) & (y * _margins(x, w) < 1))
        square, line = np.eye(len(w)), np.zeros(len(w))
        for a in range(0, len(active), 10_000):
            part = active[a : a + 10_000]
            xa, ca = x[part].astype(float), c[part]
            square += (xa * ca[:, None]).T @ xa
            line += xa.T @ (ca * (y[part] - BIAS))
        new = np.linalg.solve(square, line)
        moved = np.abs(new - w).max()
        w = new
        if moved < 1e-6:
            break
    return w


def _disguised(word: str, rng: np.random.Generator) -> str:
    """A word with a letter doubled or inserted, as writers disguise it."""
    at = int(rng.integers(1, len(word)))
    return (word[:at] + (word[at - 1] if rng.random() < 0.5 else chr(97 + int(rng.integers(26)))) + word[at:])[:WINDOW]


def sentence_features(lists: list[np.ndarray], names: list[str], of_words, width: int) -> np.ndarray:
    """Sum of ``of_words`` (words -> rows) over the words that each list names.

    Words are looked at in blocks, so only one block's rows are held at a time.
    """
    out = np.zeros((len(lists), width), np.float32)
    owner, word = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    order = np.lexsort((owner, word // WORD_BLOCK))
    owner, word = owner[order], word[order]
    cuts = np.searchsorted(word // WORD_BLOCK, np.arange(-(-len(names) // WORD_BLOCK) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows = of_words(names[k * WORD_BLOCK : (k + 1) * WORD_BLOCK])
        for lo in range(a, b, 5 * WORD_BLOCK):
            part = slice(lo, min(b, lo + 5 * WORD_BLOCK))
            who, first = np.unique(owner[part], return_index=True)
            out[who] += np.add.reduceat(rows[word[part] - k * WORD_BLOCK], first, axis=0)
    return out


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> Model:
    """Learn from whole texts and their labels; one label alone gives its rate."""
    y = np.array(toxic, int)
    rate = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    if len(set(toxic)) < 2:
        return Model(rate)
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    sentences, owners, empty = [], [], np.zeros(len(y), int)
    for d, text in enumerate(texts):
        tokens, runs = tokens_of(text)
        starts = sentence_starts(np.array([t.endswith(ENDS) for t in tokens], bool)).tolist()
        for part in [*(tokens[a:b] for a, b in zip(starts, [*starts[1:], len(tokens)])), *([r] for r in runs)]:
            own = [ids.setdefault(w, len(ids)) for t in part for w in words_of(t)]
            if own:
                sentences.append(np.array(own))
                owners.append(d)
            else:
                empty[d] += 1
    words, owner = list(ids), np.array(owners, int)
    label = y[owner] == 1
    if not label.any() or label.all():
        return Model(rate)
    # equal sentences of one label count once as instances
    seen: set[tuple[bytes, bool]] = set()
    first = np.array([not ((k := (s.tobytes(), v)) in seen or seen.add(k)) for s, v in zip(sentences, label.tolist())])
    used = [np.bincount(np.concatenate([np.unique(s) for s, v, f in zip(sentences, label, first) if f and v == w]), minlength=len(words)) for w in (False, True)]
    n = [np.count_nonzero(first & (label == w)) for w in (False, True)]
    share = [(u + 0.5) / m for u, m in zip(used, n)]
    unequal = np.argsort(-(share[1] - share[0]) / np.sqrt(share[0] / n[0] + share[1] / n[1]), kind="stable")
    drawn = rng.permutation(len(words))[: LANDMARKS // 3]
    marks = [words[x] for x in dict.fromkeys([*unequal[: LANDMARKS - len(drawn)].tolist(), *drawn.tolist()])]
    landmarks = Landmarks(marks)
    square = landmarks.kernel(marks).astype(float)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def features(lists: list[np.ndarray], names: list[str]) -> np.ndarray:
        return sentence_features(lists, names, lambda block: (landmarks.kernel(block) @ root).astype(np.float32), len(marks))

    x = features(sentences, words)
    active, copy_of, clean = label & first, np.zeros(0, int), ~label & first
    w = np.zeros(x.shape[1])
    for step in range(ROUNDS):
        # toxic and clean sentences weigh the same together; many of one document weigh less each
        crowd = 1 / np.sqrt(np.maximum(1, np.bincount(owner[active], minlength=len(y))))
        cost = np.concatenate((np.where(active, crowd[owner], 0), np.where(active[copy_of], 0.3 * crowd[owner[copy_of]], 0)))
        cost *= clean.sum() / cost.sum()
        cost[: len(clean)][clean] = 1
        w = _svm(x, np.where(np.concatenate((label, label[copy_of])), 1.0, -1.0), COST * cost, w)
        margin = _margins(x[: len(owner)], w)
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner[label & first], margin[label & first])
        chosen = label & first & ((margin > 0) | (margin >= best[owner]))
        if step and np.array_equal(chosen, active):
            break
        active = chosen
        if step == 1:  # by now they are few
            copy_of = np.flatnonzero(active)
            spelt: dict[str, int] = {}
            lists = [np.array([spelt.setdefault(_disguised(words[v], rng), len(spelt)) for v in sentences[i]]) for i in copy_of]
            x = np.concatenate((x, features(lists, list(spelt))))
    model = Model(rate, landmarks, root @ w)
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(y) + 1))
    of_docs = [doc_features(np.concatenate((margin[order[cut[d] : cut[d + 1]]], np.full(empty[d], BIAS)))) for d in range(len(y))]
    model.doc = _newton(np.stack(of_docs), y.astype(float), np.ones(len(y)), 1.0)
    return model


class Scorer:
    """Remembers what tokens add; lives as long as its Python worker."""

    #: Added to the value of a token that ends a sentence.
    END = 1e6

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def learn(self, tokens: list[str]) -> None:
        ids: dict[str, int] = {}
        lists = [[ids.setdefault(w, len(ids)) for w in words_of(t)] for t in tokens]
        parts = self.model.parts(list(ids)).tolist()
        self.known.update((t, sum(parts[x] for x in own) + (self.END if t.endswith(ENDS) else 0.0)) for t, own in zip(tokens, lists))

    def margins(self, tokens: list[str], runs: list[str]) -> np.ndarray:
        values = np.fromiter(map(self.known.__getitem__, tokens), float, len(tokens))
        ends = values > self.END / 2
        values[ends] -= self.END
        sums = np.add.reduceat(values, sentence_starts(ends)) if len(values) else values
        return np.concatenate((sums, [self.known[r] % self.END if self.known[r] > self.END / 2 else self.known[r] for r in runs])) + BIAS

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model.landmarks is None:
            return [self.model.rate] * len(texts)
        split = [tokens_of(t) if t else ([], []) for t in texts]
        used = set().union(*(x for both in split for x in both))
        unseen = used.difference(self.known)
        if unseen:
            if len(self.known) + len(unseen) > MEMORY_WORDS:
                self.known.clear()
                unseen = used
            self.learn(list(unseen))
        x = np.stack([doc_features(self.margins(*both)) for both in split])
        return (1 / (1 + np.exp(-np.clip(x @ self.model.doc, -30, 30)))).tolist()


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, toxic`` of the bounded sample to learn from, drawn by hash.

    Ids are drawn first; only the texts of those few leave the scan.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    able = known.where(~held_out("id")).join(rows.select("id"), "id", "left_semi").withColumn("h", F.md5(F.concat_ws(":", "id", F.lit("learn"))))
    pick = lambda label, n: able.where(F.col("toxic") == label).orderBy("h", "id").limit(n).select("id", "toxic")
    drawn = pick(1, TOXIC_DOCS).unionAll(pick(0, CLEAN_DOCS))
    # at most that many rows; an id that many rows repeat still gives no more texts
    texts = rows.join(F.broadcast(drawn), "id").withColumn("h", F.md5(F.concat_ws(":", "id", F.lit("learn"))))
    return texts.orderBy("h", "id", "text", "toxic").limit(TOXIC_DOCS + CLEAN_DOCS).select("text", "toxic")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """A pickled model from labelled documents that are not held out, learnt in one task."""

    def learn(batches):
        resident(("toxicity", "training"), dict)  # what an operator before this one remembers goes
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], ["model"])

    rows = training_rows(docs, labels, id_col, text_col, label_col)
    found = rows.coalesce(1).mapInArrow(learn, "model binary").first()
    return bytes(found["model"]) if found else pickle.dumps(fit([], []))


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out, score, predicted``.

    ``model`` is what ``train`` returns.  The score lies in 0 .. 1.  Null and
    empty texts get that of a text without sentences; a null id is not held
    out; repeated rows get equal scores; ``keep`` names columns to carry along
    (in a struct ``row``); empty tables give empty results, and without labels
    of both kinds the score is constant.
    """
    key = hashlib.sha1(model).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0.0).alias("score"), *([F.struct(*keep).alias("row")] if keep else []))

    def run(batches):
        scorer = resident(("toxicity", key), lambda: Scorer(pickle.loads(sent.value)))
        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                found = pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), found, *(batch.column(i) for i in range(3, batch.num_columns))], ["id", "score", *batch.schema.names[3:]])

    schema = rows.select("id", "score", *(["row"] if keep else [])).schema
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row"] if keep else []))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents predicted toxic, same columns."""
    kept = score(docs, train(docs, labels, id_col, text_col), id_col, text_col, threshold, tuple(docs.columns)).where("predicted = 0")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
