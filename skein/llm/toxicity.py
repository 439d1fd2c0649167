"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

Texts are read as sentences of words. The kernel counts the subsequences of three letters that two
strings share, each weighted by DECAY to the power of the stretch it covers, so that a letter put in
or left out costs a factor instead of the match; digits and signs that stand for letters are
read as such, punctuation inside a word falls out, and letters and short fragments that stand apart are
joined. A long word is also read without every second letter, and without the one that it has most often,
which undoes letters put in throughout. A word carries a mark at either end. A sentence, and so a text, is as toxic as its most toxic word.

Training: labels belong to documents, so the sentences of clean documents are negative throughout
and those of a toxic one hold at least one insult. Seeds are words that toxic documents share and
clean ones lack; the machine is then trained, each toxic document names its worst word, clean
documents name theirs as hard negatives, and it is trained again. The landmarks are words of both
classes; since the decision is a weighted sum of kernels with the landmarks, it folds into one weight
for each three-letter subsequence, which is all that scoring needs. A logistic curve over the two
worst words of documents kept from the machine turns decisions into scores.

Fitting uses a sample of labelled rows bounded by SAMPLE_DOCS for each class, drawn by a hash of the
id; scoring covers every text, whole. Defined results: a text without letters, empty or null, has
score 0; conflicting labels of an id count as toxic; without labels of both classes every score is 0.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches

#: The most labelled documents of each class that the fit looks at (about; drawn by hash).
SAMPLE_DOCS = 2500
#: The most of the sample's clean words that the machine trains on besides hard ones (drawn at random, the
#: weight of the others on top); each round looks at all of them and adds those that it mistakes.
SAMPLE_WORDS = 8000
LANDMARKS = 256
DECAY = 0.6
#: Of all errors of a class against the machine's norm.
COST = 3000.0
#: Offsets of the second and third letter: a subsequence covers at most five letters, so two letters put
#: in next to each other, or one in each gap, are bridged.
OFFSETS = tuple((i, j) for j in range(2, 5) for i in range(1, j))
#: Latin letters, to which others of their script are folded; letters of other scripts share OTHERS
#: symbols by code point, so that those of one alphabet rarely meet. A word's mark is symbol 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçñóíáúàâîôûïùœ"
OTHERS = 64
SYMBOLS = len(LETTERS) + 1 + OTHERS
#: Decisions lie above it.
FLOOR = -3.0
#: The second-worst word counts as at most this far below the worst: one insult is enough.
LONE = 0.3
LONGEST, STRIDE = 24, 12
MEMO_WORDS = 300_000
#: Strings whose features are held at once.
BLOCK = 4096
#: Strings that are held against all landmarks at once: some hundred kilobytes each.
KERNEL_BLOCK = 128
FOLDS, HELD_OUT = 5, 0

#: Digits and signs that stand for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Neighbouring fragments of at most so many characters are also read as one word.
FRAGMENT = 3
#: Fewest letters of a word that has views, and of a view.
VIEWED, VIEW_LETTERS = 7, 4


class _Fold(dict):
    """For str.translate: each letter as the character whose number is its symbol, all else dropped."""

    def __missing__(self, point: int) -> str:
        c = DISGUISES.get(chr(point), chr(point).lower())
        parts = unicodedata.normalize("NFKD", c)
        plain = c if c in LETTERS else parts[:1]
        if plain and plain in LETTERS:
            self[point] = chr(LETTERS.index(plain) + 1)
        else:  # the letter below its marks; a syllable sign that falls into letters is kept whole
            letter = plain if all(map(unicodedata.combining, parts[1:])) else c[:1]
            self[point] = chr(len(LETTERS) + 1 + ord(letter) % OTHERS) if letter.isalpha() else ""
        return self[point]


FOLD = _Fold()


def units(word: str, views: bool = True) -> list[str]:
    """A word as the strings that the kernel compares: one, or overlapping windows if it is long; with
    views also what is left of it if letters were put in: every second letter, and all but the letter that
    it has most often, twice at least (of several, the first of the alphabet)."""
    if not any(c.isalpha() for c in word):
        return []
    s = word.translate(FOLD)
    if not s:
        return []
    seen = [s]
    if views and len(s) >= VIEWED:
        filler = max(sorted(set(s)), key=s.count)
        seen += [v for v in (s[::2], s[1::2], s.replace(filler, "") if s.count(filler) > 1 else "") if len(v) >= VIEW_LETTERS]
    return [u for x in seen for u in _windows(f"\0{x}\0")]


def _windows(s: str) -> list[str]:
    return [s] if len(s) <= LONGEST else [s[i : i + LONGEST] for i in range(0, len(s) - STRIDE, STRIDE)]


def words_of(text: str) -> list[str]:
    """Words, and what neighbouring letters and fragments make together."""
    words = text.split()
    short = np.fromiter((len(w) <= FRAGMENT for w in words), bool, len(words))
    edges = np.flatnonzero(np.diff(short, prepend=False, append=False))
    runs = edges.reshape(-1, 2)[np.diff(edges)[::2] > 1]
    return words + ["".join(words[a:b]) for a, b in runs.tolist()]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight) of normalised feature vectors, combined and sorted."""
    flat = np.frombuffer("".join(strings).encode("ascii"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    keys, weights = [], []
    for d1, d2 in OFFSETS:
        n = len(flat) - d2
        if n <= 0:
            continue
        at = np.flatnonzero(row[:n] == row[d2:])
        keys.append((row[at] * SYMBOLS + flat[at]) * SYMBOLS**2 + flat[at + d1] * SYMBOLS + flat[at + d2])
        weights.append(np.full(len(at), DECAY ** (d2 + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    key, weight = key[starts], np.add.reduceat(weight, starts) if len(starts) else weight
    row, code = np.divmod(key, SYMBOLS**3)
    norm = np.sqrt(np.bincount(row, weight**2, len(strings)))
    return row, code, weight / norm[row]


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    row, code, weight = features(landmarks)
    known, place = np.unique(code, return_inverse=True)
    dense = np.zeros((len(known) + 1, len(landmarks)))  # the last row: subsequences that no landmark has
    dense[place, row] = weight
    out = np.empty((len(strings), len(landmarks)))
    for i in range(0, len(strings), KERNEL_BLOCK):
        row, code, weight = features(part := strings[i : i + KERNEL_BLOCK])
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        at = np.where(known[at] == code, at, len(known))
        out[i : i + KERNEL_BLOCK] = np.add.reduceat(dense[at] * weight[:, None], np.searchsorted(row, np.arange(len(part))))
    return out


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear machine with a cost for each row; Newton steps. The last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = y * (z @ w) < 1
        a = z[on] * cost[on, None]
        fresh = np.linalg.solve(ridge + a.T @ z[on], a.T @ y[on])
        if np.allclose(fresh, w, atol=1e-9):
            break
        w = fresh
    return w


class Model:
    """Folded weights of the machine, and the curve that turns a decision into a score."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0):
        self.weights, self.bias, self.curve = weights, bias, np.zeros(3)
        self.memo: dict[str, float] = {}

    def decide(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for i in range(0, len(strings), BLOCK):  # features take some hundred bytes a letter
            row, code, weight = features(part := strings[i : i + BLOCK])
            out[i : i + BLOCK] = np.bincount(row, weight * self.weights[code], len(part))
        return out + self.bias

    def worst(self, texts: list[str]) -> np.ndarray:
        """The two highest decisions over the words of each text, FLOOR where there are fewer."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [words_of(t) for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.memo})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            made = [units(w) for w in part]
            flat = [u for us in made for u in us]
            scores = iter(self.decide(flat).tolist() if flat else [])
            self.memo.update((w, max((next(scores) for _ in us), default=FLOOR)) for w, us in zip(part, made, strict=True))
        memo, out = self.memo, np.full((len(texts), 2), FLOOR)
        for i, ws in enumerate(split):
            if f := [memo[w] for w in ws]:
                out[i, 0] = max(f)
                f.remove(out[i, 0])
                out[i, 1] = max(max(f, default=FLOOR), out[i, 0] - LONE)
        return np.maximum(out, FLOOR)

    def score(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1 for each text; 0 for one without letters."""
        if self.weights is None:
            return np.zeros(len(texts))
        f = self.worst(texts)
        p = 1 / (1 + np.exp(-np.clip(f @ self.curve[:-1] + self.curve[-1], -700, 700)))
        return np.where(f[:, 0] > FLOOR, p, 0.0)


def _train(positive: Counter, negative: Counter, seed: int) -> Model:
    """Train on words with their weights; either class weighs the same as a whole."""
    rng = np.random.default_rng(seed)
    pick = lambda xs, n: [x for x, _ in sorted(xs.items(), key=lambda x: (-x[1] * rng.random(), x[0]))[:n]]
    landmarks = sorted({*pick(positive, LANDMARKS // 2), *pick(negative, LANDMARKS // 2)})
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    strings = [*positive, *negative]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.array([n / positive.total() for n in positive.values()] + [n / negative.total() for n in negative.values()])
    w = _svm(kernel(strings, landmarks) @ root, y, cost * COST)
    row, code, weight = features(landmarks)
    return Model(np.bincount(code, weight * (root @ w[:-1])[row], SYMBOLS**3), float(w[-1]))


def _curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of f with a light ridge; Newton steps."""
    x = np.hstack([f, np.ones((len(f), 1))])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _cover(bags: list[list[str]], clean: Counter) -> Counter:
    """Words foreign to clean texts that together explain the toxic ones, the widest first.

    Each counts the toxic texts that no earlier one occurs in, so that copies of a toxic text don't
    turn all of its words into insults.
    """
    where: dict[str, set[int]] = {}
    for i, bag in enumerate(bags):
        for u in bag:
            if u not in clean:
                where.setdefault(u, set()).add(i)
    chosen, covered = Counter(), set()
    heap = [(-len(at), u) for u, at in where.items()]
    heapq.heapify(heap)
    while heap:
        gain, u = heapq.heappop(heap)
        fresh = len(where[u] - covered)
        if fresh < -gain:
            if fresh:
                heapq.heappush(heap, (-fresh, u))
            continue
        if fresh < 2 and chosen:
            break
        chosen[u] = fresh
        covered |= where[u]
    return chosen


def _clusters(bags: list[list[str]], bands: int = 20, rows: int = 6) -> list[int]:
    """A cluster number for each bag; near copies share one."""
    up = list(range(len(bags)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    scale = np.random.default_rng(3).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    met: dict = {}
    for i, bag in enumerate(bags):
        if not bag:
            continue
        h = np.array([zlib.crc32(u.encode()) * 0x9E3779B97F4A7C15 % 2**64 for u in bag], np.uint64)
        low = (h[None, :] * scale[:, None]).min(axis=1).reshape(bands, rows)
        for b in range(bands):
            j = met.setdefault((b, low[b].tobytes()), i)
            if (x := top(i)) != (y := top(j)):
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(bags))]


def _foreign(bags: list[list[str]], clean: Counter, n_clean: int) -> Counter:
    """Words foreign to clean texts, in more unlike toxic texts than chance explains (1 in 100,000)."""
    clusters = _clusters(bags)
    where: dict[str, set[int]] = {}
    for bag, c in zip(bags, clusters, strict=True):
        for u in bag:
            if u not in clean:
                where.setdefault(u, set()).add(c)
    n = len(set(clusters))
    least = max(3, math.log(1e-5) / math.log(n / (n + n_clean)))
    return Counter({u: len(at) for u, at in sorted(where.items()) if len(at) >= least})


def _machine(toxic: list[list[str]], clean: list[list[str]], rounds: int, seed: int) -> Model | None:
    """Alternate between training and letting every text name its worst word."""
    often = Counter(u for bag in clean for u in bag)
    every = sorted(often.keys() | {u for bag in toxic for u in bag})
    seeds = _foreign(toxic, often, len(clean))
    positive = _cover(toxic, often) | seeds
    if not positive or not often:
        return None
    rng = np.random.default_rng(seed)
    plain = sorted(often)
    background = {plain[i]: 1 for i in sorted(rng.permutation(len(plain))[:SAMPLE_WORDS])}
    hard: Counter = Counter()
    for k in range(rounds):
        negative = Counter({u: n * len(clean) / len(background) for u, n in background.items()})
        for u, n in hard.items():
            negative[u] += n / k
        model = _train(positive, negative, seed + k)
        f = dict(zip(every, model.decide(every).tolist(), strict=True))
        hard.update(max(bag, key=lambda u: (f[u], u)) for bag in clean if bag)
        named = [max(bag, key=lambda u: (f[u], u)) for bag in toxic if bag]
        positive = (Counter(u for u in named if f[u] > -0.5) | seeds) or positive
    return model


def fit_texts(toxic: list[str], clean: list[str], prior: float | None = None, rounds: int = 5, seed: int = 7) -> Model:
    """Fit on labelled texts; copies of a text count once. prior: the share of toxic texts where these come from.

    A quarter of the texts, if there are enough, is kept from the machine for fitting the curve.
    """
    toxic, clean = sorted(set(toxic), key=_digest), sorted(set(clean), key=_digest)
    made: dict[tuple[str, bool], list[str]] = {}  # words recur: each is cut up once, and texts share its strings

    def bag(text: str, views: bool) -> list[str]:
        words = {(w, views) for w in words_of(text)}
        made.update((w, units(*w)) for w in words if w not in made)
        return sorted({u for w in words for u in made[w]})

    apart = 4 if len(toxic) >= 80 and len(clean) >= 80 else 0
    first = lambda xs: [x for i, x in enumerate(xs) if not apart or i % apart]
    curve = lambda xs: xs[::apart] if apart else xs
    # insults are learnt from words as they are; clean texts show what any view of them may look like
    model = _machine([bag(t, False) for t in first(toxic)], [bag(t, True) for t in first(clean)], rounds, seed)
    if model is None:
        return Model(None)
    toxic, clean = curve(toxic), curve(clean)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    prior = prior or len(toxic) / len(y)
    weight = np.where(y > 0, prior / len(toxic), (1 - prior) / len(clean)) * len(y)
    model.curve = _curve(model.worst(toxic + clean), y, weight)
    model.memo = {}
    return model


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def in_fold(doc_id: Column) -> Column:
    """True for documents held out from all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n)))) if counts else None
    if not (counts.get(0) and counts.get(1)):
        return Model(None)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # drawn is bounded by `sample` for each class, whatever the size of the corpus
    rows = sorted((r.toxic, r.text) for r in texts.join(F.broadcast(drawn), "doc_id").select("toxic", "text").dropna().collect())
    return fit_texts([t for x, t in rows if x == 1], [t for x, t in rows if x == 0], counts[1] / (counts[0] + counts[1]))


def scorer(docs: DataFrame, model: Model):
    """A column function from text to score."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.fillna("").tolist()))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    score = scorer(docs, fit(docs, labels, id_col, text_col))
    doc_id = F.col(id_col).cast("long")
    scored = docs.select(doc_id.alias("doc_id"), F.coalesce(in_fold(doc_id), F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier calls toxic; columns as they are."""
    score = scorer(docs, fit(docs, labels, id_col, text_col))
    return docs.filter(score(F.col(text_col)) < 0.5)
