"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums over their common subsequences of ``LENGTH``
characters, each weighted by ``DECAY`` to the stretch it spans in both, so inserted
or left-out characters cost a factor, not the match. Nystroem: a word's features
are its normalised kernel values with the landmarks times K_zz^(-1/2), and a
linear support vector machine on them approximates the machine on the kernel.

Labels are those of whole texts, of which one insult is enough. Training first
finds families of words, by shared character runs, that are typical of toxic
texts, and sets their members against words of clean texts, hardest first, in
three rounds; a member that clean texts hold too counts on both sides, by its
frequency in either. A text's score is the highest value of its words, turned into a
probability by an isotonic fit on a third of the sample that the machine has not
seen. Words: white-space tokens, letters only, lower-cased; letters that stand
alone in a row are also read as one word.

Fitted on a bounded sample: per label the ``DOCS_PER_LABEL`` training texts with
the smallest hash of the id among those of at most ``MAX_TRAIN_BYTES`` bytes.
Every text is scored whole.

Defined cases: null, empty or letterless text gets the score of a text without
words (the lowest); without training rows of both labels every score is 0; several label rows
of an id count as their maximum; rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, table

LENGTH, DECAY = 3, 0.6
LANDMARKS, NEUTRAL, ALIKE = 64, 16, 0.8
#: What a character run needs to found a family of insults; landmarks taken from each family.
EVIDENCE, ODDS, MEMBERS = 20.0, 8.0, 4
DOCS_PER_LABEL = 1500
MAX_TRAIN_BYTES = 8_192
THRESHOLD = 0.7
#: Longer words are scored in overlapping pieces of this many letters.
PIECE = 20
NO_WORDS = -4.0
CACHED = 200_000
_SPREAD = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, with a mark before the first letter."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return np.hstack([np.ones((len(words), 1), np.uint32), raw])


@cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of all subsequences of LENGTH = 3 of n characters, and DECAY to the stretch k - i + 1."""
    i, j, k = np.array(list(combinations(range(n), LENGTH)), np.int64).reshape(-1, LENGTH).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def self_kernel(c: np.ndarray) -> np.ndarray:
    """k(w, w) for rows of code points: the sum over distinct subsequences of their squared weights."""
    n = c.shape[1]
    i, j, k, weight = triples(n)
    _, c = np.unique(c, return_inverse=True)
    c = c.reshape(-1, n).astype(np.int64)
    size = int(c.max()) + 1
    u = (c[:, i] * size + c[:, j]) * size + c[:, k]
    order = np.argsort(u, axis=1)
    u = np.take_along_axis(u, order, axis=1)
    total = np.cumsum(weight[order].astype(np.float64), axis=1)
    last = np.ones(u.shape, bool)
    last[:, :-1] = u[:, 1:] != u[:, :-1]
    row, at = np.nonzero(last)
    sums = total[row, at]
    sums[1:] -= np.where(row[1:] == row[:-1], sums[:-1].copy(), 0)
    return np.bincount(row, weights=sums * sums, minlength=len(c)).astype(np.float32)


def by_length(words: list[str], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, code points) of words of equal length, in blocks of bounded size."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        block = max(1, most // max(1, len(triples(int(n) + 1)[0])))
        for a in range(0, len(at), block):
            part = at[a : a + block]
            yield part, codes([words[x] for x in part])


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text as written, and spread-out ones joined."""
    if not text:
        return set()
    out = set(text.split())
    for m in _SPREAD.finditer(text):
        out.add("".join(m.group().split()))
    return out


def plain(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[a : a + PIECE] for a in range(0, len(word) - PIECE // 2, PIECE // 2)]


class ToxicityModel:
    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        points = np.unique(np.concatenate([codes([z])[0] for z in landmarks]))
        self.points = points  # characters of landmarks; all others match nothing
        n = len(points) + 1
        table = np.zeros((n**3, len(landmarks)), np.float32)
        norm = np.empty(len(landmarks), np.float32)
        for z, word in enumerate(landmarks):
            c = codes([word])
            i, j, k, weight = triples(c.shape[1])
            np.add.at(table[:, z], self._triple_codes(c)[0], weight)
            norm[z] = np.sqrt(self_kernel(c)[0])
        #: Weight of every subsequence in every landmark, over the landmark's norm.
        used = np.flatnonzero(table.any(axis=1))
        self.row = np.zeros(n**3, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.vstack([np.zeros((1, len(landmarks)), np.float32), table[used] / norm])
        kzz = self.similar(landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((kzz + kzz.T) / 2)
        self.project = (vectors / np.sqrt(np.maximum(values, 1e-6))).astype(np.float32)
        self.weights, self.bias = np.zeros(len(landmarks), np.float32), 0.0
        self.knots = (np.zeros(1), np.full(1, 0.5))
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _triple_codes(self, c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, c), len(self.points) - 1)
        own = np.where(self.points[at] == c, at + 1, 0).astype(np.int64)
        n = len(self.points) + 1
        i, j, k, _ = triples(c.shape[1])
        out = (own[:, i] * n + own[:, j]) * n + own[:, k]
        out[(own[:, i] == 0) | (own[:, j] == 0) | (own[:, k] == 0)] = 0
        return out

    def _sums(self, words: list[str], values: np.ndarray) -> np.ndarray:
        """Per word the sum over its subsequences of weight times ``values`` (one row per known subsequence), over its norm."""
        out = np.zeros((len(words), values.shape[1]), values.dtype)
        for at, c in by_length(words, (1 << 20) // values.shape[1]):
            if c.shape[1] < LENGTH:
                continue
            weight = triples(c.shape[1])[3]
            rows = self.row[self._triple_codes(c)]
            if values.shape[1] == 1:
                # Summed row by row in double precision, so a word's value does not depend on the words beside it.
                found = (values[rows, 0] * weight.astype(np.float64)).sum(axis=1)[:, None]
            else:
                found = np.einsum("btz,t->bz", values[rows], weight)
            out[at] = found / np.sqrt(self_kernel(c))[:, None]
        return out

    def similar(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values with every landmark."""
        return self._sums(words, self.table)

    def features(self, words: list[str]) -> np.ndarray:
        return self.similar(words) @ self.project

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values, by folding the machine's weights into one value per subsequence."""
        folded = (self.table @ (self.project @ self.weights)[:, None]).astype(np.float64)
        return np.round(self._sums(words, folded)[:, 0] + self.bias, 9)

    def learn(self, words: set[str]) -> None:
        """Scores of words as written, into the bounded table."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = words
        bare = {w: plain(w) for w in new}
        cut = {p for p in bare.values() if len(p) >= LENGTH}
        parts = sorted({x for p in cut for x in pieces(p)})
        value = dict(zip(parts, self.decide(parts).tolist()))
        for w, p in bare.items():
            self.known[w] = max(map(value.__getitem__, pieces(p))) if p in cut else NO_WORDS

    def text_values(self, texts: list[str | None]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        out = np.full(len(texts), NO_WORDS)
        for a in range(0, len(texts), 128):
            self.learn(set().union(*sets[a : a + 128]))
            get = self.known.__getitem__
            for i in range(a, min(a + 128, len(texts))):
                if sets[i]:
                    out[i] = max(map(get, sets[i]))
        return out

    def probability(self, values: np.ndarray) -> np.ndarray:
        """Calibrated probability; a millionth of the logistic of the value keeps the order inside a step."""
        order = 1 / (1 + np.exp(-np.clip(values, -500, 500)))
        return np.interp(values, *self.knots) * (1 - 1e-6) + 1e-6 * order


def _without_copies(bags: list[set[str]]) -> list[set[str]]:
    """Bags without those that agree with an earlier one in half of 8 minimum hashes: copies would make rare words look typical."""
    seen: set[tuple[int, int]] = set()
    out = []
    for bag in bags:
        h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in bag], np.uint64)
        marks = [(k, int(((h * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min())) for k in range(8)]
        if sum(m in seen for m in marks) < 4:
            out.append(bag)
        seen.update(marks)
    return out


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, reg: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine with bias, by Newton steps with halving."""
    xb = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = weight / weight.sum()
    ridge = reg * np.r_[np.ones(x.shape[1]), 1e-3]
    loss = lambda w: weight @ np.maximum(1 - y * (xb @ w), 0) ** 2 + ridge @ (w * w)
    w = np.zeros(xb.shape[1])
    for _ in range(rounds):
        slack = np.maximum(1 - y * (xb @ w), 0)
        active = xb[slack > 0]
        grad = -2 * (xb.T @ (weight * y * slack)) + 2 * ridge * w
        hess = 2 * (active * weight[slack > 0, None]).T @ active + 2 * np.diag(ridge) + 1e-9 * np.eye(len(w))
        step, now = np.linalg.solve(hess, grad), loss(w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if size <= 1e-4 or now - loss(w) < 1e-9:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def _ratio(t: int, c: int, share: float) -> float:
    """Log-likelihood ratio of t toxic and c clean texts against ``share`` toxic ones; 0 if toxic ones are not ODDS times as frequent."""
    if t * (1 - share) < ODDS * (c + 0.5) * share:
        return 0.0
    n = t + c
    return 2 * (t * np.log(t / (n * share)) + (c * np.log(c / (n * (1 - share))) if c else 0.0))


def _insults(toxic: list[set[str]], clean: list[set[str]]) -> list[list[str]]:
    """Families of words typical of toxic texts: words that share a character run of 4 or 5, strongest family first.

    The run with the strongest evidence is taken, its words are set aside, and
    the evidence of the other runs is counted again without them, so a piece of
    an insult does not make other words that hold it look like insults.
    """
    share = len(toxic) / (len(toxic) + len(clean))
    counts = []
    for docs in (toxic, clean):
        n: Counter = Counter()
        for words in docs:
            n.update({r for w in words for r in _runs(w)})
        counts.append(n)
    strong = {r for r, v in counts[0].items() if _ratio(v, counts[1][r], share) >= EVIDENCE}
    places: dict[str, list[tuple[int, str]]] = {r: [] for r in strong}
    for i, words in enumerate([*toxic, *clean]):
        for w in words:
            for r in strong & _runs(w):
                places[r].append((i, w))

    def evidence(r: str) -> float:
        docs = {i for i, _ in places[r]}
        t = sum(i < len(toxic) for i in docs)
        return _ratio(t, len(docs) - t, share) if t else 0.0

    value = {r: evidence(r) for r in strong}
    out = []
    while value:
        best = max(value, key=lambda r: (value[r], len(r), r))
        if value[best] < EVIDENCE:
            break
        family = Counter(w for i, w in places[best] if i < len(toxic))
        gone = {w for _, w in places[best]}
        out.append([w for w, _ in sorted(family.items(), key=lambda x: (-x[1], x[0]))])
        del value[best]
        for r in {r for w in gone for r in _runs(w)} & value.keys():
            places[r] = [(i, w) for i, w in places[r] if w not in gone]
            value[r] = evidence(r)
    return out


def _runs(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}


def fit(texts: list[str], labels: list[int], clean_share: float) -> ToxicityModel | None:
    """Model from labelled texts; ``clean_share``: clean texts per toxic text in the training rows, for the calibration."""
    fitted = [i for i in range(len(texts)) if i % 3 != 2] if min(sum(labels), len(labels) - sum(labels)) >= 9 else range(len(texts))
    bags = [{p for w in words_of(t) for p in pieces(plain(w)) if len(p) >= LENGTH} for t in texts]
    toxic = _without_copies([bags[i] for i in fitted if labels[i] and bags[i]])
    clean = [bags[i] for i in fitted if not labels[i]]
    if not toxic or not any(clean):
        return None
    seen = Counter(w for b in clean for w in b)
    often = Counter(w for b in toxic for w in b)
    # Share of a word's evidence that is toxic, by its frequency in either kind of text.
    part = lambda w: often[w] / (often[w] + seen[w] * len(toxic) / len(clean))
    families = _insults(toxic, clean)
    typical = {w: part(w) for family in families for w in family}
    families = [[w for w in family if typical[w] >= 0.5] for family in families]
    neutral = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 4][:NEUTRAL]
    ranked = [w for k in range(MEMBERS) for family in families for w in family[k : k + 1]]
    if not ranked:  # too few texts to tell: the words that only toxic texts hold
        ranked = sorted((w for w in often if w not in seen), key=lambda w: (-often[w], w))[:LANDMARKS] or sorted(often)[:LANDMARKS]
        typical = {w: part(w) for w in ranked}
    picked = _spread_out(ranked, LANDMARKS)
    model = ToxicityModel(picked + [w for w in neutral if w not in picked])
    witness, n = zip(*((w, often[w] * v) for w, v in sorted(typical.items())))
    vocabulary = sorted(seen)
    rng = np.random.default_rng(11)
    hard = [vocabulary[i] for i in rng.choice(len(vocabulary), min(4000, len(vocabulary)), replace=False)]
    for _ in range(3):
        x = model.features([*witness, *hard])
        y = np.r_[np.ones(len(witness)), -np.ones(len(hard))]
        against = np.array([1 - typical.get(w, 0.0) for w in hard])
        weight = np.r_[np.array(n) / sum(n), against / max(against.sum(), 1e-9)]
        model.weights, model.bias = _linear_svm(x, y, weight)
        scores = model.decide(vocabulary)
        top = np.argsort(-scores)[:2000]
        hard = sorted(set(hard) | {vocabulary[i] for i in top})
        model.known.clear()
    held = [i for i in range(len(texts)) if i % 3 == 2]
    v, y = model.text_values([texts[i] for i in held]), np.array([labels[i] for i in held])
    model.knots = _calibrate(v, y, clean_share)
    return model


def _spread_out(words: list[str], n: int) -> list[str]:
    """The first words that are not much alike: normalised kernel of at most ALIKE with those before."""
    out: list[str] = []
    like = np.zeros(len(words))
    for _ in range(n):
        free = np.flatnonzero(like <= ALIKE)
        if not len(free):
            break
        out.append(words[free[0]])
        like = np.maximum(like, ToxicityModel([words[free[0]]]).similar(words)[:, 0])
        like[free[0]] = 2
    return out


def _calibrate(v: np.ndarray, y: np.ndarray, clean_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (value, probability): isotonic fit of the label, clean texts weighing as often as they occur."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    order = np.argsort(v, kind="stable")
    weight = np.where(y[order] == 1, 1.0, clean_share * pos / neg)
    blocks: list[list[float]] = []  # weight of label 1, weight, least and greatest value
    for w, label, x in zip(weight.tolist(), y[order].tolist(), v[order].tolist()):
        blocks.append([w * label, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            one, all_, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + one, blocks[-1][1] + all_, blocks[-1][2], high]
    knots = []
    for one, all_, low, high in blocks:
        p = (one + 0.25) / (all_ + 0.5)
        knots += [(low, p), (high + 1e-9, p)]
    x, p = zip(*knots)
    return np.array(x), np.maximum.accumulate(np.array(p))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    lab = lab.groupBy("i").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t").between(1, MAX_TRAIN_BYTES))
    order = Window.partitionBy("y").orderBy(F.xxhash64("i"), "i")
    rows = texts.select("i").distinct().join(lab, "i")
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    # At most DOCS_PER_LABEL ids of either label.
    chosen = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= DOCS_PER_LABEL).select("i", "y")
    picked = texts.join(F.broadcast(chosen), "i").toPandas().sort_values(["i", "t"])
    if not counts.get(1):
        return None
    return fit(picked["t"].tolist(), picked["y"].tolist(), counts.get(0, 0) / counts[1])


def toxicity_column(spark, model: ToxicityModel | None, text: Column) -> Column:
    """Score (0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in batches:
            yield pd.Series(np.zeros(len(s)) if m is None else m.probability(m.text_values(s.tolist())))
        if m is not None:
            m.known.clear()
        release()

    return score(text.cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), toxicity_column(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
