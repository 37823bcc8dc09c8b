"""Quality classifier by positive-unlabelled learning (operator 2).

A linear model over a document's average word features (the word, its shape, the
shape's trigrams, hashed) and its shares of repeated words minimises the non-negative unbiased risk
``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` with the logistic loss: P are
trusted positives (label 1), U are unlabelled web texts, and ``p`` is the estimated
class prior. Where the bracket falls below zero its gradient is climbed, not descended.
The prior comes from a first model of P against U: the least ratio of the tails of
U's and P's held-back scores, with a margin for chance (best bin estimation).

Training: at most ``POSITIVES`` labelled and ``UNLABELLED`` unlabelled documents, by a
hash of the id, a documented bound; on the driver. Positives are taken only where
crc32(doc_id as text) mod 5 is not 0; label 0 is never used. Scoring reads every whole
text in place; the model (``BUCKETS`` floats) is broadcast.

Defined cases: a null or empty text has no features and scores the bias; without
positives or unlabelled texts every score is the prior's default 0.5; repeated rows
score alike.
"""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import common
from lathework.llm.toxicity import held_out, labelled

BUCKETS, POSITIVES, UNLABELLED, STEPS = 1 << 15, 2000, 3000, 120
WIDTH = BUCKETS + 2
#: Shapes are made of so many characters at once, which bounds what is kept of them.
PART = 200
_RUNS = re.compile(r"(.)\1{2,}")


class _Marks(dict):
    """Letters as a or A, digits as 0, marks as they are, for ``str.translate``."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[point]


class Features:
    """Feature numbers of words: the word's own, then those of its shape, found once for each shape."""

    def __init__(self):
        self.marks, self.shapes = _Marks(), {}

    def shape(self, word: str) -> str:
        """The word's marks; runs are cut at three."""
        return _RUNS.sub(r"\1\1\1", word.translate(self.marks))

    def of_shape(self, shape: str) -> np.ndarray:
        if shape not in self.shapes:
            if len(self.shapes) > 50_000:
                self.shapes.clear()
            s = f"^{shape}$"
            names = [f"s:{s}"] + [f"t:{s[i : i + 3]}" for i in range(len(s) - 2)]
            self.shapes[shape] = np.array([zlib.crc32(n.encode()) % BUCKETS for n in names], np.int64)
        return self.shapes[shape]

    def of(self, word: str) -> np.ndarray:
        """A word's features; a long word's are those of all its parts of ``PART`` characters, and its own."""
        shapes = [self.of_shape(self.shape(word[i : i + PART])) for i in range(0, len(word), PART)]
        return np.append(np.concatenate(shapes), zlib.crc32(word.lower().encode()) % BUCKETS)


def whole_text(words: list[str]) -> list[tuple[int, float]]:
    """(feature number, value) of the text as a whole: repeated neighbours, repeated words."""
    n = len(words)
    again = sum(map(operator.eq, words, words[1:])) / n
    return [(BUCKETS, again), (BUCKETS + 1, 1 - len(set(words)) / n)]


class Sparse:
    """Average word features of texts, row by row."""

    def __init__(self, texts: list[str]):
        known: dict[str, np.ndarray] = {}
        features = Features().of
        rows, cols, values = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            if not words:
                continue
            parts, weights = [], []
            if len(known) > 50_000:
                known.clear()
            for w, n in counts.items():
                if w not in known:
                    known[w] = features(w)
                f = known[w]
                parts.append(f)
                weights.append(np.full(len(f), n / len(f) / len(words)))
            for number, value in whole_text(words):
                parts.append(np.array([number]))
                weights.append(np.array([value]))
            ids, place = np.unique(np.concatenate(parts), return_inverse=True)
            cols.append(ids.astype(np.int32))
            values.append(np.bincount(place, weights=np.concatenate(weights)).astype(np.float32))
            rows.append(np.full(len(ids), i, np.int32))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.n, self.rows, self.cols, self.values = len(texts), join(rows, np.int32), join(cols, np.int32), join(values, np.float32)

    def even(self) -> Sparse:
        """Every other text, from the first on."""
        out = Sparse([])
        keep = self.rows % 2 == 0
        out.n, out.rows, out.cols, out.values = (self.n + 1) // 2, self.rows[keep] // 2, self.cols[keep], self.values[keep]
        return out

    def dot(self, w):
        return np.bincount(self.rows, weights=self.values * w[self.cols], minlength=self.n)

    def back(self, g):
        return np.bincount(self.cols, weights=self.values * g[self.rows], minlength=WIDTH)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _adam(gradient, steps: int, rate: float = 0.3):
    """Weights and bias after ``steps`` of Adam on ``gradient(w, b)``."""
    w, b = np.zeros(WIDTH), 0.0
    m, v, mb, vb = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * 0.2 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def class_prior(positive: Sparse, unlabelled: Sparse, steps: int = 60) -> float:
    """The share of positives among the unlabelled, by best bin estimation on held-back halves."""
    if positive.n < 20 or unlabelled.n < 20:
        return 0.5
    p1, u1 = positive.even(), unlabelled.even()

    def gradient(w, b):
        ep = -(1 - _sigmoid(p1.dot(w) + b)) / p1.n
        eu = _sigmoid(u1.dot(w) + b) / u1.n
        return p1.back(ep) + u1.back(eu) + 1e-6 * w, ep.sum() + eu.sum()

    w, b = _adam(gradient, steps)
    zp = np.sort((positive.dot(w) + b)[1::2])
    zu = np.sort((unlabelled.dot(w) + b)[1::2])
    cuts = np.unique(np.quantile(np.concatenate([zp, zu]), np.linspace(0, 0.99, 200)))
    qp = 1 - np.searchsorted(zp, cuts) / len(zp)
    qu = 1 - np.searchsorted(zu, cuts) / len(zu)
    margin = np.sqrt(np.log(20) / 2 / len(zu)) + np.sqrt(np.log(20) / 2 / len(zp))
    good = qp > 0.1
    best = np.argmin(qu[good] / qp[good] + margin / qp[good])
    return float(np.clip(qu[good][best] / qp[good][best], 0.05, 0.98))


def train(texts_p: list[str], texts_u: list[str], steps: int = STEPS, prior: float | None = None):
    """(weights, bias, prior) that minimise the non-negative unbiased risk."""
    if not texts_p or not texts_u:
        return np.zeros(WIDTH), 0.0, 0.5
    p, u = Sparse(texts_p), Sparse(texts_u)
    if prior is None:
        prior = class_prior(p, u)

    def gradient(w, b):
        fp, fu = p.dot(w) + b, u.dot(w) + b
        bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        right_p = -prior * (1 - _sigmoid(fp)) / p.n  # of p E_P[l(f)]
        wrong_p, wrong_u = -prior * _sigmoid(fp) / p.n, _sigmoid(fu) / u.n  # of the bracket
        if bracket < 0:
            right_p, wrong_p, wrong_u = np.zeros(p.n), -wrong_p, -wrong_u
        return p.back(right_p + wrong_p) + u.back(wrong_u) + 1e-5 * w, (right_p + wrong_p).sum() + wrong_u.sum()

    w, b = _adam(gradient, steps)
    return w, float(b), prior


class Scorer:
    """Scores of whole texts; what a word and a shape add is found once."""

    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias, self.features = w, bias, Features()
        self.pulls: dict[str, float] = {}
        self.shapes: dict[str, tuple[float, int]] = {}

    def pull(self, word: str) -> float:
        shape = self.features.shape(word)
        if shape not in self.shapes:
            if len(self.shapes) > 50_000:
                self.shapes.clear()
            own = self.features.of_shape(shape)
            self.shapes[shape] = float(self.w[own].sum()), len(own)
        total, n = self.shapes[shape]
        return (total + self.w[zlib.crc32(word.lower().encode()) % BUCKETS]) / (n + 1)

    def score(self, text: str) -> float:
        words = text.split()
        if len(self.pulls) > 300_000:
            self.pulls.clear()
        for x in set(words):
            if x not in self.pulls:
                self.pulls[x] = float(self.pull(x))
        total = 0.0
        if words:
            total = sum(map(self.pulls.__getitem__, words)) / len(words)
            total += sum(self.w[number] * value for number, value in whole_text(words))
        return float(_sigmoid(total + self.bias))


def _scorer(model):
    def scan(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return scan


def unlabelled_texts(docs: DataFrame, labels: DataFrame, n: int) -> list[str]:
    """Texts of at most ``n`` documents without a label, by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    texts = common.texts_of(docs)
    free = texts.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left_anti")
    picked = free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = texts.join(F.broadcast(picked), "doc_id").collect()  # at most n ids
    return [r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def positive_unlabelled(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    texts, y = labelled(docs, labels, "quality", (0, POSITIVES))
    trusted = [t for t, v in zip(texts, y) if v == 1]
    w, bias, _ = train(trusted, unlabelled_texts(docs, labels, UNLABELLED))
    model = docs.sparkSession.sparkContext.broadcast((w, bias))
    found = common.texts_of(docs).mapInArrow(_scorer(model), "doc_id long, score double")
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op2_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return positive_unlabelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
