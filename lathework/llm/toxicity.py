"""Toxicity by subword-bag embeddings under a linear softmax (operator 10).

A word is the average of the vectors of its character n-grams (3 to 5, between word
marks, hashed into buckets) and of itself; a passage of ``PASSAGE`` words is the
average of its words; a linear softmax over the passage gives its probability. A
document's score is that of its most toxic passage, so one insult in a long text is
not thinned out. Vectors and softmax are trained jointly in numpy (Adagrad, generalised cross-entropy) on the
document's label through that passage (in the first two rounds through the one with the
word of greatest odds). Unseen misspellings share n-gram vectors.

Training: the labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``SAMPLE`` of either label by a hash of the id, a documented bound; it runs on the
driver. Scoring reads every whole text, in place, with the model broadcast (its size
is fixed by ``BUCKETS`` x ``DIM``). lang, source, doc_id and labels are no inputs.

Defined cases: a null or empty text scores as one passage without words (the
softmax's bias); labels that are null are left out; without labels of both classes
every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lathework.llm import common
from lathework.llm.kernels import SpanHash, mix

#: Buckets are numbered in 16 bits.
BUCKETS, DIM, PASSAGE, EPOCHS, MOST_EPOCHS = 1 << 16, 8, 24, 10, 60
#: Documents in which a subword must stand to be learnt, and the pull of vectors to zero.
LEAST, DECAY = 3, 2e-4
#: Squares that a bucket's steps start from: a rare subword moves little.
DAMPING = 1e-4
#: The power by which a document's own probability weighs it (generalised cross-entropy).
TRUST = 0.7
#: At most so many labelled documents of label 0 and of label 1 are learnt from.
SAMPLE = (6000, 2500)
WORD = re.compile(r"[^\W\d_]+")


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word and of its n-grams, end to end, and how many each word has."""
    parts = [_subwords(words[i : i + 10_000], buckets) for i in range(0, len(words), 10_000)]
    if not parts:
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    return np.concatenate([flat for flat, _ in parts]), np.concatenate([sizes for _, sizes in parts])


def _subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(words)), lengths)
    found = [(np.arange(len(words)), SpanHash().of_points(points, ends - lengths, ends))]
    total = mix(points, 3)
    for n in range(2, 6):
        total = mix(total[:-1] * np.uint64(0xD6E8FEB86659FD93) + points[n - 1 :], n) if len(total) > 1 else total[:0]
        if n >= 3:
            inside = of[: len(total)] == of[n - 1 :]
            found.append((of[: len(total)][inside], total[inside]))
    owner = np.concatenate([o for o, _ in found])
    order = np.argsort(owner, kind="stable")
    hashes = np.concatenate([h for _, h in found])[order]
    return (hashes % np.uint64(buckets)).astype(np.uint16), np.bincount(owner, minlength=len(words))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; a run of over 64 letters is cut at every 64th."""
    out = WORD.findall(text.lower())
    if any(len(w) > 64 for w in out):
        out = [w[i : i + 64] for w in out for i in range(0, len(w), 64)]
    return out


class Model:
    """Vectors of the buckets, and the softmax of two classes as one difference vector and bias."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, bias: float):
        self.vectors, self.weight, self.bias = vectors, weight, bias
        self.pull = vectors @ weight  # what a bucket adds, before averages

    def words(self, words: list[str]) -> list[float]:
        """The pull of each word: the average over its subwords."""
        flat, sizes = subwords(words, len(self.pull))
        if not len(flat):
            return []
        return (np.add.reduceat(self.pull[flat], np.cumsum(sizes) - sizes) / sizes).tolist()

    def score(self, pulls: np.ndarray, passage: int = PASSAGE) -> float:
        if not len(pulls):
            return float(1 / (1 + np.exp(-np.clip(self.bias, -50, 50))))
        at = np.arange(0, len(pulls), passage)
        means = np.add.reduceat(pulls, at) / np.diff(np.append(at, len(pulls)))
        return float(1 / (1 + np.exp(-np.clip(means.max() + self.bias, -50, 50))))


def _odds(docs: list[np.ndarray], y: np.ndarray, n_words: int) -> np.ndarray:
    """Log odds of each word's share of toxic over clean documents: which passages to look at first."""
    seen = np.zeros((2, n_words))
    for d, label in zip(docs, y):
        seen[int(label), np.unique(d)] += 1
    return np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))


def _carried(docs: list[np.ndarray], flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which buckets stand in ``least`` documents or more; the others, a document's own, keep a vector of zeros."""
    n = np.zeros(BUCKETS, np.int64)
    for d in docs:
        own = np.unique(d)
        at = np.arange(int(sizes[own].sum())) + np.repeat(begin[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own])
        n[np.unique(flat[at])] += 1
    return n >= least


def train(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 11, least: int = LEAST, decay: float = DECAY) -> Model:
    """Joint training; each step follows the top passage of 64 documents.

    Only subwords of ``least`` documents or more are learnt, so a document's own words can't explain its label.
    """
    rng = np.random.default_rng(seed)
    epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, 60_000 // max(1, len(texts))))  # few texts are seen more often
    vectors = np.zeros((BUCKETS, DIM), np.float32)  # a subword that is never learnt adds nothing
    weight = (rng.random(DIM) - 0.5).astype(np.float32)
    bias = 0.0
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    flat, sizes = subwords(list(number))
    del number
    begin = np.cumsum(sizes) - sizes
    y = np.array(labels, np.float32)
    share = max(1e-3, float(y.mean()))
    gains = np.where(y == 1, (0.5 / share) ** 0.5, (0.5 / max(1e-3, 1 - share)) ** 0.5).astype(np.float32)
    sq_v, sq_w, sq_b = np.full((BUCKETS, DIM), DAMPING, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    usable = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
    carried = _carried(docs, flat, begin, sizes, least)
    odds = _odds(docs, y, len(sizes))
    for epoch in range(epochs):
        # the pull of every word: at first its odds, then by the vectors as they stand
        pull = np.add.reduceat((vectors @ weight)[flat], begin) / sizes if len(flat) else np.empty(0)
        warm = epoch < 2
        rng.shuffle(usable)
        for s in range(0, len(usable), 64):
            batch = usable[s : s + 64]
            tops = []
            for i in batch:
                d = docs[i]
                at = np.arange(0, len(d), PASSAGE)
                if warm and y[i] == 1:
                    a = at[int(np.maximum.reduceat(odds[d], at).argmax())]
                else:
                    means = np.add.reduceat(pull[d], at) / np.diff(np.append(at, len(d)))
                    a = at[int(means.argmax())]
                tops.append(d[a : a + PASSAGE])
            lengths = np.array([len(t) for t in tops])
            own = np.concatenate(tops)
            doc_of = np.repeat(np.arange(len(tops)), lengths)
            gram_n = sizes[own]
            at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(gram_n)[:-1]]), gram_n) + np.arange(gram_n.sum())
            ids = flat[at]
            scale = np.repeat(1.0 / (gram_n * lengths[doc_of]), gram_n).astype(np.float32)
            owner = np.repeat(doc_of, gram_n)
            of_doc = np.searchsorted(owner, np.arange(len(tops)))
            hidden = np.add.reduceat(vectors[ids] * scale[:, None], of_doc, axis=0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ weight + bias, -50, 50)))
            error = (p - y[batch]) * gains[batch]
            if not warm:  # a document far from its label counts less: some labels are wrong
                error *= np.where(y[batch] == 1, p, 1 - p) ** TRUST
            g_w, g_b = error @ hidden, float(error.sum())
            used, place = np.unique(ids, return_inverse=True)
            pulled = np.bincount(place, weights=scale * error[owner], minlength=len(used)).astype(np.float32)
            g_v = (pulled[:, None] * weight[None, :] + decay * vectors[used]) * carried[used, None]
            sq_v[used] += g_v * g_v
            vectors[used] -= 0.5 * g_v / np.sqrt(sq_v[used])
            sq_w += g_w * g_w
            weight -= (0.2 * g_w / np.sqrt(sq_w)).astype(np.float32)
            sq_b += g_b * g_b
            bias -= 0.2 * g_b / sq_b**0.5
    return Model(vectors, weight, bias)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: tuple[int, int]) -> tuple[list[str], list[int]]:
    """Texts and labels of the learning folds: at most ``sample[v]`` of label v, by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1) AND crc32(cast(doc_id AS string)) % 5 <> 0")
    picked = None
    for value in (0, 1):
        own = known.filter(F.col("label") == value).dropDuplicates(["doc_id"])
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[value])
        picked = own if picked is None else picked.union(own)
    rows = (
        common.texts_of(docs)
        .join(F.broadcast(picked), "doc_id")  # at most sum(sample) rows of two numbers
        .select("doc_id", "text", "label")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text, r.label))
    return [r.text for r in rows], [r.label for r in rows]


def held_out() -> F.Column:
    """Whether a document lies in the fold that is never learnt from; a null id does not."""
    return F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), F.lit(False))


def _scorer(model):
    def scan(batches):
        own = Model(*model.value)
        pulls: dict[str, float] = {}
        for batch in batches:
            scores = []
            for lo in range(0, batch.num_rows, 200):
                texts = [words_of(t or "") for t in batch.column(1).slice(lo, 200).to_pylist()]
                if len(pulls) > 300_000:
                    pulls.clear()
                new = [w for w in set().union(*texts) if w not in pulls]
                pulls.update(zip(new, own.words(new)))
                scores += [own.score(np.fromiter(map(pulls.__getitem__, w), float, len(w))) for w in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["kept", "score"])

    return scan


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    texts, y = labelled(docs, labels, "toxic", sample)
    if len(set(y)) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(DIM, np.float32), -50.0)
    return train(texts, y)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``kept`` (the whole row, as a struct, so no column's name can clash) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.weight, model.bias))  # BUCKETS x DIM floats, 2 MB
    rows = docs.select(F.struct("*").alias("kept"), F.col("text").alias("text"))
    schema = StructType().add("kept", rows.schema["kept"].dataType).add("score", "double")
    return rows.mapInArrow(_scorer(shared), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scored(ids, fitted(docs, labels)).select("kept.doc_id", "score")
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
