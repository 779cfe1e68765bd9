"""Toxicity scores from subword bags averaged into a linear softmax, trained in numpy.

A word is the average of the vectors of its character n-grams and of itself, all
hashed into one table, so an unseen misspelling shares most of them.  A segment
is the average of its words; a text scores as its worst segment.  Vectors and
softmax weights are learned together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import batches_of, rows_of

#: Bound of the training sample: labelled rows of each class, and characters of a row that may be one of them.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
BUCKETS, SIZE = 1 << 17, 4
#: Subwords in fewer texts of the sample than this, or this share of them, learn nothing: they would only be learnt by heart.
LEAST_TEXTS, LEAST_SHARE = 4, 0.003
GRAMS = (3, 4, 5)
SEGMENT = 24
STEPS, RATE, DECAY = 60, 0.3, 3e-5
#: Words whose scores a task remembers.
REMEMBERED = 400_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’–—…¡¿"


def subwords(token: str) -> list[int]:
    """Hash buckets of a word and its n-grams, edges marked."""
    word = "<" + (token.strip(_EDGE) or token) + ">"
    ascii_only = word.isascii()
    if ascii_only:
        word = word.encode("ascii")
    grams = {word}
    for n in GRAMS:
        grams.update([word[i : i + n] for i in range(len(word) - n + 1)])
    if not ascii_only:
        grams = [g.encode("utf-8") for g in grams]
    return [crc % BUCKETS for crc in sorted(map(zlib.crc32, grams))]


def segments(n: int) -> np.ndarray:
    """Starts of the segments of n words; the last one takes what is left over."""
    return np.arange(max(1, n // SEGMENT)) * SEGMENT


class Model:
    """Scores of subwords (how much they speak for label 1) and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scorer(self):
        seen: dict[str, float] = {}
        weight, bias = self.weight.tolist(), self.bias

        def word(token: str) -> float:
            own = subwords(token)
            return sum(map(weight.__getitem__, own)) / len(own)

        def score(text: str) -> float:
            tokens = text.lower().split()
            if not tokens:
                return _sigmoid(bias)
            if len(seen) > REMEMBERED:
                seen.clear()
            for t in set(tokens).difference(seen):
                seen[t] = word(t)
            values = np.fromiter(map(seen.__getitem__, tokens), np.float64, len(tokens))
            starts = segments(len(tokens))
            sizes = np.diff(np.append(starts, len(tokens)))
            return _sigmoid(float((np.add.reduceat(values, starts) / sizes).max()) + bias)

        return score


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -60.0), 60.0))))


def train(rows: list[tuple[str, int]], rate: float) -> Model:
    """Fit by full-batch Adam on segments that carry the label of their text.

    Clean segments of a toxic text look like those of the others and settle near
    even odds; what only toxic texts hold stands out.  A scale and a bias for the
    worst segment of a text are fitted last.
    `rate` is the share of label 1 among all labelled rows; the bias is moved to it.  With one class only, every text scores `rate`.
    """
    rows = [(t.lower().split(), y) for t, y in rows]
    rows = [r for r in rows if r[0]]
    y = np.array([label for _, label in rows], np.float64)
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    number: dict[str, int] = {}
    tokens = np.array([number.setdefault(t, len(number)) for words, _ in rows for t in words], np.int64)
    bags = [subwords(t) for t in number]
    sizes = np.array([len(b) for b in bags])
    flat = np.concatenate([np.array(b, np.int64) for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    text_of = np.repeat(np.arange(len(rows)), [len(words) for words, _ in rows])
    pairs = np.unique(text_of * len(number) + tokens)  # each word once for a text
    texts_with = np.zeros(BUCKETS, np.int64)
    by_word_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for text in np.split(pairs % len(number), np.flatnonzero(np.diff(pairs // len(number))) + 1):
        texts_with[np.unique(np.concatenate([flat[by_word_starts[w] : by_word_starts[w] + sizes[w]] for w in text]))] += 1
    learns = texts_with[flat] >= max(LEAST_TEXTS, LEAST_SHARE * len(rows))
    flat, owner = flat[learns], owner[learns]
    if not len(flat):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    used, flat = np.unique(flat, return_inverse=True)  # only these rows of the table learn
    lengths = np.array([len(words) for words, _ in rows])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    starts = np.concatenate([b + segments(n) for b, n in zip(begins, lengths)])
    counts = np.array([len(segments(n)) for n in lengths])
    seg_size = np.diff(np.append(starts, len(tokens)))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    seg_of_token = np.repeat(np.arange(len(starts)), seg_size)

    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (len(used), SIZE)).astype(np.float32)
    weights = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seg_y = np.repeat(y, counts)
    share = np.where(seg_y == 1, 0.5 / (seg_y == 1).sum(), 0.5 / (seg_y == 0).sum())
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, weights, bias)]
    words = np.zeros((len(bags), SIZE), np.float32)

    def means() -> np.ndarray:
        for k in range(SIZE):
            words[:, k] = np.bincount(owner, vectors[flat, k], len(bags)) / sizes
        logits = words @ weights
        return np.add.reduceat((logits[:, 1] - logits[:, 0])[tokens], starts) / seg_size

    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(means() + bias[1] - bias[0], -60, 60)))
        error = (p - seg_y) * share  # softmax of two classes: the same error, signs opposed
        by_word = np.bincount(tokens, (error / seg_size)[seg_of_token], len(bags))
        slope = np.stack([-by_word, by_word], 1).astype(np.float32)
        d_weights = words.T @ slope
        d_words = (slope @ weights.T) / sizes[:, None]
        d_vectors = np.stack([np.bincount(flat, d_words[owner, k], len(used)) for k in range(SIZE)], 1).astype(np.float32)
        d_bias = np.array([-error.sum(), error.sum()], np.float32)
        for param, slope_, (m, v) in zip((vectors, weights, bias), (d_vectors, d_weights, d_bias), state):
            slope_ = slope_ + DECAY * param * (param is not bias)
            m += 0.1 * (slope_ - m)
            v += 0.001 * (slope_ * slope_ - v)
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    scale, shift = _calibrate(np.maximum.reduceat(means(), first), y)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = scale * (vectors @ (weights[:, 1] - weights[:, 0]))
    return Model(table, shift + prior)


def _calibrate(tops: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the worst segments, classes weighed alike, slightly damped."""
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    spread = tops.std() or 1.0
    x = np.stack([tops / spread, np.ones_like(tops)], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.5 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        beta -= np.linalg.solve(curve, slope)
    return float(beta[0] / spread), float(beta[1])


def held_out(doc: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    The sample takes the SAMPLE rows of each label with the smallest hash of their
    id among texts of at most SAMPLE_CHARS characters.  Null labels and ids do not
    count; contradicting labels of one id count as 1.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    short = documents.select("doc_id", F.char_length("text").alias("size")).where(F.col("size").between(1, SAMPLE_CHARS)).select("doc_id").distinct()
    share = known.agg(F.avg("label")).first()[0] or 0.0
    usable = known.join(short, "doc_id")
    picked = [usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = documents.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.collect()], "id long, label int")
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    rows = rows.where(F.char_length("text").between(1, SAMPLE_CHARS)).select("id", "label", "text").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = sorted((r.id, r.text, r.label) for r in rows.collect())
    return train([(t, y) for _, t, y in found], share)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    A null or empty text has no words and scores the bias alone.  Repeated rows
    and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.scorer()
        return batches_of(((doc, judge(text or "")) for doc, text in rows_of(batches)), SCORED)

    out = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
