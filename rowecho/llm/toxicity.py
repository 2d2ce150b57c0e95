"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a stretch of text the mean
of its words, and a linear softmax over that decides; embeddings and softmax are trained jointly.
A misspelt word shares most n-grams with the word it stands for. A text is judged stretch by stretch and
scores as its most toxic one, so length dilutes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, sample_texts, table, text_or_empty

SAMPLE_ROWS = 1_500  # labelled texts of each class a model learns from
SAMPLE_CHARS = 20_000  # longer texts are not among them
STRETCH = 8  # words
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17  # hashed n-grams and words
DIMENSIONS = 8
ROUNDS = 6  # of training and choosing the toxic stretches anew
STEPS = 10  # of gradient descent in a round
RATE = 0.5
DECAY = 0.05  # of the embeddings
SLACK = 1e-3  # in the step, so that what few texts say moves little
CLEAN_WEIGHT = 5
CALIBRATION_SHARE = 5  # every fifth text sets the threshold
CACHED_WORDS = 200_000
WORD = re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>|%&*#$~`^=+/\\-_"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case words without the signs around them."""
    return [w for w in (w.strip(EDGE) for w in text.lower().split()) if w]


def units_of(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``<word>`` and of the word itself, flat and with the number of each word."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # symbols from here to the word's end

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))

    units, owners = [], []
    total = np.zeros(len(points), np.uint64)
    padded = np.concatenate([points, np.zeros(max(GRAMS), np.uint64)])
    for n in range(1, max(GRAMS) + 1):
        total = mixed(total + padded[n - 1:n - 1 + len(points)] * FACTOR)
        if n in GRAMS:
            inside = left >= n
            units.append(total[inside])
            owners.append(owner[inside])
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    whole = np.add.reduceat(mixed(points * FACTOR + place.astype(np.uint64)), ends - lengths) if len(words) else total
    units.append(mixed(whole + np.uint64(1)))
    owners.append(np.arange(len(words)))
    flat, owners = np.concatenate(units), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (flat[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owners, minlength=len(words))


class _Sums:
    """Means of rows by a fixed assignment (a sparse matrix, and its transpose); with ``slots``, of that
    many rows, of which the lacking ones are zero."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray, n_columns: int, slots: int = 0):
        self.columns, self.counts = columns, (counts if not slots else 0 * counts + slots).astype(np.float32)[:, None]
        self.begins = np.cumsum(counts) - counts
        rows = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(columns, kind="stable")
        self.rows_back = rows[order]
        self.present, self.begins_back = np.unique(columns[order], return_index=True)
        self.n_columns = n_columns

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.columns], self.begins, axis=0) / self.counts

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_columns, g.shape[1]), np.float32)
        out[self.present] = np.add.reduceat((g / self.counts)[self.rows_back], self.begins_back, axis=0)
        return out


@dataclass
class ToxicityModel:
    unit_logits: np.ndarray  # embedding of each bucket times the difference of the softmax rows
    bias: float
    threshold: float  # logit of the most toxic stretch from which a text counts as toxic
    stretch: int

    def word_logits(self, words: list[str]) -> np.ndarray:
        units, counts = units_of(words, len(self.unit_logits))
        return np.add.reduceat(self.unit_logits[units], np.cumsum(counts) - counts) / counts

    def text_logits(self, logits: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Highest stretch logit of each text, from the logits of all words and the words of each
        text one after another; -inf for texts without words."""
        out = np.full(len(sizes), -np.inf)
        full = np.flatnonzero(sizes)
        if len(full):
            begins, texts = stretches(sizes, self.stretch)
            each = np.where(repeats(ids, begins), 0.0, logits[ids])
            means = np.add.reduceat(each, begins) / self.stretch + self.bias
            np.maximum.at(out, texts, means)
        return out

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - logits, -60, 60)))


def stretches(sizes: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each stretch in the words of all texts, and the text it belongs to."""
    counts = -(-sizes // stretch)
    texts = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(sizes) - sizes)[texts] + place * stretch, texts


def repeats(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where a word is the one before it again, within a stretch: it fills no slot twice."""
    again = np.r_[False, ids[1:] == ids[:-1]]
    again[begins] = False
    return again


def learn(rows: list[tuple[int, str]], seed: int = 7) -> ToxicityModel | None:
    """A model from (label, text) rows; None unless both labels have words.

    Of a toxic text only the stretch with the word most typical of toxic texts starts as toxic;
    after each round it is the one the model finds most toxic, and all those it finds toxic at
    all. The other stretches of toxic texts are left out, those of clean texts are all clean."""
    rows = [(int(label), words_of(text)) for label, text in rows]
    rows = [(label, words) for label, words in rows if words]
    if len({label for label, _ in rows}) < 2:
        return None
    fit = [r for i, r in enumerate(rows) if i % CALIBRATION_SHARE] or rows
    if len({label for label, _ in fit}) < 2:
        fit = rows
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for _, words in fit for w in words])
    sizes = np.array([len(words) for _, words in fit])
    label = np.array([lab for lab, _ in fit])
    begins, texts = stretches(sizes, STRETCH)
    fresh = ~repeats(ids, begins)
    counts = np.add.reduceat(fresh, begins, dtype=np.int64)
    units, unit_counts = units_of(list(vocabulary))
    by_unit = _Sums(units, unit_counts, BUCKETS)
    by_word = _Sums(ids[fresh], counts, len(vocabulary), STRETCH)
    clean = label[texts] == 0
    toxic = _likely(ids, np.repeat(np.arange(len(sizes)), sizes), begins, texts, label)
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)  # an n-gram never seen says nothing
    softmax = rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    weight = _weights(toxic, clean, clean)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, offset)]
    step = 0
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            step += 1
            words = by_unit.mean(vectors)
            hidden = by_word.mean(words)
            logits = hidden @ softmax + offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), toxic.astype(int)] -= 1
            g = p * weight[:, None]
            grads = (by_unit.back(by_word.back(g @ softmax.T)), hidden.T @ g, g.sum(axis=0))
            vectors *= 1 - RATE * DECAY
            for value, grad, (first, second) in zip((vectors, softmax, offset), grads, moments):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                value -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + SLACK)
        margin = (by_word.mean(by_unit.mean(vectors)) @ softmax + offset) @ np.array([-1, 1], np.float32)
        top = np.full(len(sizes), -np.inf)
        np.maximum.at(top, texts, margin)
        toxic = (label[texts] == 1) & ((margin >= top[texts]) | (margin > 0))
        weight = _weights(toxic, clean, clean & ((margin >= top[texts]) | (margin > 0)))
    model = ToxicityModel((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64),
                          float(offset[1] - offset[0]), 0.0, STRETCH)
    held = [r for i, r in enumerate(rows) if i % CALIBRATION_SHARE == 0]
    model.threshold = _threshold(model, held if len({lab for lab, _ in held}) == 2 else fit)
    return model


def _weights(toxic: np.ndarray, clean: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Half of the weight for the toxic stretches; a quarter for all clean ones and another for
    those of them that are hardest to tell."""
    parts = ((toxic, 0.5), (clean, 0.25), (hard, 0.25))
    return sum(np.where(part, share / max(part.sum(), 1), 0) for part, share in parts).astype(np.float32)


def _likely(ids, word_text, begins, texts, label) -> np.ndarray:
    """The stretch of each toxic text that holds the word with the highest log-odds of occurring in
    toxic rather than clean texts."""
    pairs = np.unique(np.stack([ids, word_text]), axis=1)
    in_texts = [np.bincount(pairs[0][label[pairs[1]] == k], minlength=ids.max() + 1) for k in (0, 1)]
    odds = np.log((in_texts[1] + 0.5) / ((label == 1).sum() + 1)) - np.log((in_texts[0] + 0.5) / ((label == 0).sum() + 1))
    most = np.maximum.reduceat(odds[ids], begins)
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, texts, most)
    return (label[texts] == 1) & (most >= top[texts])


def _threshold(model: ToxicityModel, rows: list[tuple[int, list[str]]]) -> float:
    """Between the two neighbouring logits that part the classes best, where the share of clean texts
    taken for toxic weighs CLEAN_WEIGHT times that of toxic texts missed."""
    top = _logits(model, [words for _, words in rows])
    label = np.array([lab for lab, _ in rows])
    order = np.argsort(top, kind="stable")
    top, label = top[order], label[order]
    right = CLEAN_WEIGHT * np.cumsum(label == 0) / (label == 0).sum() - np.cumsum(label == 1) / (label == 1).sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = best[0]
    return float((top[k] + top[min(best[-1] + 1, len(top) - 1)]) / 2)


def _logits(model: ToxicityModel, texts: list[list[str]]) -> np.ndarray:
    words = [w for t in texts for w in t]
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    each = model.word_logits(list(known)) if known else np.zeros(0)
    return model.text_logits(each, np.array([known[w] for w in words], np.int64), np.array([len(t) for t in texts]))


def score(docs: DataFrame, model: ToxicityModel | None, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text. Null and wordless texts score 0, as does all
    if nothing was learnt. Rows repeated with their id give a row each; other columns are not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))

    def run(batches):
        model, known, each = shared.value, {}, np.zeros(0)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = np.zeros(len(texts))
            if model is not None:
                split = [words_of(t) for t in texts]
                if len(known) > CACHED_WORDS:
                    known, each = {}, each[:0]
                new = list({w for words in split for w in words if w not in known})
                known.update(zip(new, range(len(known), len(known) + len(new))))
                each = np.concatenate([each, *(model.word_logits(new[i:i + 50_000])
                                               for i in range(0, len(new), 50_000))])
                ids = np.fromiter((known[w] for words in split for w in words), np.int64)
                top = model.text_logits(each, ids, np.array([len(w) for w in split], np.int64))
                scores = np.where(np.isfinite(top), model.score(top), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) a model may learn from: those with a remainder other than 0. An id labelled
    both ways counts as toxic."""
    return labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("label"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = learning_labels(table(spark, sf_dir, "labels"))
    model = learn(sample_texts(docs.select("doc_id", "text"), SAMPLE_ROWS, SAMPLE_CHARS, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
