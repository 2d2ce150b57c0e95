"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of single words, with word ends as symbols. The
n-grams of one order lie in a sorted array of hashes; beside each hash stand the logarithms of its
interpolated probability in every language. A text belongs to the language with the lowest
cross-entropy per symbol, and to none if that is far above what the language's own texts have.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from rowecho.llm.common import WORD_BATCH_BYTES, WORD_BATCH_ROWS, bounded_batches, sample_texts, table, text_or_empty

ORDER = 5
SAMPLE_ROWS = 300  # texts per language a model learns from
SAMPLE_CHARS = 20_000  # longer texts are not among them
CALIBRATION_SHARE = 4  # every fourth of them sets the limits of rejection
DEVIATIONS = 20.0  # of cross-entropy above the middle from which a text is rejected
TYPICAL_SHARE = 0.8  # of a language's calibration texts, which tell a deviation; the others may be mislabelled
NORMAL = 1.2816  # standard deviations from the middle that hold this share of a normal distribution
CACHED_WORDS = 150_000
BLOCK_WORDS = 10_000  # scored at once
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
START, END = 1, 2  # code points that stand for the ends of a word
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their ends, and each one's place in its word (start: 0)."""
    points = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    return points, np.arange(len(points)) - np.repeat(begins, lengths)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(points: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n symbols that end at each position, or of all from the
    word's start if they are fewer."""
    out, total = [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        own = np.concatenate([np.zeros(n - 1, np.uint64), points])[:len(points)]
        inside = place >= n - 1
        total = np.where(inside, _mixed(total + own * FACTOR + np.uint64(n)), total)
        out.append(total.copy())
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted hash; -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class CharModels:
    """Models of several languages and the limits above which they reject a text."""

    languages: list[str]
    grams: list[np.ndarray]  # per order: sorted hashes
    logs: list[np.ndarray]  # per order: log-probability of each in each language
    contexts: list[np.ndarray]  # per order: sorted hashes of what came before
    weights: list[np.ndarray]  # per order: log-weight left to the lower order in each language
    base: float  # log-probability of a symbol never seen
    mean: np.ndarray | None = None  # middle of the cross-entropy
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None
    deviations: float = DEVIATIONS

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Per word and language the sum of -log p of its symbols."""
        points, place = _symbols(words)
        hashes = _grams(points, place)
        counted = place > 0  # the start is given, not predicted
        where = np.flatnonzero(counted)
        cost = np.zeros((len(where), len(self.languages)))
        depth = np.minimum(place[where] + 1, ORDER)
        open_ = np.ones(len(where), bool)
        for n in range(ORDER, 0, -1):
            rows = np.flatnonzero(open_ & (depth >= n))
            if not len(rows):
                continue
            at = _find(self.grams[n - 1], hashes[n - 1][where[rows]])
            hit = at >= 0
            cost[rows[hit]] -= self.logs[n - 1][at[hit]]
            open_[rows[hit]] = False
            rows = rows[~hit]
            before = hashes[n - 2][where[rows] - 1] if n > 1 else np.zeros(len(rows), np.uint64)
            at = _find(self.contexts[n - 1], before)
            seen = at >= 0
            cost[rows[seen]] -= self.weights[n - 1][at[seen]]
        cost[open_] -= self.base
        begins = np.flatnonzero(place[where] == 1)
        return np.add.reduceat(cost, begins, axis=0)

    def judge(self, costs: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of probability at the cross-entropies, and whether it is rejected."""
        entropy = costs / np.maximum(symbols, 1)[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        share = 1 / np.exp(low[:, None] - entropy).sum(axis=1)
        if self.mean is None:
            return best, share, np.zeros(len(best), bool)
        width = np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / np.maximum(symbols, 1))
        return best, share, low > self.mean[best] + self.deviations * width


def train(counts: list[Counter], languages: list[str]) -> CharModels:
    """Interpolated Kneser-Ney models of the words counted per language."""
    n_languages = len(languages)
    words = sorted(set().union(*counts))
    points, place = _symbols(words)
    hashes = _grams(points, place)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    weight = np.stack([np.array([c[w] for w in words], float) for c in counts], axis=1)
    models = CharModels(languages, [], [], [], [], 0.0)
    seen = []  # per order: (hash, context hash, hash without the first symbol, counts per language)
    for n in range(1, ORDER + 1):
        # n-grams within a word that predict a symbol; shorter ones at its start belong below
        at = np.flatnonzero((place >= n - 1) & (place > 0))
        keys, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        total = np.zeros((len(keys), n_languages))
        np.add.at(total, inverse, weight[owner[at]])
        origin = at[first]
        seen.append((keys, hashes[n - 2][origin - 1] if n > 1 else np.zeros(len(keys), np.uint64),
                     hashes[n - 2][origin] if n > 1 else None, total, place[origin] == n - 1))
    alphabet = len(seen[0][0]) + 1
    models.base = float(-np.log(alphabet))
    lower = None
    for n in range(1, ORDER + 1):
        keys, before, shorter, total, at_start = seen[n - 1]
        count = total
        if n < ORDER:
            # below the top an n-gram counts by the different symbols before it; at the start of
            # a word nothing stands before it and its own count holds
            above = seen[n]
            count = np.zeros_like(total)
            np.add.at(count, _find(keys, above[2]), (above[3] > 0).astype(float))
            if n > 1:
                count[at_start] = np.maximum(count[at_start], total[at_start])
        groups, context = np.unique(before, return_inverse=True)
        mass, kinds, left = (np.zeros((len(groups), n_languages)) for _ in range(3))
        ones, twos = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        discount = np.clip(discount, 0.05, 0.95)
        np.add.at(mass, context, count)
        np.add.at(kinds, context, (count > 0).astype(float))
        left = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
        below = np.full((len(keys), n_languages), 1 / alphabet) if n == 1 else lower[_find(seen[n - 2][0], shorter)]
        own = np.where(count > 0, (count - discount) / np.maximum(mass[context], 1), 0.0)
        lower = own + left[context] * below
        models.grams.append(keys)
        models.logs.append(np.log(lower))
        models.contexts.append(groups)
        models.weights.append(np.log(left))
    return models


def _counted(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def _text_costs(models: CharModels, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    costs, symbols = [], []
    for text in texts:
        words = _counted(text)
        if not words:
            continue
        n = np.array(list(words.values()), float)
        costs.append(n @ models.word_costs(list(words)))
        symbols.append(float(n @ (np.fromiter(map(len, words), float, len(words)) + 1)))
    return np.array(costs).reshape(len(costs), len(models.languages)), np.array(symbols)


def learn(rows: list[tuple[str, str]]) -> CharModels | None:
    """Models from (language, text) rows; None if there are none with a letter.

    A part of the rows sets the limits of each language for itself: middle, spread between texts and noise
    per symbol of its cross-entropy, by median and quantile, so that a few mislabelled texts move little.
    Such texts may be rejected themselves."""
    rows = [(lang, text) for lang, text in rows if WORD.search(text)]
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return None
    fit = [Counter() for _ in languages]
    checks = [[] for _ in languages]
    for k, (lang, text) in enumerate(rows):
        i = languages.index(lang)
        if k % CALIBRATION_SHARE == 0 and fit[i]:
            checks[i].append(text)
        else:
            fit[i].update(_counted(text))
    models = train(fit, languages)
    mean, spread, noise = (np.zeros(len(languages)) for _ in range(3))
    for i, texts in enumerate(checks):
        costs, symbols = _text_costs(models, texts or [t for lang, t in rows if lang == languages[i]])
        entropy = costs[:, i] / symbols
        long = symbols >= np.median(symbols)
        mean[i] = np.median(entropy[long])
        off = np.abs(entropy - mean[i])
        spread[i] = max(0.02, np.quantile(off[long], TYPICAL_SHARE) / NORMAL)
        noise[i] = max(1.0, np.quantile(off * np.sqrt(symbols), TYPICAL_SHARE) / NORMAL)
    models.mean, models.spread, models.noise = mean, spread, noise
    return models


def _judged(rows: DataFrame, models: CharModels | None) -> DataFrame:
    """``rows``, whose first column is the text, with lang_pred, score and rejected in place of it."""
    spark = rows.sparkSession
    bounded_batches(spark, WORD_BATCH_ROWS, WORD_BATCH_BYTES)
    shared = spark.sparkContext.broadcast(models)
    others = rows.columns[1:]

    def run(batches):
        models = shared.value
        known: dict[str, int] = {}
        costs = np.zeros((0, len(models.languages) if models else 0))
        sizes = np.zeros(0)
        for batch in batches:
            split = [WORD.findall(t.lower()) for t in batch.column(0).to_pylist()]
            # number signs are no letters; the first word nearly always has one
            split = [words if any(any(map(str.isalpha, w)) for w in words) else [] for words in split]
            lettered = np.array([bool(w) for w in split], bool)
            lang, score, rejected = [UNKNOWN] * len(split), np.zeros(len(split)), ~lettered
            if models is not None and lettered.any():
                if len(known) > CACHED_WORDS:
                    known, costs, sizes = {}, costs[:0], sizes[:0]
                new = list({w for words in split for w in words if w not in known})
                known.update(zip(new, range(len(known), len(known) + len(new))))
                costs = np.concatenate([costs, *(models.word_costs(new[i:i + BLOCK_WORDS])
                                                 for i in range(0, len(new), BLOCK_WORDS))])
                sizes = np.r_[sizes, [len(w) + 1 for w in new]]
                ids = np.fromiter((known[w] for words in split for w in words), np.int64)
                ends = np.cumsum([len(w) for w in split if w])
                begins = np.r_[0, ends[:-1]]
                best, share, beyond = models.judge(
                    np.add.reduceat(costs[ids], begins, axis=0), np.add.reduceat(sizes[ids], begins))
                for k, b in zip(np.flatnonzero(lettered), best):
                    lang[k] = models.languages[b]
                score[lettered], rejected[lettered] = share, beyond
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                [*others, "lang_pred", "score", "rejected"])

    fields = [StructField(f.name, f.dataType) for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, StructType([
        *fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("rejected", BooleanType())]))


def predict(docs: DataFrame, models: CharModels | None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected, for every row.

    ``lang_pred`` is the best language of the whole text, ``und`` with score 0 where the text is
    null or has no letter (or nothing was learnt); ``rejected`` is true for texts without a letter
    and for those whose cross-entropy is beyond the limit of the best language. Rows repeated with
    their id give a row each."""
    return _judged(docs.select(text_or_empty(text_column).alias("text"), F.col(id_column).alias("doc_id")), models)


def drop_rejected(docs: DataFrame, models: CharModels | None, text_column: str = "text") -> DataFrame:
    """The rows that are not rejected, with the columns of ``docs``, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).select(text_or_empty(names[docs.columns.index(text_column)]).alias("text"), *names)
    return _judged(plain, models).filter(~F.col("rejected")).select(*names).toDF(*docs.columns)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    """What models may learn from: rows with an id, a language and a remainder other than 1."""
    return docs.select("doc_id", F.col("lang").alias("label"), "text").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = learn(sample_texts(learning_rows(docs), SAMPLE_ROWS, SAMPLE_CHARS))
    return predict(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
