"""A persistent index of the passages of a text corpus.

Texts are added in batches, each read once. A text keeps the lowest of every ``window`` consecutive
hashes of ``gram`` words (winnowing), about two of ``window`` + 1. Whatever passage of at least
``gram`` + ``window`` - 1 whole words a text holds, one lowest hash of the passage is therefore among the
text's. Passages meet the texts on it, in a table that is bucketed and sorted by the hash, and the texts
that meet one, which the index keeps too, are searched for it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.sources.lineage import cut_lineage

GRAM, WINDOW = 4, 8
BUCKETS = 64
PLACE_BITS = 26  # of a word's place, beside the leading bits of its hash, while the lowest are found
WORDS_AT_ONCE = 1 << 20  # whose hashes are worked on together


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash64(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's ``xxhash64`` of 64-bit numbers."""
    out = (seed + _P5 + np.uint64(8)) ^ (_rotated(x * _P2, 31) * _P1)
    out = _rotated(out, 27) * _P1 + _P4
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    return out ^ (out >> np.uint64(32))


def _anchors_of(hashes: np.ndarray, starts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, anchors in each text) from the hashes of all words of some texts and where each text starts, the end last.

    Grams and windows are taken over all words at once; those that reach into the next text are left out.
    """
    sizes, below = np.diff(starts), np.int64((1 << PLACE_BITS) - 1)
    place = np.arange(len(hashes), dtype=np.int64) - np.repeat(starts[:-1], sizes)
    left = np.repeat(sizes, sizes) - place  # words from here on
    grams = hashes.view(np.uint64)
    for i in range(1, gram):
        grams = _xxhash64(hashes.view(np.uint64)[i:], _xxhash64(grams[:max(len(hashes) - i, 0)], np.uint64(42)))
    grams = grams.view(np.int64)
    lowest, length = (grams & ~below) | place[:len(grams)], 1
    while length < window:
        step = min(length, window - length)
        lowest = np.minimum(lowest[:max(len(lowest) - step, 0)], lowest[step:])
        length += step
    whole = np.flatnonzero(left[:len(lowest)] >= gram + window - 1)
    found, text = lowest[whole], np.repeat(np.arange(len(sizes)), sizes)[whole]
    # the windows that share a lowest gram follow one another
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[first], text[first]
    places = found & below
    return grams[starts[:-1][text] + places], places, np.bincount(text, minlength=len(sizes))


def _anchors(words: pa.Array, gram: int, window: int) -> pa.Array:
    """The anchors of a batch of texts, a part of limited size after the other."""
    starts = words.offsets.to_numpy().astype(np.int64)
    hashes = words.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    parts, at, n = [], 0, len(words)
    while at < n:
        end = max(int(np.searchsorted(starts, starts[at] + WORDS_AT_ONCE, "right")) - 1, at + 1)
        parts.append(_anchors_of(hashes[starts[at]:starts[end]], starts[at:end + 1] - starts[at], gram, window))
        at = end
    grams, places, counts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    rows = pa.StructArray.from_arrays([pa.array(grams), pa.array(places.astype(np.int32))], ["gram", "place"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)


def with_anchors(df: DataFrame, words: Column, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``anchors``: (gram, place) of the lowest hashes, in the order of places. Runs of fewer than ``gram`` +
    ``window`` - 1 words have none. The hash of a gram is that of its words' hashes, put together."""
    @F.arrow_udf("array<struct<gram:bigint,place:int>>")
    def anchors(hashes: pa.Array) -> pa.Array:
        return _anchors(hashes, gram, window)

    none = F.array().cast("array<bigint>")
    return df.withColumn("anchors", anchors(F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), none)))


def whole_words(text: Column) -> Column:
    return F.split(text, r"\s+")


def inner_words(passage: Column) -> Column:
    """Words that must be whole words wherever the passage occurs: all but the first and the last."""
    words = whole_words(passage)
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


@dataclass(frozen=True)
class PassageIndex:
    """Two tables below ``root``: texts with their anchors, and anchors bucketed by their hash.

    ``key`` is the name and type of what identifies a text. An index is opened with the sizes it was made with.
    """

    spark: SparkSession
    root: str
    key: tuple[str, str]
    gram: int = GRAM
    window: int = WINDOW
    buckets: int = BUCKETS

    @property
    def _name(self) -> str:
        return "passages_" + re.sub(r"\W", "_", self.root).lower()

    def _tables(self) -> tuple[str, str]:
        """Names of the two tables; a session that does not know them yet takes them from their files."""
        texts, anchors = f"{self._name}_texts", f"{self._name}_anchors"
        key, kind = self.key
        known = {
            texts: f"`{key}` {kind}, text STRING, anchors ARRAY<STRUCT<gram: BIGINT, place: INT>>",
            anchors: f"gram BIGINT, `{key}` {kind}, place INT",
        }
        by = {texts: key, anchors: "gram"}
        for name, columns in known.items():
            if not self.spark.catalog.tableExists(name):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name.rsplit('_', 1)[1]}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
                self.spark.sql(
                    f"CREATE TABLE {name} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) "
                    f"CLUSTERED BY (`{by[name]}`) SORTED BY (`{by[name]}`) INTO {self.buckets} BUCKETS "
                    f"LOCATION '{folder.toString()}'")
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return texts, anchors

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        view = f"{name}_new"
        df.createOrReplaceTempView(view)
        try:
            columns = ", ".join(f"`{c}`" for c in df.columns)
            self.spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = '{batch}') SELECT {columns} FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def append(self, texts: DataFrame, batch: str, text: str = "text") -> None:
        """Add texts (key, text). They are read once: the anchors' table is made from what has been written.

        Adding a batch again replaces it, so one that broke off is simply added again. Null texts hold nothing.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"{batch!r} is no name of a batch")
        kept, anchors = self._tables()
        key = self.key[0]
        rows = texts.select(F.col(key).cast(self.key[1]).alias(key), F.col(text).alias("text")).filter("text IS NOT NULL")
        rows = with_anchors(rows, whole_words(F.col("text")), self.gram, self.window)
        self._write(rows.repartition(self.buckets, key), kept, batch)
        written = self.spark.table(kept).filter(F.col("batch") == batch).select(key, "anchors")
        flat = written.select(key, F.inline("anchors")).select("gram", key, "place")
        self._write(flat.repartition(self.buckets, "gram"), anchors, batch)

    def batches(self) -> list[str]:
        """Names of the batches that are complete: the anchors come last."""
        _, anchors = self._tables()
        return sorted(r["partition"].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {anchors}").collect())

    def texts(self) -> DataFrame:
        return self.spark.table(self._tables()[0]).select(self.key[0], "text")

    def candidates(self, passages: DataFrame) -> DataFrame:
        """(key, passage_id): texts that hold an anchor of the passage, the one that fewest texts hold. Passages too short
        for an anchor have no row, nor do those with an anchor that no text holds."""
        key = self.key[0]
        own = with_anchors(passages.select("passage_id", "passage"), inner_words(F.col("passage")), self.gram, self.window)
        own = cut_lineage(own.select("passage_id", F.explode(F.transform("anchors", lambda a: a["gram"])).alias("gram")).distinct())
        index = self.spark.table(self._tables()[1]).select("gram", key)
        held = cut_lineage(index.join(own.select("gram").distinct(), "gram", "left_semi").distinct())
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        rarity = F.coalesce("n", F.lit(0))
        rarest = own.join(counts, "gram", "left").groupBy("passage_id").agg(
            F.min_by("gram", F.struct(rarity, "gram")).alias("gram"), F.min(rarity).alias("n")).filter("n > 0")
        return held.join(rarest.select("passage_id", "gram"), "gram").select(key, "passage_id")

    def find(self, passages: DataFrame, short=None) -> DataFrame:
        """(key, passage_id) for every passage that occurs verbatim in a text of the index.

        ``passages`` is (passage_id, passage), passages distinct, a table or a cheap projection of one. Passages of fewer
        whole words than an anchor needs are looked for by ``short(texts, passages, key)``, which reads
        the texts the index keeps; without it they are an error. An empty passage occurs nowhere.
        """
        key = self.key[0]
        long_enough = F.size(inner_words(F.col("passage"))) >= self.gram + self.window - 1
        asked = passages.filter("passage <> ''").select("passage_id", "passage")
        met = cut_lineage(self.candidates(asked.filter(long_enough)))
        found = [self.texts().join(met, key).join(asked, "passage_id").filter(
            F.contains("text", F.col("passage"))).select(key, "passage_id")]
        rest = asked.filter(~long_enough)
        if not rest.isEmpty():
            if short is None:
                raise ValueError("some passages are too short for the index")
            found.append(short(self.texts(), rest, key).select(key, "passage_id"))
        return reduce(DataFrame.unionByName, found)
