"""Repeated passages removed by words: every word inside a window of ``width`` words that also starts elsewhere.

The nodes of a De Bruijn graph are runs of ``NODE`` words, its edges runs of one word more. Of the nodes in
a window the one with the lowest hash marks it, so only windows whose mark occurs twice can be repeated,
and only their words become nodes and edges, once for all copies of a text.

A node with different edges before or after it in different places is a branching. A join of all nodes with the
branchings parts every text into paths without one. Where a text enters or leaves the graph it also
meets a branching, unless all texts do so there, so texts hold paths as a whole, and a path is known by its words.

Back in the sources, a window is known by the paths it touches and its place on the first. Windows that follow
each other and touch the same paths go together: they are repeated where two places in the corpus,
copies of a text counted, touch these paths one after another, and their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowecho.llm.common import bounded_batches, cut, table, text_or_empty
from rowecho.operators.members import BITMAP_BITS, filter_bits

WIDTH, NODE = 35, 16
HELD_WORDS = 1 << 18  # different words whose hash a task keeps
HELD_ROWS = 1 << 18  # rows of a batch that a task hands on
TASK_SHIFT = 40  # a task numbers its places above its own number
SEEN_TEXTS = 500_000
FILTER_BITS = 1 << 27  # of a filter that is sent to all tasks, at most

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _runs_hashed(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of the ``length`` words from each place, put together from runs of powers of two."""
    power, size, out, done = words, 1, None, 0
    while True:
        if length & size:
            out = power if out is None else out[:len(out) - size] * np.uint64(pow(int(base), size, 1 << 64)) + power[done:]
            done += size
        size *= 2
        if size > length:
            return _mixed(out)
        power = power[:len(power) - size // 2] * np.uint64(pow(int(base), size // 2, 1 << 64)) + power[size // 2:]


def _marks(nodes: np.ndarray, size: int) -> np.ndarray:
    """Place of the lowest of ``size`` nodes from each place on, the leftmost of equal ones."""
    at, length = np.arange(len(nodes)), 1
    while length < size:
        step = min(length, size - length)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(nodes[left] <= nodes[right], left, right)
        length += step
    return at


def _keys(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _read(docs: DataFrame, width: int, node: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, k1, k2, row, n_words, sha, marks): a row per document with its number; the marks of a text come with
    its first row in a task, or a few, and are null in the others."""
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), *_keys(text), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Hashes = _Hashes()
        seen: dict[tuple[int, int], tuple[int, str]] = {}
        row = TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            sizes, shas, marks = [], [], []
            for key, data in zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), batch.column(3).to_pylist()):
                known, own = seen.get(key), None
                if known is None:
                    words = data.split()
                    if len(seen) > SEEN_TEXTS:
                        seen.clear()
                    seen[key] = known = len(words), hashlib.sha256(b" ".join(words)).hexdigest()
                    if len(words) >= width:
                        nodes = _runs_hashed(held.of(words), node, _A)
                        at = _marks(nodes, width - node + 1)
                        own, times = np.unique(nodes[at[np.r_[True, at[1:] != at[:-1]]]].view(np.int64), return_counts=True)
                        own = np.r_[own, own[times > 1]]  # twice is often enough
                marks.append(own)
                sizes.append(known[0])
                shas.append(known[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.arange(row, row + len(sizes))),
                 pa.array(sizes, pa.int64()), pa.array(shas), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "row", "n_words", "sha", "marks"])
            row += len(sizes)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, row bigint, "
                                "n_words bigint, sha string, marks array<bigint>")


def _bit_filter(numbers: DataFrame, column: str) -> Broadcast:
    """Bits of the numbers of a written table, by their low digits: a number whose bit is not set is not in the table. The more
    numbers, the more others pass too; what passes still has to be joined."""
    n_bits = min(FILTER_BITS, filter_bits(numbers.count()))
    maps = numbers.select(F.pmod(column, F.lit(n_bits)).alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(BITMAP_BITS))).alias("bits"))
    bits = np.zeros((n_bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for bucket, own in maps.collect():  # FILTER_BITS at most, however many numbers
        bits[bucket] = np.frombuffer(own, np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(bits.ravel())


def _may_hold(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers have their bit set."""
    at = numbers.view(np.int64) & (len(bits) * 8 - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _packed(docs: DataFrame, text_column: str, wanted: Broadcast) -> DataFrame:
    """(k1, k2, size, packed): different texts compressed for the way to other tasks, one of several tasks
    possibly in each. Texts whose k1 is not in the filter ``wanted`` stay where they are."""
    text = text_or_empty(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = pa.Codec("zstd", compression_level=1), set()
        for batch in batches:
            new = []
            asked = _may_hold(wanted.value, batch.column(0).to_numpy()).tolist()
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if asked[i] and key not in seen:
                    if len(seen) > SEEN_TEXTS:
                        seen.clear()
                    seen.add(key)
                    new.append(i)
            texts = batch.column(2).take(pa.array(new, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(new, pa.int64())) for i in (0, 1)), pa.array(map(len, texts), pa.int64()),
                 pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())],
                ["k1", "k2", "size", "packed"])

    return docs.select(*_keys(text), text.cast("binary").alias("text")).mapInArrow(
        run, "k1 bigint, k2 bigint, size bigint, packed binary")


def _words(size: int, packed: bytes) -> list[bytes]:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True).split() if size else []


def _hash_of_runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of the words from each begin to its end."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.r_[one, np.full(len(words), base, np.uint64)], dtype=np.uint64)
    back = np.cumprod(np.r_[one, np.full(len(words), inverse, np.uint64)], dtype=np.uint64)
    sums = np.cumsum(np.r_[one, words * power[:-1]], dtype=np.uint64)
    return _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _B)


def nodes_of(words: np.ndarray, marks, copies: int, width: int, node: int) -> tuple[np.ndarray, ...]:
    """(windows, marked, place, nodes): which windows may be repeated and whether their mark is one of ``marks``, and the nodes
    of these windows, in the order of places. In a text with copies all windows are repeated."""
    nodes = _runs_hashed(words, node, _A)
    size = width - node + 1  # nodes of a window
    at = _marks(nodes, size)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    marked = np.isin(nodes[at[starts]], np.array(marks or [], np.int64).view(np.uint64))
    marked = np.repeat(marked, np.diff(np.r_[starts, len(at)]))
    windows = np.arange(len(at)) if copies > 1 else np.flatnonzero(marked)
    marked = marked[windows]
    change = np.zeros(len(nodes) + 1, np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + size, -1)
    place = np.flatnonzero(np.cumsum(change) > 0)
    return windows, marked, place, nodes[place]


def _graph(texts: DataFrame, width: int, node: int, names: str, of) -> DataFrame:
    """Rows that ``of(words, place, nodes)`` makes of each text, behind its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Hashes = _Hashes()
        columns = ["number", *names.split()]
        for batch in batches:
            out, count = [], 0
            for number, size, packed, marks, copies in zip(*(c.to_pylist() for c in batch.columns)):
                words = held.of(_words(size, packed))
                found = of(words, *nodes_of(words, marks, copies, width, node)[2:])
                out.append((np.full(len(found[0]), number), *found))
                count += len(found[0])
                if count >= HELD_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], columns)
                    out, count = [], 0
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], columns)

    return texts.select("number", "size", "packed", "marks", "copies").mapInArrow(
        run, ", ".join(f"{n} bigint" for n in ["number", *names.split()]))


def edges_at(words: np.ndarray, place: np.ndarray, nodes: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, edges): every node with a number for the two edges it has here; none where the graph is entered or left."""
    before, after = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    goes_on = np.flatnonzero(np.diff(place) == 1)
    after[goes_on] = _mixed(words[place[goes_on] + node] + _A)
    before[goes_on + 1] = _mixed(words[place[goes_on]] + _A)
    return nodes.view(np.int64), _mixed(before * _B + after).view(np.int64)


def _nodes_in(known: Broadcast):
    """(place, node): the nodes that the filter ``known`` may hold."""
    def of(words: np.ndarray, place: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = _may_hold(known.value, nodes)
        return place[may], nodes[may].view(np.int64)

    return of


def paths_of(words: np.ndarray, windows: np.ndarray, marked: np.ndarray, place: np.ndarray, branches: np.ndarray, width: int,
             node: int) -> tuple[np.ndarray, ...]:
    """(window, count, key1, key2): the windows of a text in groups that touch the same paths, the first of them and how many
    they are. ``branches`` are the places of branchings. Marked windows, which every text asks for, and others
    are apart, so the groups of all texts are the same."""
    edges = place[:-1][np.diff(place) == 1]  # an edge is known by its first node
    starts = np.flatnonzero(np.r_[True, np.diff(edges) != 1] | np.isin(edges, branches))  # of paths
    path = np.cumsum(np.isin(np.arange(len(edges)), starts)) - 1
    ends = np.r_[starts[1:], len(edges)] - 1
    begin, end = edges[starts], edges[ends] + node + 1
    names = [_hash_of_runs(words, begin, end, base) for base in (_A, _C)]
    inside = width - node  # edges of a window
    at = np.searchsorted(edges, windows)
    first, last = path[at], path[at + inside - 1]
    new = np.flatnonzero(np.r_[True, (np.diff(first) != 0) | (np.diff(last) != 0) | (np.diff(windows) != 1)
                               | (marked[1:] != marked[:-1])])
    count = np.diff(np.r_[new, len(windows)])
    first, last = first[new], last[new]
    keys = []
    for name in names:
        key = name[first]
        for step in range(1, inside):
            more = np.flatnonzero(first + step <= last)
            if not len(more):
                break
            key[more] = _mixed(key[more] * _B + name[first[more] + step])
        keys.append(key.view(np.int64))
    # several groups may touch the same paths: their places on the first path tell them apart
    offset = (windows[new] - begin[first]).astype(np.uint64)
    keys[1] = _mixed(keys[1].view(np.uint64) + (offset << np.uint64(32) | count.astype(np.uint64)) * _C).view(np.int64)
    return windows[new], count, *keys


def _stretches(texts: DataFrame, branches: DataFrame, width: int, node: int) -> DataFrame:
    """(number, copies, window, count, key1, key2): the windows of every text by the paths they touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Hashes = _Hashes()
        for batch in batches:
            out = []
            for number, size, packed, marks, copies, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = held.of(_words(size, packed))
                windows, marked, place, _ = nodes_of(words, marks, copies, width, node)
                if len(windows):
                    found = paths_of(words, windows, marked, place, np.array(places or [], np.int64), width, node)
                    out.append((np.full(len(found[0]), number), np.full(len(found[0]), copies), *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                 ["number", "copies", "window", "count", "key1", "key2"])

    places = branches.groupBy("number").agg(F.collect_list("place").alias("places"))
    return texts.select("number", "size", "packed", "marks", "copies").join(places, "number", "left").select(
        "number", "size", "packed", "marks", "copies", "places").mapInArrow(
        run, "number bigint, copies bigint, window bigint, count bigint, key1 bigint, key2 bigint")


def _removed(texts: DataFrame, width: int) -> DataFrame:
    """(k1, k2, n_removed, kept_sha256, spans) of texts with the starts of their repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, size, packed, begins, ends in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(size, packed)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, begins, 1)
                np.add.at(change, np.array(ends, np.int64) + width - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                spans = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((k1, k2, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["k1", "k2", "n_removed", "kept_sha256", "spans"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, kept_sha256 string, spans array<bigint>")


def remove_passages(docs: DataFrame, width: int = WIDTH, node: int = NODE, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and spans (begin and end of the removed runs of
    words, one after another; null if nothing is removed), a row per document.

    Words are what ASCII white space separates. A null or empty text has none, and a text of fewer than ``width`` words loses
    nothing. Equal texts, rows repeated with their id among them, repeat each other. An empty table gives an empty result;
    other columns are not read. Runs of words are told apart by two hashes of 64 bits.
    """
    if not 1 <= node < width:
        raise ValueError("a node is shorter than a window")
    bounded_batches(docs.sparkSession)
    long_enough = F.col("n_words") >= width
    base = cut(_read(docs, width, node, id_column, text_column), "base")
    copies = base.filter(long_enough).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marks = base.select("row", F.explode("marks").alias("mark"))
    twice = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    asked = marks.join(twice, "mark").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    # texts with copies may be marked in one task only, and every window of theirs is repeated
    asked = cut(base.select("row", "k1", "k2").join(asked, "row").select("k1", "k2", "marks").join(
        copies, ["k1", "k2"], "full").select("k1", "k2", "marks", F.coalesce("copies", F.lit(1)).alias("copies")), "asked")
    packed = cut(_packed(docs, text_column, _bit_filter(asked, "k1")).join(asked, ["k1", "k2"]).groupBy("k1", "k2").agg(
        *(F.first(c).alias(c) for c in ("size", "packed", "marks", "copies"))).withColumn(
        "number", F.monotonically_increasing_id()), "packed")
    nodes = _graph(packed, width, node, "node edges", lambda *own: edges_at(*own, node))
    branching = cut(nodes.groupBy("node").agg(F.min("edges").alias("one"), F.max("edges").alias("other")).filter(
        "one <> other").select("node"), "branching")
    # few of all nodes: the others are told by a filter and do not travel
    branches = _graph(packed, width, node, "place node", _nodes_in(_bit_filter(branching, "node"))).join(
        branching, "node", "left_semi")
    stretches = cut(_stretches(packed, branches, width, node), "stretches")
    often = stretches.groupBy("key1", "key2").agg(F.sum("copies").alias("n")).filter("n > 1").select("key1", "key2")
    hit = stretches.join(often, ["key1", "key2"], "left_semi").groupBy("number").agg(
        F.collect_list("window").alias("begins"), F.collect_list(F.col("window") + F.col("count")).alias("ends"))
    partly = _removed(packed.select("number", "k1", "k2", "size", "packed").join(hit, "number").select(
        "k1", "k2", "size", "packed", "begins", "ends"), width)
    zero = F.lit(0).cast("bigint")
    return base.join(cut(partly, "partly"), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("spans")


SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
  FROM documents),
words AS MATERIALIZED (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM texts),
windows AS MATERIALIZED (
  SELECT rid, i, md5(string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h
  FROM words WHERE n >= 35),
hits AS (
  SELECT rid, i FROM windows SEMI JOIN (
    SELECT h FROM windows JOIN words USING (rid, i) WHERE i <= n - 35 GROUP BY h HAVING count(*) > 1) USING (h)
  JOIN (SELECT rid, len(ws) AS n FROM texts) USING (rid) WHERE i <= n - 35),
marked AS (
  SELECT rid, i, w, max(hits.i) OVER (PARTITION BY rid ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW)
         IS NOT NULL AS gone
  FROM words LEFT JOIN hits USING (rid, i)),
kept AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""
