"""Repeated substrings removed: every byte inside a string of ``width`` bytes that also starts elsewhere.

Texts are cut into aligned strings first. Of the 32-byte grams in a window of ``width`` bytes the one with
the lowest hash is its anchor, so equal windows have equal anchors at equal places. Consecutive
windows with one anchor occurrence form a string, and only strings with the same anchor can
share a window. Strings of an anchor that occurs once are done with.

The other strings are built up column by column, from the right: each round inserts one symbol of
every string, sorts the strings by it in front of their order so far (the symbols in this order are the
round's block of the collection's Burrows-Wheeler transform), and updates the common prefixes of
neighbours. A window is repeated where its common prefix with a neighbour reaches ``width``. A round
only reads the block before it, one after another, so it is all that a task keeps of the index.

An anchor with more strings than a task compares has them dealt by the place of the anchor in a window. Windows
with it in one range of places share the bytes around it that all of the range have, so only parts of
strings with equal such bytes can share a window. Groups that stay too large are dealt by narrower
ranges, in the end by single places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, cut, table, text_or_empty

WIDTH, GRAM = 200, 32
BLOCK = 1 << 17  # bytes of text hashed at once
PLACE_BITS = 20
VARIANTS = 2_048  # strings compared with each other in one task
RANGES = (4, 16)  # of places of the anchor, for more; then single places
TASK_STRINGS = 16_384  # strings, of however many anchors, in one task
SEEN_TEXTS = 500_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_rng = np.random.default_rng(200)
_SYMBOLS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place, by doubling."""
    h, length = _SYMBOLS[data], 1
    while length < GRAM:
        h = h[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + h[length:]
        length *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(h: np.ndarray, size: int) -> np.ndarray:
    length = 1
    while 2 * length <= size:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    rest = size - length
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h


def strings_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """The aligned strings of all texts: (text, first window start, windows, place of the anchor after
    the first start, anchor hash)."""
    out = []
    block, pieces, size = [], [], 0  # pieces: (text, offset in text, offset in block, bytes)

    def flush():
        nonlocal block, pieces, size
        if not pieces:
            return
        data = np.frombuffer(b"".join(block), np.uint8)
        hashes = _gram_hashes(data)
        place_mask = np.uint64((1 << PLACE_BITS) - 1)
        marked = (hashes & ~place_mask) | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equal ones
        anchor = (_window_minima(marked, width - GRAM + 1) & place_mask).astype(np.int64)
        for text, at, here, length in pieces:
            own = anchor[here:here + length - width + 1]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            count = np.diff(np.r_[first, len(own)])
            place = own[first]
            out.append((np.full(len(first), text), first + at, count, place - here - first, hashes[place]))
        block, pieces, size = [], [], 0

    step = BLOCK - width
    for i, text in enumerate(texts):
        for at in range(0, len(text) - width + 1, step):
            piece = text[at:at + step + width - 1]
            pieces.append((i, at, size, len(piece)))
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                flush()
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_windows(group: np.ndarray, lead: np.ndarray, count: np.ndarray, strings: list[bytes],
                     width: int = WIDTH) -> np.ndarray:
    """For each string and window of it: whether another string of its group has the same window at the same
    place before the anchor. Groups are sorted."""
    most = width - GRAM + 1
    begin = most - 1 - lead  # column of the first symbol
    end = begin + count + width - 1
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(lengths) - lengths - begin  # data[base + column]
    repeated = np.zeros((len(strings), most), bool)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_end, by_begin = np.argsort(end, kind="stable"), np.argsort(begin, kind="stable")
    ends, begins = end[by_end], begin[by_begin]
    for column in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
        gone = by_begin[np.searchsorted(begins, column + 1):np.searchsorted(begins, column + 1, "right")]
        if len(gone):
            stay = np.flatnonzero(begin[order] <= column)
            if len(stay):  # what is between two that stay is on the way from one to the other
                common = np.minimum.reduceat(common[:stay[-1] + 1], np.r_[0, stay[:-1] + 1])
            else:
                common = common[:0]
            order = order[stay]
        new = by_end[np.searchsorted(ends, column + 1):np.searchsorted(ends, column + 1, "right")]
        if len(new):  # an empty suffix comes first in its group
            both = np.concatenate([new, order])
            at = np.argsort(group[both], kind="stable")
            order, common = both[at], np.concatenate([np.zeros(len(new), np.int64), common])[at]
        if not len(order):
            continue
        symbol = data[base[order] + column]
        key = group[order] * 256 + symbol
        at = np.argsort(key, kind="stable")
        key, order = key[at], order[at]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        grown = np.zeros(len(order), np.int64)
        left, right = at[same - 1] + 1, at[same]
        far = right > left
        value = common[right]
        if far.any():
            bounds = np.stack([left[far], right[far] + 1], axis=1).ravel()
            value[far] = np.minimum.reduceat(np.r_[common, 0], bounds)[::2]
        grown[same] = value + 1
        common = grown
        window = column - begin[order]
        before = common >= width
        after = np.r_[before[1:], False]
        hit = (before | after) & (window < count[order])
        repeated[order[hit], window[hit]] = True
    return repeated


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end (exclusive) of each run of true, one after another."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edges.tolist()


def _keys(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """(k1, k2, text) lists of a task's texts, each text once (or, of very many, a few times)."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2)
        new = []
        for i, key in enumerate(zip(k1, k2)):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if len(seen) > SEEN_TEXTS:
            seen.clear()
        if new:
            yield [k1[i] for i in new], [k2[i] for i in new], [texts[i].as_py() for i in new]


def _anchors(texts: DataFrame, width: int) -> DataFrame:
    """(anchor): the anchor of every aligned string."""
    def run(batches):
        for _, _, data in _unseen(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(strings_of(data, width)[4].view(np.int64))], ["anchor"])

    return texts.mapInArrow(run, "anchor bigint")


def _strings(texts: DataFrame, width: int) -> DataFrame:
    """(k1, k2, first, count, lead, anchor, content): every aligned string and the hash of its bytes."""
    def run(batches):
        for k1, k2, data in _unseen(batches):
            text, first, count, lead, anchor = strings_of(data, width)
            views = [memoryview(d) for d in data]
            digest = xxhash.xxh64_intdigest
            content = [digest(views[t][a:a + n + width - 1], le) for t, a, n, le in zip(
                text.tolist(), first.tolist(), count.tolist(), lead.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(k1, np.int64)[text]), pa.array(np.array(k2, np.int64)[text]), pa.array(first),
                 pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)),
                 pa.array(np.array(content, np.uint64).view(np.int64))],
                ["k1", "k2", "first", "count", "lead", "anchor", "content"])

    return texts.mapInArrow(
        run, "k1 bigint, k2 bigint, first bigint, count int, lead int, anchor bigint, content bigint")


def _packed(texts: DataFrame) -> DataFrame:
    """(k1, k2, size, packed): texts compressed for the way to other tasks."""
    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for k1, k2, data in _unseen(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([len(d) for d in data], pa.int64()),
                 pa.array([codec.compress(d, asbytes=True) if d else b"" for d in data], pa.binary())],
                ["k1", "k2", "size", "packed"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, size bigint, packed binary")


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b""


_ITEM = "g1 bigint, g2 bigint, content bigint, n bigint, count int, lead int, bytes binary"
_ITEM_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_ITEM_NAMES = ["g1", "g2", "content", "n", "count", "lead", "bytes"]


def _bytes_of(strings: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The strings (one occurrence of each) with their bytes. Those of one anchor are a group (g1, g2)."""
    per_text = strings.groupBy("k1", "k2").agg(F.collect_list(F.struct(
        "first", "count", "lead", "anchor", "content", "n")).alias("parts"))

    def run(batches):
        for batch in batches:
            for size, packed, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = _unpacked(packed, size)
                rows = [(p["anchor"], 0, p["content"], p["n"], p["count"], p["lead"],
                         text[p["first"]:p["first"] + p["count"] + width - 1]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _ITEM_KINDS)], _ITEM_NAMES)

    return _packed(texts).join(per_text, ["k1", "k2"]).select("size", "packed", "parts").mapInArrow(
        run, _ITEM).dropDuplicates(["g1", "content"])  # copies of a text in several tasks


def _compared(items: DataFrame, width: int, task_strings: int) -> DataFrame:
    """(g1, g2, content, runs): begins and ends of the windows of an item that another one of its group has, or
    all of them where it occurs ``n`` > 1 times. Groups are small enough for a task."""
    tasks = max(1, -(-items.count() // task_strings))
    dealt = items.withColumn("task", F.pmod(F.xxhash64("g1", "g2"), F.lit(tasks)))

    def compare(rows: pa.Table) -> pa.Table:
        g1, g2 = rows["g1"].to_numpy(), rows["g2"].to_numpy()
        at = np.lexsort((g2, g1))
        rows = rows.take(pa.array(at))
        g1, g2 = g1[at], g2[at]
        group = np.cumsum(np.r_[False, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        count, n = rows["count"].to_numpy(), rows["n"].to_numpy()
        repeated = repeated_windows(group, rows["lead"].to_numpy().astype(np.int64), count.astype(np.int64),
                                    rows["bytes"].to_pylist(), width)
        runs = [_runs(repeated[i, :count[i]]) if n[i] == 1 else [0, int(count[i])] for i in range(len(count))]
        return pa.table({"g1": pa.array(g1), "g2": pa.array(g2), "content": rows["content"],
                         "runs": pa.array(runs, pa.list_(pa.int32()))})

    return dealt.groupBy("task").applyInArrow(
        lambda rows: compare(rows.combine_chunks()), "g1 bigint, g2 bigint, content bigint, runs array<int>")


def _parts(items: DataFrame, width: int, places: int) -> DataFrame:
    """Parts of the items (anchor, whole, first, and an item): the windows that have their anchor in one range of ``places``
    places. Parts whose windows all share the same bytes are a group. ``whole`` and ``first`` tell of which string of
    the anchor it is a part, and with which window it begins."""
    most = width - GRAM + 1

    def run(batches):
        for batch in batches:
            rows = []
            for anchor, whole, first, n, count, lead, data in zip(*(c.to_pylist() for c in batch.columns)):
                for least in range((lead - count + 1) // places * places, lead + 1, places):
                    last = min(least + places, most) - 1
                    begin, end = max(0, lead - last), min(count, lead - least + 1)
                    shared = data[lead - least:lead + GRAM + most - 1 - last]
                    group = xxhash.xxh128_intdigest(shared + anchor.to_bytes(8, "little", signed=True), least)
                    own = data[begin:end + width - 1]
                    rows.append((anchor, whole, first + begin, (group >> 64) - (1 << 63), (group & (1 << 64) - 1) - (1 << 63),
                                 xxhash.xxh64_intdigest(own, lead - begin) - (1 << 63), n, end - begin, lead - begin, own))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), *_ITEM_KINDS])],
                    ["anchor", "whole", "first", *_ITEM_NAMES])

    return items.select("anchor", "whole", "first", "n", "count", "lead", "bytes").mapInArrow(
        run, "anchor bigint, whole bigint, first int, " + _ITEM)


def _large(items: DataFrame, width: int, variants: int, task_strings: int) -> DataFrame:
    """(anchor, content, runs) of strings whose group is too large to be compared at once."""
    most = width - GRAM + 1
    left = items.select(F.col("g1").alias("anchor"), F.col("content").alias("whole"), F.lit(0).alias("first"),
                        "n", "count", "lead", "bytes")
    found = []
    for places in [*(-(-most // k) for k in RANGES), 1]:
        parts = cut(_parts(left, width, places), "parts")
        # parts of different strings may be equal: one of them stands for all
        different = parts.groupBy("g1", "g2", "content").agg(
            F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("count", "lead", "bytes")))
        different = cut(different, "different")
        sizes = different.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("size"))
        small = different if places == 1 else different.join(sizes.filter(F.col("size") <= variants), ["g1", "g2"], "left_semi")
        runs = cut(_compared(small, width, task_strings), "part_runs").filter(F.size("runs") > 0)
        found.append(parts.join(runs, ["g1", "g2", "content"]).select(
            "anchor", F.col("whole").alias("content"), F.transform("runs", lambda x: x + F.col("first")).alias("runs")))
        if places == 1:
            break
        too_large = cut(sizes.filter(F.col("size") > variants), "too_large")
        if too_large.isEmpty():
            break
        left = parts.join(too_large, ["g1", "g2"], "left_semi").select(
            "anchor", "whole", "first", "n", "count", "lead", "bytes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text",
                   variants: int = VARIANTS, task_strings: int = TASK_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin and end of the removed runs, one
    after another, in bytes; null if all or nothing is removed), a row per document.

    Null counts as empty; texts shorter than ``width`` bytes lose nothing. Equal texts, rows repeated with
    their id among them, repeat each other. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if width < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    text = text_or_empty(text_column)
    base = cut(docs.select(F.col(id_column).alias("doc_id"), *_keys(text), F.octet_length(text).cast("bigint")
                           .alias("n_bytes"), F.sha2(text, 256).alias("sha")), "base")
    texts = docs.select(*_keys(text), text.cast("binary").alias("text")).filter(F.octet_length("text") >= width)
    copies = cut(base.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")

    often = cut(_anchors(texts, width).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select("anchor"), "anchors")
    # a text may come from several tasks; made distinct apart from the join, which would have to keep
    # all strings of an anchor together for it
    strings = cut(cut(_strings(texts, width).join(often, "anchor"), "met").distinct(), "strings")
    found = cut(strings.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first", "count", "lead")).alias("one")), "found")
    several = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"), "several")
    to_compare = found.join(several, "anchor").select("anchor", "content", "n", "one.*")
    items = cut(_bytes_of(to_compare, texts, width), "bytes")
    crowded = cut(several.filter(F.col("variants") > variants).select(F.col("anchor").alias("g1")), "crowded")
    compared = cut(_compared(items.join(crowded, "g1", "left_anti"), width, task_strings), "compared").select(
        F.col("g1").alias("anchor"), "content", "runs")
    if not crowded.isEmpty():
        compared = compared.unionByName(_large(items.join(crowded, "g1", "left_semi"), width, variants, task_strings))
    whole = found.filter("n > 1").select("anchor", "content", F.array(F.lit(0), F.col("one.count")).alias("runs"))
    runs = whole.unionByName(compared.filter(F.size("runs") > 0).join(
        found.filter("n > 1").select("anchor", "content"), ["anchor", "content"], "left_anti")
        .select("anchor", "content", "runs"))
    runs = cut(runs, "runs")

    # texts with copies go as a whole and need no look at their strings
    asked = strings.join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti")
    removed = cut(asked.join(runs, ["anchor", "content"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("first", "runs")).alias("parts")), "removed")

    def apply(batches):
        for batch in batches:
            rows = []
            for k1, k2, size, packed, parts in zip(*(c.to_pylist() for c in batch.columns)):
                data = _unpacked(packed, size)
                change = np.zeros(size + 1, np.int64)
                begins, ends = [], []
                for part in parts:
                    at = part["first"]
                    begins += [at + x for x in part["runs"][::2]]
                    ends += [at + x + width - 1 for x in part["runs"][1::2]]
                np.add.at(change, begins, 1)
                np.add.at(change, ends, -1)
                gone = np.cumsum(change)[:-1] > 0
                spans = _runs(gone)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((k1, k2, int(gone.sum()), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans"])

    partly = cut(_packed(texts).join(removed, ["k1", "k2"]).select("k1", "k2", "size", "packed", "parts").mapInArrow(
        apply, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"),
        "partly")
    gone = (F.col("copies").isNotNull()) & (F.col("n_bytes") >= width)
    zero = F.lit(0).cast("bigint")
    return base.join(copies, ["k1", "k2"], "left").join(partly, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
