"""Near-duplicates by SimHash fingerprints linked through BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree on one of ``radius + 1`` blocks of bits, so the fingerprints
that share a block form a shard, and every link lies within a shard. Each shard is a BK-tree:
a node's children are keyed by their Hamming distance to it, and a search follows only the edges
within the radius of its own distance. Shards are sent to tasks, many small ones to one; a shard that
is too large is parted again by the bits left, and what is still too large goes to tasks as
pairs of parts. Tasks return spanning links, and components are found by label propagation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, cut, table, text_or_empty

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
SHARD = 2_048  # fingerprints in one tree
TASK_ROWS = 16_384  # fingerprints, of however many shards, in one task
LEVELS = 2  # of parting by blocks of bits
FRONTIER = 1 << 21  # open (query, node) pairs of one search

_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: only ASCII letters and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = [0, *(ends[:-SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1:].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS_OF_BYTE).ravel()  # bit 0 first
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash and fp of every whole text; null counts as empty, and a text without words
    has fp 0."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def masks(radius: int, levels: int) -> list[list[int]]:
    """Per level the masks that shards share: entry ``i * (radius + 1) + j`` of a level adds block j
    of the bits that entry i of the level above leaves."""
    out, parents = [], [0]
    for _ in range(levels):
        children = []
        for mask in parents:
            left = [b for b in range(BITS) if not mask >> b & 1]
            for part in np.array_split(left, radius + 1):
                children.append(mask | sum(1 << int(b) for b in part))
        out.append(children)
        parents = children
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class BKForest:
    """BK-trees of several shards in flat arrays; a tree's first fingerprint is its root."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        """``shard`` numbers the tree of each point and is sorted."""
        self.points, self.shard = points, shard
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(starts, np.diff(np.r_[starts, len(shard)]))
        parents, distances, children = [], [], []
        item = np.setdiff1d(np.arange(len(points)), starts)
        node = self.root[item]
        while len(item):
            distance = np.bitwise_count(points[item] ^ points[node]).astype(np.int64)
            edge = node * (BITS + 1) + distance
            _, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            parents.append(node[first])
            distances.append(distance[first])
            children.append(item[first])
            rest = np.ones(len(item), bool)
            rest[first] = False  # the first to take an edge becomes the node at its end
            node, item = item[first][inverse][rest], item[rest]
        edges = np.concatenate(parents) * (BITS + 1) + np.concatenate(distances) if parents else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edges = edges[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def within(self, points: np.ndarray, roots: np.ndarray, radius: int):
        """(query, point, distance) of everything within the radius of the queries, in blocks."""
        tree_size = np.bincount(self.root, minlength=len(self.points))
        block = np.cumsum(tree_size[roots]) // FRONTIER
        for b in np.unique(block):
            query = np.flatnonzero(block == b)
            node = roots[query]
            while len(query):
                distance = np.bitwise_count(points[query] ^ self.points[node]).astype(np.int64)
                near = distance <= radius
                if near.any():
                    yield query[near], node[near], distance[near]
                low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right")
                count = high - low
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                query, node = np.repeat(query, count), self.children[at]


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give the ends of every pair, and what hangs together with them, the smallest label."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def spanning_links(points: np.ndarray, shard: np.ndarray, part: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different points by shard: links that connect in each shard whatever its links connect. Points of
    part 1 only search for points of part 0; where a shard has no part 1, all search."""
    order = np.lexsort((points, part, shard))
    points, shard, part = points[order].astype(np.uint64), shard[order], part[order]
    tree = np.flatnonzero(part == 0)
    forest = BKForest(points[tree], shard[tree])
    searching = np.isin(shard, shard[part == 1])
    asks = np.flatnonzero(~searching | (part == 1))
    at = np.searchsorted(shard[tree], shard[asks])
    found = at < len(tree)
    found[found] = shard[tree][at[found]] == shard[asks][found]
    asks, roots = asks[found], at[found]
    label = np.arange(len(points))
    for query, node, _ in forest.within(points[asks], roots, radius):
        left, right = asks[query], tree[node]
        _merge(label, left[left != right], right[left != right])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return points[linked].astype(np.int64), points[label[linked]].astype(np.int64)


def _shards(rows: DataFrame, parent: Column | None, level: list[int], radius: int) -> DataFrame:
    """(fp, mask, key): the shards of each fingerprint; ``parent`` numbers its mask a level above."""
    if parent is None:
        choices = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                            for i, m in enumerate(level)])
    else:
        values = F.array(*[F.lit(_signed(m)) for m in level])
        choices = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.struct(
            (parent * (radius + 1) + j).alias("mask"),
            F.col("fp").bitwiseAND(F.element_at(values, parent * (radius + 1) + j + 1)).alias("key")))
    return rows.select("fp", F.inline(choices))


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, task_rows: int = TASK_ROWS,
          levels: int = LEVELS) -> DataFrame:
    """(fp, other): links between different fingerprints that connect whatever lies within the
    radius. ``points`` holds each fingerprint once."""
    jobs = []  # rows (fp, job columns): one search each
    rows, parent = points.select("fp"), None
    for depth, level in enumerate(masks(radius, levels)):
        dealt = cut(_shards(rows, parent, level, radius), "shards")
        sizes = cut(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        sized = dealt.join(sizes, ["mask", "key"])
        jobs.append(sized.filter(F.col("size") <= shard).select(
            "fp", F.lit(depth).alias("depth"), "mask", "key", F.lit(0).alias("a"), F.lit(0).alias("b"),
            F.lit(0).alias("part")))
        if sizes.filter(F.col("size") > shard).limit(1).count() == 0:
            break
        rows, parent = sized.filter(F.col("size") > shard).select("fp", "mask", "size"), F.col("mask")
        if depth == levels - 1:
            # still too large: every pair of parts of such a shard is a search of its own
            n = F.ceil(F.col("size") / F.lit(shard)).cast("int")
            own = sized.filter(F.col("size") > shard).withColumn("n", n).withColumn(
                "own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
            pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(
                F.least(x, F.col("own")).alias("a"), F.greatest(x, F.col("own")).alias("b"),
                (x < F.col("own")).cast("int").alias("part")))
            jobs.append(own.select("fp", F.lit(depth + 1).alias("depth"), "mask", "key", F.inline(pairs)))
    work = jobs[0]
    for more in jobs[1:]:
        work = work.unionByName(more)
    work = cut(work, "work")
    job = F.xxhash64("depth", "mask", "key", "a", "b")
    tasks = max(1, -(-work.count() // task_rows))

    def search(batch: pa.Table) -> pa.Table:
        left, right = spanning_links(batch["fp"].to_numpy(), batch["job"].to_numpy(), batch["part"].to_numpy(), radius)
        return pa.table({"fp": pa.array(left, pa.int64()), "other": pa.array(right, pa.int64())})

    return work.select("fp", job.alias("job"), "part", F.pmod(job, F.lit(tasks)).alias("task")).groupBy(
        "task").applyInArrow(search, "fp bigint, other bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest fingerprint reachable, for every fingerprint with a link."""
    both = cut(edges.select("fp", "other").unionByName(edges.select(F.col("other").alias("fp"), F.col("fp").alias("other"))), "edges")
    labels = cut(both.groupBy("fp").agg(F.min("other").alias("low")).select(
        "fp", F.least("fp", "low").alias("label")), "labels")
    while True:
        heard = both.join(labels, "fp").groupBy(F.col("other").alias("fp")).agg(F.min("label").alias("heard"))
        lower = cut(labels.join(heard, "fp").select(
            "fp", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("changed")), "labels")
        if lower.filter("changed").limit(1).count() == 0:
            return lower.select("fp", "label")
        # a label is a fingerprint with a label of its own, which is as low or lower
        of_label = lower.select(F.col("fp").alias("label"), F.col("label").alias("lowest"))
        labels = cut(lower.join(of_label, "label").select("fp", F.col("lowest").alias("label")), "labels")


def _grouped(printed: DataFrame, radius: int, sizes: dict) -> DataFrame:
    """(fp, first): for every fingerprint the first row of its component, by id (null ids last) and
    then by the hash of the text."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    points = cut(printed.groupBy("fp").agg(F.min(row).alias("first")), "points")
    found = components(links(points, radius, **sizes))
    placed = cut(points.join(found, "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")), "placed")
    lowest = cut(placed.groupBy("label").agg(F.min("first").alias("first")), "lowest")
    return cut(placed.drop("first").join(lowest, "label").select("fp", "first"), "grouped")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text",
                    **sizes) -> DataFrame:
    """doc_id, fingerprint and component_id, a row per document.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id
    reachable over links, null only where no document of the component has an id. Null, empty and
    wordless texts share fingerprint zero, which links like any other. Rows repeated with their
    id give a row each; other columns are not read.
    """
    printed = cut(fingerprints(docs, id_column, text_column), "fingerprints")
    return printed.join(_grouped(printed, radius, sizes), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id",
                         text_column: str = "text", **sizes) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id stays (of
    null ids, and of an id with several texts, that with the smallest hash of its text). The
    columns are those of ``docs``; a row repeated with id and text stays as often."""
    printed = cut(fingerprints(docs, id_column, text_column), "fingerprints")
    stay = cut(_grouped(printed, radius, sizes).select("first").distinct().select(
        F.col("first.doc_id").alias("_stay_id"), F.col("first.text_hash").alias("_stay_hash")), "stay")
    same = F.col(id_column).eqNullSafe(F.col("_stay_id")) & (
        F.xxhash64(text_or_empty(text_column)) == F.col("_stay_hash"))
    return docs.join(stay, same, "left_semi")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
