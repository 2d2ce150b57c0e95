"""Hard negatives by exact search in hyperplane trees whose split points store distance ranges.

A task packs its rows into chunks, each with a multiway tree, written once. A node deals its rows to the nearest of its
split points; for each split point it stores how near and how far the rows of every sibling subtree
are. A search asks for rows whose score (inner product) with the anchor lies in a window. With the norms
of a subtree that window is an annulus of distances around the anchor; a sibling whose stored range of
distances from some split point cannot meet the annulus is left out. Leaves are searched exactly.

Anchors are sent to all chunks in groups of fixed size, twice: for their positives, and for the negatives
in the windows that these set. A task returns the best rows of each window, and the best of all tasks' are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowecho.llm.common import cut, table
from rowecho.llm.vectors import integer_vectors, matrix

POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score that a negative's may have
WAYS = 12  # split points of a node
CANDIDATES = 64  # rows they are taken from
LEAF = 512  # rows searched exactly
CHUNK_ROWS, CHUNK_VALUES = 1 << 15, 1 << 21  # rows and components of a chunk at most
GROUP = 1 << 14  # anchors sent to the tasks at once
TOGETHER = 256  # anchors that go down a tree together
PENDING = 1 << 20  # hits gathered before the best are taken
ROUNDING = 2.0 ** -48  # of the squares a distance is made of: more than their rounding error


class Tree:
    """Rows of a chunk in the order of the leaves, and the nodes over them."""

    def __init__(self, vectors: np.ndarray, nodes: list):
        self.vectors, self.nodes = vectors, nodes

    def _slack(self, norms: np.ndarray) -> float:
        """More than what a distance from these anchors or inside the tree is wrong by."""
        return 4 * np.sqrt((self.nodes[0][3] + norms.max(initial=0)) * ROUNDING)

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order of its rows. A node is (begin, end, least and most squared norm, split points,
        ranges, children), a leaf one without the last three."""
        values = vectors.astype(np.float64)
        norms = (values ** 2).sum(axis=1)
        order = np.arange(len(values))
        nodes: list = []
        todo = [(0, len(values))]
        while todo:
            begin, end = todo.pop(0)
            rows = order[begin:end]
            node = [begin, end, norms[rows].min(), norms[rows].max(), None, None, None]
            nodes.append(node)
            if end - begin <= LEAF:
                continue
            points = cls._split_points(values[rows])
            if points is None:  # all rows are equal
                continue
            far = _distances(values[rows], points)
            owner = far.argmin(axis=1)
            at = np.argsort(owner, kind="stable")
            order[begin:end], far, owner = rows[at], far[at], owner[at]
            edges = np.searchsorted(owner, np.arange(len(points) + 1))
            # every split point is the nearest to itself, so no part is empty
            node[4:] = [points, np.stack([np.minimum.reduceat(far, edges[:-1]), np.maximum.reduceat(far, edges[:-1])]),
                        len(nodes) + len(todo) + np.arange(len(points))]
            todo += [(begin + a, begin + b) for a, b in zip(edges, edges[1:])]
        return cls(values[order], nodes), order

    @staticmethod
    def _split_points(values: np.ndarray) -> np.ndarray | None:
        """Different rows far from each other: of some rows spread over all, each the farthest from those before
        it; of all rows, where those are equal."""
        for some in (values[::max(1, len(values) // CANDIDATES)], values):
            chosen, near = [0], np.full(len(some), np.inf)
            while len(chosen) < WAYS:
                near = np.minimum(near, ((some - some[chosen[-1]]) ** 2).sum(axis=1))
                if not near.any():
                    break
                chosen.append(int(near.argmax()))
            if len(chosen) > 1:
                return some[chosen]
        return None

    def pack(self) -> tuple[bytes, bytes]:
        """(rows, nodes) as bytes. Nodes are in the order in which they were made, children after parents."""
        small = np.abs(self.vectors).max(initial=0) < 1 << 15
        flat = []
        for begin, end, least, most, points, ranges, children in self.nodes:
            flat += [np.array([begin, end, least, most, 0 if points is None else len(points)])]
            if points is not None:
                flat += [points.ravel(), ranges.ravel(), children.astype(np.float64)]
        return self.vectors.astype(np.int16 if small else np.int32).tobytes(), np.concatenate(flat).tobytes()

    @classmethod
    def unpack(cls, rows: bytes, nodes: bytes, n: int, dims: int) -> Tree:
        kind = np.int16 if len(rows) == 2 * n * dims else np.int32
        flat, at, out = np.frombuffer(nodes, np.float64), 0, []

        def taken(count: int) -> np.ndarray:
            nonlocal at
            at += count
            return flat[at - count:at]

        while at < len(flat):
            begin, end, least, most, ways = taken(5)
            ways, node = int(ways), [int(begin), int(end), least, most, None, None, None]
            if ways:
                node[4:] = [taken(ways * dims).reshape(ways, dims), taken(2 * ways * ways).reshape(2, ways, ways),
                            taken(ways).astype(int)]
            out.append(node)
        return cls(np.frombuffer(rows, kind).reshape(n, dims).astype(np.float64), out)

    def search(self, asked: np.ndarray, windows) -> None:
        """Hand the scores of the leaves that can hold a row in a window to ``windows``: ``windows.bounds()`` gives
        the lowest and the highest score each of ``asked`` (rows) still wants, ``windows.take(which, scores, begin)`` the rest."""
        norms = (asked ** 2).sum(axis=1)
        slack = self._slack(norms)
        stack = [(0, np.arange(len(asked)))]
        while stack:
            at, which = stack.pop()
            begin, end, least, most, points, ranges, children = self.nodes[at]
            low, high = windows.bounds()
            low, high = low[which], high[which]
            # score = (|a|^2 + |x|^2 - distance^2) / 2
            outer = np.sqrt(np.maximum(norms[which] + most - 2 * low, 0)) + slack
            inner = np.sqrt(np.maximum(norms[which] + least - 2 * high, 0)) - slack
            alive = (norms[which] + most - 2 * low >= 0) & (low <= high)
            which, outer, inner = which[alive], outer[alive], inner[alive]
            if not len(which):
                continue
            if points is None:
                for at in range(begin, end, LEAF):  # equal rows may be many
                    windows.take(which, asked[which] @ self.vectors[at:min(at + LEAF, end)].T, at)
                continue
            far = _distances(asked[which], points)
            # (anchor, sibling, split point): how far a row of the sibling can be from the anchor
            nearest, farthest, mine = ranges[0][None], ranges[1][None], far[:, None, :]
            may = ((np.maximum(nearest - mine, mine - farthest) <= outer[:, None, None])
                   & (farthest + mine >= inner[:, None, None])).all(axis=2)
            for sibling in np.argsort(-far.mean(axis=0)).tolist():  # the nearest is on top
                if may[:, sibling].any():
                    stack.append((int(children[sibling]), which[may[:, sibling]]))


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of integer rows and points: squares are exact, so only the root is rounded."""
    square = (rows ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1) - 2 * (rows @ points.T)
    return np.sqrt(np.maximum(square, 0))


class _Best:
    """The best rows of each window: highest scores, then smallest ids. ``owner`` is the anchor of each window,
    ``wants(windows, labels)`` which labels suit it, ``own`` the id it leaves out or None."""

    def __init__(self, owner, low, high, labels, same: bool, own, most: int):
        self.owner, self.low, self.high = owner, low.astype(np.float64), high.astype(np.float64)
        self.label, self.same, self.own, self.most = labels, same, own, most
        n = int(owner.max()) + 1 if len(owner) else 0
        self.anchors = n
        self.window = np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int64)
        self.pending, self.size = [], 0
        self.by_anchor = np.argsort(owner, kind="stable")
        self.first = np.searchsorted(owner[self.by_anchor], np.arange(n + 1))

    def on(self, ids: np.ndarray, labels: np.ndarray) -> None:
        self.row_ids, self.row_labels = ids, labels

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.minimum.reduceat(self.low[self.by_anchor], self.first[:-1]),
                np.maximum.reduceat(self.high[self.by_anchor], self.first[:-1]))

    def take(self, which: np.ndarray, scores: np.ndarray, begin: int) -> None:
        counts = self.first[which + 1] - self.first[which]
        line = np.repeat(np.arange(len(which)), counts)
        starts = np.cumsum(counts) - counts
        windows = self.by_anchor[np.repeat(self.first[which] - starts, counts) + np.arange(counts.sum())]
        scores = scores[line]
        hit = (scores >= self.low[windows][:, None]) & (scores <= self.high[windows][:, None])
        at, row = np.nonzero(hit)
        windows, score = windows[at], scores[at, row]
        ids, labels = self.row_ids[begin + row], self.row_labels[begin + row]
        good = (labels == self.label[windows]) == self.same
        if self.own is not None:
            good &= ids != self.own[windows]
        self.pending.append((windows[good], score[good], ids[good]))
        self.size += int(good.sum())
        if self.size > PENDING or self.size > 4 * self.most * len(self.low):
            self.settle()

    def settle(self) -> None:
        window, score, ids = (np.concatenate(x) for x in zip((self.window, self.score, self.ids), *self.pending))
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
        rank = np.arange(len(window)) - np.repeat(first, np.diff(np.r_[first, len(window)]))
        keep = rank < self.most
        last = rank == self.most - 1  # a full window only wants what is as good as its last
        self.low[window[last]] = np.maximum(self.low[window[last]], score[last])
        self.window, self.score, self.ids = window[keep], score[keep], ids[keep]
        self.pending, self.size = [], 0


def _forest(vectors: DataFrame, dims: int) -> DataFrame:
    """(n, vec_ids, labels, rows, nodes): the rows of a task as trees over chunks."""
    most = max(LEAF, min(CHUNK_ROWS, CHUNK_VALUES // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            labels = np.concatenate([b.column(1).to_numpy() for b in held])
            tree, order = Tree.build(np.concatenate([matrix(b.column(2)) for b in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                    ids[order].tobytes(), labels[order].tobytes(), *tree.pack()))], ["n", "vec_ids", "labels", "rows", "nodes"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - n)
                held.append(piece)
                n += piece.num_rows
                at += piece.num_rows
                if n == most:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return vectors.mapInArrow(run, "n int, vec_ids binary, labels binary, rows binary, nodes binary")


def _searched(forest: DataFrame, dims: int, vectors: np.ndarray, windows: dict, same: bool, most: int) -> DataFrame:
    """(window, score, vec_id): what each task finds best in the windows (owner, low, high, label, own of each) around
    ``vectors``, one group of anchors."""
    spark = forest.sparkSession
    sent = spark.sparkContext.broadcast((vectors, windows))  # GROUP anchors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, w = sent.value
        edges = np.searchsorted(w["owner"], np.arange(0, len(vectors) + TOGETHER, TOGETHER))
        parts = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                parts.append((a, vectors[k * TOGETHER:(k + 1) * TOGETHER], _Best(
                    w["owner"][a:b] - k * TOGETHER, w["low"][a:b], w["high"][a:b], w["label"][a:b], same, w["own"][a:b], most)))
        for batch in batches:
            for n, ids, labels, rows, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                tree = Tree.unpack(rows, nodes, n, dims)
                for _, asked, best in parts:
                    best.on(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64))
                    # an anchor without a window is at the end of its part and asks for nothing
                    tree.search(asked[:best.anchors].astype(np.float64), best)
        for begin, _, best in parts:
            best.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.window + begin), pa.array(best.score.astype(np.int64)), pa.array(best.ids)],
                ["window", "score", "vec_id"])

    return forest.mapInArrow(run, "window bigint, score bigint, vec_id bigint")


def _top(found: DataFrame, most: int, *keys: str) -> DataFrame:
    """The best of what tasks have found, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
         highest: int = HIGHEST, id_column: str = "vec_id", label_column: str = "label",
         vector_column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``vec_id`` and ``label``. An anchor's positives are the ``positives`` other rows of its label that
    score highest; a negative has another label and between ``lowest`` and ``highest`` percent of the positive's score, and
    the ``negatives`` best are returned, ties by smaller id, all where there are fewer. Pairs without one have no row.

    Ids and labels are integers. Rows with a null id or label take no part, nor do those with a null or empty vector, with a component that is
    null, not finite or 32,768 or more, or of another length than the vector with the smallest id. Of rows
    with one id, the one with the least label and then vector counts. An empty table gives an empty
    result; other columns are not read.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                      "positive_score bigint, negative_score bigint")
    cast = rows.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"),
        F.col(vector_column).alias("embedding"))
    vectors = integer_vectors(cast)
    first = vectors.orderBy("vec_id", "v").limit(1).collect()
    if not first:
        return empty
    dims = len(first[0]["v"])
    one = vectors.filter(F.size("v") == dims).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select(
        "vec_id", "r.label", "r.v")
    vectors = cut(one, "vectors")
    forest = cut(_forest(vectors, dims), "forest")
    asked = vectors.filter(anchors)
    n = asked.count()
    if not n:
        return empty
    groups = 1 if n <= GROUP else 2 * -(-n // GROUP)
    asked = cut(asked.withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))), "anchors")
    numbers = [r["_group"] for r in asked.select("_group").distinct().collect()]  # two for GROUP anchors
    parts = []
    for number in sorted(numbers):
        own = asked.filter(F.col("_group") == number).orderBy("vec_id").collect()
        for at in range(0, len(own), GROUP):
            parts.append(_mined(spark, forest, dims, own[at:at + GROUP], positives, negatives, lowest, highest))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _mined(spark: SparkSession, forest: DataFrame, dims: int, own: list, positives: int, negatives: int, lowest: int,
           highest: int) -> DataFrame:
    """The negatives of one group of anchors, written."""
    ids = np.array([r["vec_id"] for r in own], np.int64)
    labels = np.array([r["label"] for r in own], np.int64)
    vectors = np.array([r["v"] for r in own], np.int32)
    n = len(own)
    around = {"owner": np.arange(n), "low": np.full(n, -np.inf), "high": np.full(n, np.inf), "label": labels, "own": ids}
    found = _top(_searched(forest, dims, vectors, around, True, positives), positives, "window")
    # the positives of GROUP anchors at most
    pairs = sorted((r["window"], r["rank"], r["score"], r["vec_id"]) for r in found.collect())
    owner, _, score, positive = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 4
    windows = {"owner": owner, "low": -(-lowest * score // 100), "high": highest * score // 100, "label": labels[owner],
               "own": ids[owner]}
    negative = _top(_searched(forest, dims, vectors, windows, False, negatives), negatives, "window")
    named = spark.createDataFrame(pa.table({
        "window": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score}))
    return cut(negative.join(F.broadcast(named), "window").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, "vec_id % 100 = 0")


SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10
"""
