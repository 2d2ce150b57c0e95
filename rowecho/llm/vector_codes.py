"""Vectors compressed to product codes: integer k-means over Hilbert-sorted blocks with boxes and sums.

Vectors become integers and are cut into equal parts. A task packs its rows into chunks, written
once. In a chunk the subvectors of each part lie in the order of their Hilbert keys, in flat blocks that carry the
least and greatest value of each dimension (the box) and the sum of their rows. A round asks the boxes first: an entry
whose least distance to a box exceeds the least of all greatest distances is nearest to no row of the
block. What is left is the block's shortlist. A block with one entry on it is assigned as a whole by its sum; the
others go through an integer kernel over their shortlist. Tasks return one sum per entry,
so no row is shuffled in a round, whatever vectors are frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, cut, table
from rowecho.llm.vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 32  # rows with one box
CHUNK_ROWS, CHUNK_VALUES = 1 << 15, 1 << 21  # rows and components of a chunk at most
KERNEL_VALUES = 1 << 20  # distances computed at once
KEY_BITS = 62


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point (rows of integers) on a Hilbert curve through their bounding box; dimensions beyond
    ``KEY_BITS`` do not count, and values are rounded down to the bits there are."""
    n, dims = points.shape[0], min(points.shape[1], KEY_BITS)
    if not n or not dims:
        return np.zeros(n, np.uint64)
    bits = KEY_BITS // dims
    low = points.min(axis=0)
    wide = int((points.max(axis=0) - low).max()).bit_length()
    bits = max(1, min(bits, wide))
    axes = [((points[:, i].astype(np.int64) - low[i]) >> max(0, wide - bits)).astype(np.uint64) for i in range(dims)]
    bit = 1 << bits - 1
    while bit > 1:  # undo the turns of the curve, coarse to fine
        below, mark = np.uint64(bit - 1), np.uint64(bit)
        for i in range(dims):
            turned = (axes[i] & mark) != 0
            swap = np.where(turned, np.uint64(0), (axes[0] ^ axes[i]) & below)
            axes[i] = axes[i] ^ swap
            axes[0] = axes[0] ^ np.where(turned, below, swap)
        bit >>= 1
    for i in range(1, dims):
        axes[i] = axes[i] ^ axes[i - 1]
    flip, bit = np.zeros(n, np.uint64), 1 << bits - 1
    while bit > 1:
        flip ^= np.where((axes[-1] & np.uint64(bit)) != 0, np.uint64(bit - 1), np.uint64(0))
        bit >>= 1
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (axes[i] ^ flip) >> np.uint64(level) & np.uint64(1)
    return key


class Chunk:
    """The blocks of one chunk: for each part the rows in Hilbert order, boxes and sums."""

    def __init__(self, order: np.ndarray, data: np.ndarray):
        self.order, self.data = order, data  # (parts, rows), (parts, rows, width)
        self.starts = np.arange(0, data.shape[1], BLOCK)
        self.low, self.high = None, None
        self.sums = None

    @classmethod
    def build(cls, vectors: np.ndarray, parts: int) -> Chunk:
        n = len(vectors)
        split = vectors.reshape(n, parts, -1).transpose(1, 0, 2)
        order = np.stack([np.argsort(hilbert_keys(p), kind="stable") for p in split]).astype(np.int32)
        chunk = cls(order, np.take_along_axis(split, order[:, :, None].astype(np.int64), axis=1))
        chunk.low = np.minimum.reduceat(chunk.data, chunk.starts, axis=1)
        chunk.high = np.maximum.reduceat(chunk.data, chunk.starts, axis=1)
        chunk.sums = np.add.reduceat(chunk.data.astype(np.int64), chunk.starts, axis=1)
        return chunk

    def pack(self) -> list[bytes]:
        small = np.abs(self.data).max(initial=0) < 1 << 15
        return [self.order.tobytes(), self.data.astype(np.int16 if small else np.int32).tobytes(),
                np.stack([self.low, self.high]).astype(np.int32).tobytes(), self.sums.tobytes()]

    @classmethod
    def unpack(cls, rows: int, parts: int, packed: list[bytes]) -> Chunk:
        order, data, boxes, sums = packed
        small = len(data) < rows * 4 * (len(sums) // 8 // -(-rows // BLOCK))
        values = np.frombuffer(data, np.int16 if small else np.int32).astype(np.int32).reshape(parts, rows, -1)
        chunk = cls(np.frombuffer(order, np.int32).reshape(parts, rows), values)
        chunk.low, chunk.high = np.frombuffer(boxes, np.int32).reshape(2, parts, len(chunk.starts), -1)
        chunk.sums = np.frombuffer(sums, np.int64).reshape(parts, len(chunk.starts), -1)
        return chunk

    def shortlists(self, part: int, entries: np.ndarray) -> np.ndarray:
        """(blocks, entries): which entries can be nearest to a row of the block. Of entries at one
        distance all are kept."""
        low, high = (x[part].astype(np.int64)[:, None, :] for x in (self.low, self.high))
        each = entries.astype(np.int64)[None]
        least = (np.maximum(np.maximum(low - each, each - high), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(each - low), np.abs(each - high)) ** 2).sum(axis=2)
        return least <= most.min(axis=1)[:, None]

    def assign(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each block or -1, entries of the rows of the blocks with -1, which rows those are)."""
        listed = self.shortlists(part, entries)
        sizes = listed.sum(axis=1)
        whole = np.where(sizes == 1, listed.argmax(axis=1), -1)
        rows, n = self.data[part], self.data.shape[1]
        open_ = whole < 0
        in_open = np.repeat(open_, BLOCK)[:n]
        codes = np.zeros(n, np.int64)
        # numbers below 2^13 leave their squared distances room in 32 bits
        kind = np.int32 if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 13 and entries.shape[
            1] <= 8 else np.int64
        entries = entries.astype(kind)
        longest = 2
        while open_.any():
            blocks = np.flatnonzero(open_ & (sizes <= longest))
            open_ &= sizes > longest
            at_once = max(1, KERNEL_VALUES // (BLOCK * longest))
            for some in (blocks[i:i + at_once] for i in range(0, len(blocks), at_once)):
                # candidates in ascending order, the last one again where there are fewer
                rank = np.argsort(~listed[some], axis=1, kind="stable")[:, :longest]
                rank = np.take_along_axis(rank, np.minimum(np.arange(rank.shape[1]), sizes[some, None] - 1), axis=1)
                at = np.minimum(some[:, None] * BLOCK + np.arange(BLOCK), n - 1)
                far = np.zeros((len(some), BLOCK, rank.shape[1]), kind)
                for i in range(rows.shape[1]):
                    far += (rows[at, i].astype(kind)[:, :, None] - entries[rank, i][:, None, :]) ** 2
                codes[at] = np.take_along_axis(rank, far.argmin(axis=2), axis=1)
            longest *= 2
        return whole, codes[in_open], in_open


def _chunks(vectors: DataFrame, dims: int, parts: int) -> DataFrame:
    """(n, vec_ids, labels, order, data, boxes, sums): every row packed, the rows of a task in chunks."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    padded = -(-dims // parts) * parts
    most = max(BLOCK, min(CHUNK_ROWS, CHUNK_VALUES // padded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            labels = pa.concat_arrays([b.column(1) for b in held])
            values = np.zeros((n, padded), np.int32)
            values[:, :dims] = np.concatenate([matrix(b.column(2)) for b in held])
            one = pa.array([0, n], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels),
                 *(pa.array([x], pa.binary()) for x in Chunk.build(values, parts).pack())],
                ["n", "vec_ids", "labels", "order", "data", "boxes", "sums"])

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

    return vectors.mapInArrow(
        run, f"n int, vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, order binary, data binary, "
        "boxes binary, sums binary")


def _round(chunks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its rows' mean, unused ones as they were."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last one counts
        for batch in batches:
            for row in range(batch.num_rows):
                n, *packed = (batch.column(i)[row].as_py() for i in range(batch.num_columns))
                chunk = Chunk.unpack(n, parts, packed)
                ends = np.r_[chunk.starts[1:], n]
                for part in range(parts):
                    whole, codes, which = chunk.assign(part, codebooks[part])
                    done = whole >= 0
                    np.add.at(sums[part, :, :width], whole[done], chunk.sums[part][done])
                    np.add.at(sums[part, :, width], whole[done], (ends - chunk.starts)[done])
                    rows = chunk.data[part][which]
                    for i in range(width):  # far below 2^53, so exact
                        sums[part, :, i] += np.bincount(codes, rows[:, i], entries).astype(np.int64)
                    sums[part, :, width] += np.bincount(codes, minlength=entries)
        at = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(sums.ravel()[at])], ["place", "total"])

    totals = np.zeros(parts * entries * (width + 1), np.int64)
    found = chunks.select("n", "order", "data", "boxes", "sums").mapInArrow(run, "place int, total bigint")
    for r in found.groupBy("place").agg(F.sum("total").alias("total")).collect():  # one per number of the codebooks
        totals[r["place"]] = r["total"]
    totals = totals.reshape(parts, entries, width + 1)
    used = totals[:, :, width:]
    return np.where(used > 0, totals[:, :, :width] // np.maximum(used, 1), codebooks)


def _coded(chunks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts = codebooks.shape[0]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema if f.name in ("vec_ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, *packed = (batch.column(i)[row].as_py() for i in (0, 3, 4, 5, 6))
                chunk = Chunk.unpack(n, parts, packed)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for part in range(parts):
                    whole, some, which = chunk.assign(part, codebooks[part])
                    found = np.repeat(whole, BLOCK)[:n]
                    found[which] = some
                    far = ((chunk.data[part] - codebooks[part][found]) ** 2).sum(axis=1)
                    codes[chunk.order[part], part] = found
                    error[chunk.order[part]] += far
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[row].values, batch.column(2)[row].values,
                     pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)],
                    ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"vec_id {kinds['vec_ids']}, label {kinds['labels']}, code string, error bigint")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_column: str = "vec_id", label_column: str = "label",
             vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept row, codebooks (part, entry, position)).

    Rows with a null or empty vector, or one with a component that is null, not finite or 32,768 or more, are dropped, and so
    are vectors whose length is not that of the kept vector with the smallest id. Where the length is no multiple
    of ``parts``, zeros fill it up. The codebooks start as the ``entries`` kept rows that come first by id (null
    ids last) and then by vector, rows repeated with their id among them; there are fewer entries where there are fewer rows. An
    empty table gives an empty result and empty codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hex digits have room for 256 entries")
    vectors = integer_vectors(rows, id_column, label_column, vector_column)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries * 4).collect()
    spark = rows.sparkSession
    if not first:
        empty = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.limit(0), np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0]["v"])
    vectors = vectors.filter(F.size("v") == dims)
    first = [r for r in first if len(r["v"]) == dims]
    if len(first) < entries:  # vectors of other lengths among the first
        first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    width = -(-dims // parts)
    start = np.zeros((min(entries, len(first)), parts * width), np.int64)
    start[:, :dims] = [r["v"] for r in first[:entries]]
    codebooks = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    bounded_batches(spark)
    chunks = cut(_chunks(vectors, dims, parts), "chunks")
    for _ in range(rounds):
        codebooks = _round(chunks, codebooks)
    return _coded(chunks, codebooks), codebooks


def reconstruct(codes: DataFrame, codebooks: np.ndarray, code_column: str = "code") -> DataFrame:
    """The rows of ``codes`` with ``approximation``, the vector of integers that the code stands for (null for null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(len(codebooks))
        for batch in batches:
            found = [None if c is None else codebooks[places, np.frombuffer(bytes.fromhex(c), np.uint8)].ravel()
                     for c in batch.column(code_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "approximation"])

    kept = codes.drop("approximation")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, approximation array<bigint>")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    codes = cut(codes, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    listed = ",".join(map(str, codebooks.ravel().tolist()))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


_ROUND = """
near{n} AS MATERIALIZED (
  SELECT rid, p, min({{'far': list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(s, c)]), 'e': e}}) AS best
  FROM cells JOIN book{n} USING (p) GROUP BY rid, p),
means{n} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, CAST(floor(sum(s[i]) / count(*)) AS BIGINT) AS m
    FROM cells JOIN near{n} USING (rid, p), (SELECT unnest(range(1, (SELECT max(d) FROM cells) + 1)) AS i) GROUP BY p, best.e, i)
  GROUP BY p, e),
book{m} AS MATERIALIZED (
  SELECT p, e, coalesce(means{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN means{n} USING (p, e)),"""

SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (
  SELECT rid, p, len(v) // 16 AS d, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS s
  FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, rid - 1 AS e, s AS c FROM cells WHERE rid <= 64),""" + _ROUND.format(n=0, m=1) + _ROUND.format(
    n=1, m=2) + """
last AS (
  SELECT rid, p, min({'far': list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(s, c)]), 'e': e}) AS best
  FROM cells JOIN book2 USING (p) GROUP BY rid, p),
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error
  FROM last GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), digest
"""
