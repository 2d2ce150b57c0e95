"""Embedding rows as integers: what the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowecho.llm.common import bounded_batches

SCALE = 256  # a component x counts as floor(SCALE * x)
LARGEST = 1 << 15  # components this large or larger are left out: products of them are not exact in 64 bits


def to_integers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, integers): rows of an array of vectors that are kept, in groups of one length.

    Null and empty vectors go, and those with a component that is null, not finite or not below ``LARGEST``.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    places, integers = [], []
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        values = flat.astype(np.float64).reshape(-1, length)  # a null is not a number
        with np.errstate(invalid="ignore"):
            good = (np.isfinite(values) & (np.abs(values) < LARGEST)).all(axis=1)
        places.append(at[good])
        integers.append(np.floor(values[good] * SCALE).astype(np.int32))
    return places, integers


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", label_column: str = "label",
                    vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows with their vector as integers; rows that ``to_integers`` leaves out are missing.
    The order of rows inside a task is not kept."""
    bounded_batches(rows.sparkSession)
    narrow = rows.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"),
                         F.col(vector_column).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in zip(*to_integers(batch.column(2))):
                ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))], ["vec_id", "label", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>")


def matrix(lists: pa.Array) -> np.ndarray:
    """The lists of one length as rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
