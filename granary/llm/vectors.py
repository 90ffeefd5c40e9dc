"""What the vector operators share: which vectors take part, and rows packed to bounded blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>): one row a vec_id that is not null, with a vector that is not null or zero,
    whose components are finite and not null, and that has the dimension most vectors have (ties: the larger one).
    Of several vectors with one vec_id the smallest, component by component, stands for it."""
    fine = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = fine.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    top = fine.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return fine.where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
