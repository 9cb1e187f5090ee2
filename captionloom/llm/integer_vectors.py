"""Embeddings as integers, and searches of a stated query set over them in blocks: what operators 11 and 13 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of this size or more would let a score leave 64 bits.
LARGEST = 1 << 28


def whole(x: Column) -> Column:
    """floor(256 * x), x as double."""
    return F.floor(x.cast("double") * 256)


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **more: Column) -> DataFrame:
    """(vec_id, vector array<int>, more) of the rows that take part, each distinct one once.

    Left out are rows without an id, without a vector, with a null in `more`, or with a component that is null, not
    finite, or 2**28 and more as an integer. Vectors that are shorter than others count as filled with zeros.
    """
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / 256))
    held = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *[c.alias(n) for n, c in more.items()])
    good = held.where(F.col("v").isNotNull() & F.coalesce(fits, F.lit(False))).dropna(subset=["vec_id", *more])
    return good.select("vec_id", F.transform("v", whole).cast("array<int>").alias("vector"), *more).distinct()


def matrix(rows: pa.Table, name: str = "vector", width: int = 0) -> np.ndarray:
    """A column of integer lists as rows of doubles, filled with zeros up to the longest or `width`."""
    held = rows[name].combine_chunks()
    sizes = np.diff(held.offsets.to_numpy()) if len(held) else np.zeros(0, np.int64)
    out = np.zeros((len(held), max([width, *sizes])))
    if len(held):
        out[np.arange(out.shape[1]) < sizes[:, None]] = held.flatten().to_numpy(zero_copy_only=False)
    return out


def padded(*parts: np.ndarray) -> list[np.ndarray]:
    """The same arrays with as many columns as the widest. Integers where sums of products may leave a double's 53 bits."""
    most = max(p.shape[1] for p in parts)
    wide = [np.pad(p, ((0, 0), (0, most - p.shape[1]))) for p in parts]
    largest = max([0.0, *(float(np.abs(p).max()) for p in wide if p.size)])
    return [p.astype(np.int64) for p in wide] if most * largest**2 >= 1 << 53 else wide


def firsts(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, limit: int) -> np.ndarray:
    """Places of each row's `limit` highest scores, by row, then score, then smaller id."""
    order = np.lexsort((vec_id, -score, row))
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < limit]
