"""Vectors on a grid of whole numbers: floored components, exact inner products, best rows of a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, staged

#: Fixed value: a component x counts as floor(GRID * x).
GRID = 256
#: Ends of a long; a score beyond them counts as the end.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
NONE = -np.inf


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("vec")
        vec = batch.column(at)
        flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        sizes = pc.fill_null(pc.list_value_length(vec), 0).to_numpy()
        begin = np.cumsum(sizes) - sizes
        valid = np.asarray(vec.is_valid())
        codes: list = [None] * len(vec)
        for dim in np.unique(sizes[valid]).tolist():
            rows = np.flatnonzero(valid & (sizes == dim))
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.floor(GRID * flat[begin[rows][:, None] + np.arange(dim)])
            whole = np.isfinite(grid).all(axis=1)
            small = (np.abs(grid) < 32768).all(axis=1)
            short = grid[whole & small].astype("<i2")
            for i, c in zip(rows[whole & small].tolist(), short, strict=True):
                codes[i] = c.tobytes()
            for i, c in zip(rows[whole & ~small].tolist(), grid[whole & ~small].astype("<f8"), strict=True):
                codes[i] = c.tobytes()
        arrays = [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(sizes.astype(np.int32)), pa.array(codes, pa.binary())]
        names = [n for n in batch.schema.names if n != "vec"] + ["dim", "code"]
        yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array([c is not None for c in codes], pa.bool_()))


def floored(df: DataFrame, id_col: str, vec_col: str, name: str, **more: Column) -> DataFrame:
    """(row, id, *more, dim, code), staged: a row a usable vector, with a number of its own.

    Vectors that are null or hold a null or non-finite component (or one that 256 times is
    none) are left out. Codes are 16-bit whole numbers where they fit, doubles elsewhere.
    """
    rows = df.select(col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in more.items()], col(vec_col).cast("array<double>").alias("vec"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "vec")
    coded = rows.mapInArrow(_floored, f"{kinds}, dim int, code binary")
    return staged(coded.select(F.monotonically_increasing_id().alias("row"), *coded.columns), name)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns anew, so that a table can be grouped together with another part of itself."""
    return df.toDF(*df.columns)


def matrix(codes: list[bytes], dim: int) -> np.ndarray:
    """Codes as rows of doubles (whole numbers)."""
    if not codes or not dim:
        return np.zeros((len(codes), dim))
    if all(len(c) == 2 * dim for c in codes):
        return np.frombuffer(b"".join(codes), "<i2").reshape(len(codes), dim).astype(np.float64)
    return np.stack([np.frombuffer(c, "<i2" if len(c) == 2 * dim else "<f8").astype(np.float64) for c in codes])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b without rounding: as doubles where these are exact, else as Python's whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return whole(a) @ whole(b).T


def alike(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Products that can be added without rounding: all as Python's numbers if any is."""
    if all(p.dtype != object for p in parts):
        return parts
    return [p if p.dtype == object else np.array([[int(s) for s in row] for row in p], dtype=object).reshape(p.shape) for p in parts]


def as_long(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64) if scores.dtype != object else np.array([min(max(int(s), LEAST), MOST) for s in scores], dtype=np.int64)


def ids_of(table: pa.Table, name: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null) and which are null."""
    ids = table.column(name)
    return pc.fill_null(ids, 0).to_numpy(), np.asarray(ids.is_null())


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each group, equal ones by ascending id (null last)."""
    order = np.lexsort((ids, null, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]
