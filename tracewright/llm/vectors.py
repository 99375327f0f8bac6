"""Embeddings as whole numbers, for operators whose results must be exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole components lie within this, so that sums over some hundred squares of differences fit in 64 bits.
BOUND = 1 << 27


def quantised(rows: DataFrame, vec_col: str, scale: int = 256, dim: int | None = None) -> DataFrame:
    """The other columns of rows and `vec`: floor(scale * x) of each component, as little-endian 32-bit integers.

    Rows whose vector is null, holds a null or non-finite component or, with dim, has another length are left out.
    A component beyond BOUND is an error.
    """
    others = [c for c in rows.columns if c != vec_col]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            whole = np.floor(scale * np.where(np.isfinite(x), x, 0.0))
            at = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
            if dim is not None:
                ok &= size == dim
            inside = np.repeat(ok, size)
            if (np.abs(whole[inside]) > BOUND).any():
                raise ValueError(f"a component is beyond {BOUND} after scaling by {scale}")
            keep = pa.array(np.flatnonzero(ok), pa.int64())
            data, ends = whole[inside].astype("<i4"), np.concatenate([[0], np.cumsum(4 * size[ok])]).astype(np.int32)
            vec = pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(keep) for i in range(len(others))), vec], names=[*others, "vec"])

    read = rows.select(*others, F.col(vec_col).cast("array<double>").alias("__v"))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "vec binary"]))


def stacked(vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    raw = vecs.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), len(raw[0]) // 4 if raw else 0)
