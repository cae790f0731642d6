"""Vectors as whole numbers, and sums over them that tasks send as few small rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component's size stays under this, so that squared distances of up to 128 components fit in a long.
LIMIT = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in double precision; an error where that is ``LIMIT`` or more in size."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= LIMIT)
    return F.when(far, F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more in size"))).otherwise(scaled).cast("array<int>")


def sound(vector: Column) -> Column:
    """Whether a vector is there and every component of it is there and finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~broken, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long arrays as rows of 64-bit whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def summed(df: DataFrame, size: int, add) -> np.ndarray:
    """``size`` sums over all rows: ``add(total, batch)`` adds a batch to a task's own sums.

    A task sends its sums that are not zero, ``size`` small rows at most, whatever its
    rows; they meet by their place, and the driver gets ``size`` numbers at most.
    """

    def sums(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "total"])

    out = np.zeros(size, np.int64)
    for r in df.mapInArrow(sums, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[r["at"]] = r["total"]
    return out
