"""Vectors as short codes: product quantisation in exact whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.quantised import matrix, sound, summed, whole
from folioflow.llm.shared import Workspace, join_counted, prepare

#: Unit roundoff of single precision.
_U = 2.0**-24


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row's nearest entry, the smaller of several, and the squared distance to it; exact.

    What tells entries apart is |c|^2 - 2 x.c. It is taken by one matrix product in
    single precision. A value is off by at most g = m u / (1 - m u) times the sum of its
    terms' sizes, where u is the unit roundoff and m the number of roundings that a term
    can pass: two conversions, a product, up to d additions, the square's rounding and
    the last addition. By Cauchy and Schwarz the sizes come to at most
    2 |x| |c| + |c|^2, so each value is an interval that surely holds the true one.
    Every entry whose interval reaches down to the least upper end is worked out again
    in 64-bit whole numbers, and the least of these decides.
    """
    n, d = x.shape
    square = (entries * entries).sum(1)
    value = x.astype(np.float32) @ (-2 * entries).astype(np.float32).T + square.astype(np.float32)
    m = d + 5
    long_x, long_c = np.sqrt((x.astype(float) ** 2).sum(1)), np.sqrt(square.astype(float))
    reach = m * _U / (1 - m * _U) * (2 * long_x[:, None] * long_c + long_c**2) * (1 + 2.0**-20)
    value = value.astype(float)
    rows, columns = np.nonzero(value - reach <= (value + reach).min(1)[:, None])
    exact = ((x[rows] - entries[columns]) ** 2).sum(1)
    least = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(n))) if n else exact
    hit = np.flatnonzero(exact == least[rows])[::-1]
    own = np.empty(n, np.int64)
    own[rows[hit]] = columns[hit]  # the first of several is written last
    return own, least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and part the nearest entry of that part's codebook and the squared distance; books: part, entry, place."""
    parts, _, d = books.shape
    both = [screened(x[:, p * d : p * d + d], books[p]) for p in range(parts)]
    return np.column_stack([b[0] for b in both]), np.column_stack([b[1] for b in both])


def coded(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dimensions: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that is there with all components finite.

    A component becomes floor(``scale`` * x); a vector is cut into ``parts`` equal parts. The
    codebook of a part position starts as that part of the ``entries`` rows (256 at
    most) of least id (then of least vector; null ids last), of all rows if there are fewer. In
    each round every part goes to the nearest entry (squared Euclidean distance, the
    smaller place of several), and an entry with parts becomes their componentwise
    floor(sum / count); others stay. Then parts are assigned once more: ``code`` has two
    hex digits a part, ``error`` is the sum of the squared distances, ``label_error`` its
    sum over the rows of equal label, nulls together, and ``codebooks_sha256`` is of all
    components by part, entry and place, joined by commas.

    A task screens its batches in single precision (``screened``) and sends only its own sums
    for each entry, so nothing but codebooks passes the driver. Sums by label are
    taken in the tasks first, and frequent labels go back to their rows by broadcast.

    Vectors have ``dimensions`` components, or as many as most have (the fewer of equally
    frequent ones), a multiple of ``parts``; vectors of another length can't be cut alike and take no part.
    Repeated ids are rows of their own. A component of which ``scale`` times is 2 ** 27 or
    more in size is an error. Extra columns are not read. Without vectors the result is empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    prepare(spark)
    work = Workspace(spark, "vector-codes")
    seen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.struct(F.col(label_col).alias("label")).alias("label")).where(sound(F.col("v")))
    kind = seen.schema["id"].dataType.simpleString()
    if dimensions is None:
        most = seen.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").first()
        dimensions = most["d"] if most else 0
    if dimensions % parts:
        raise ValueError(f"vectors of {dimensions} components can't be cut into {parts} equal parts")
    kept = work.keep(seen.where((F.size("v") == dimensions) & (F.size("v") > 0)).select("id", "label", whole(F.col("v"), scale).alias("v")), "kept")
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)

    for _ in range(rounds):
        # the last place of an entry's row counts its parts
        total = summed(kept.select("v"), books.size + books.shape[0] * books.shape[1], _sums(books)).reshape(*books.shape[:2], -1)
        books = np.where(total[..., -1:] > 0, total[..., :-1] // np.maximum(total[..., -1:], 1), books)

    def code(batches):
        for batch in batches:
            codes, errors = [], np.empty(0, np.int64)
            if batch.num_rows:
                own, far = assigned(matrix(batch.column(2)), books)
                digits, errors = own.astype(np.uint8).tobytes().hex(), far.sum(1)
                codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    rows = work.keep(kept.mapInArrow(code, f"id {kind}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"), "rows")
    by_label = work.keep(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")), "labels")
    spelt = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return join_counted(rows, by_label, ["label"]).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(spelt).alias("codebooks_sha256"))


def _sums(books: np.ndarray):
    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x = matrix(batch.column(0))
        own, _ = assigned(x, books)
        each = np.concatenate([x.reshape(len(x), books.shape[0], -1), np.ones((len(x), books.shape[0], 1), np.int64)], axis=2)
        np.add.at(total.reshape(*books.shape[:2], -1), (np.arange(books.shape[0]), own), each)

    return add
