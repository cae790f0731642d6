"""Clusters by Lloyd's rounds over the distinct vectors, each weighted by its copies."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.quantised import matrix, sound, summed, whole
from folioflow.llm.shared import Workspace, join_counted, prepare


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centre, the smaller of several, and the squared distance to it; exact.

    Matrix products of doubles are exact while no sum can leave 2 ** 53; beyond that
    the same products are taken in 64-bit whole numbers.
    """
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    kind = np.float64 if 4 * largest * largest * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), centres.astype(kind)
    far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    own = far.argmin(1)
    return own, far[np.arange(len(x)), own].astype(np.int64)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Those have exactly ``dimensions`` components, none null or not finite; each becomes
    floor(``scale`` * x). Rows with equal whole-number vectors are one distinct vector
    with a multiplicity: the rounds go over the distinct vectors only, with sums
    weighted by it, and their assignments are joined back to the rows. A vector that
    a third of all rows have is counted by each task before it is shuffled, and goes
    back to its rows by broadcast.

    Centroids start as the ``k`` rows of least sha256 of ``seed``:id (then of least vector;
    null ids last), all rows if there are fewer. In each round every vector goes to the
    nearest centroid (squared Euclidean distance, the smaller number of several), and
    a centroid with vectors becomes their componentwise floor(sum / count); others stay.
    After the rounds vectors are assigned once more. ``distance`` is the squared one,
    ``cluster_inertia`` and ``inertia`` are its sums over the cluster and over all rows,
    ``centroid_sha256`` is of the final centroid's components, joined by commas.

    Repeated ids are rows of their own, a null id is a value like any other. A component
    of which ``scale`` times is 2 ** 27 or more in size is an error. Extra columns are not
    read. Without vectors the result is empty.
    """
    spark = vectors.sparkSession
    prepare(spark)
    work = Workspace(spark, "centroids")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(sound(F.col("v")) & (F.size("v") == dimensions))
    kept = work.keep(kept.select("id", whole(F.col("v"), scale).alias("v")), "kept")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    result = f"{id_col} {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centres = np.array([r["v"] for r in first], np.int64)
    distinct = work.keep(kept.groupBy("v").agg(F.count("*").alias("n")), "distinct")

    for _ in range(rounds):
        # the last column of a centre's row counts its vectors
        total = summed(distinct, centres.size + len(centres), _weighted(centres)).reshape(len(centres), -1)
        used = total[:, -1] > 0
        centres = np.where(used[:, None], total[:, :-1] // np.maximum(total[:, -1:], 1), centres)

    def assign(batches):
        for batch in batches:
            own, far = nearest(matrix(batch.column(0)), centres) if batch.num_rows else (np.empty(0, int), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["v", "n", "cluster", "distance"])

    assigned = work.keep(distinct.mapInArrow(assign, "v array<int>, n long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("total")).collect()}  # k rows at most
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres.tolist())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = join_counted(kept, assigned, ["v"]).join(F.broadcast(told), "cluster")  # a row for each of the k centroids
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _weighted(centres: np.ndarray):
    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x, n = matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.int64)
        own, _ = nearest(x, centres)
        np.add.at(total.reshape(len(centres), -1), own, np.column_stack([x, np.ones(len(x), np.int64)]) * n[:, None])

    return add


