"""Nearest neighbours by an inverted multi-index."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import Workspace, prepare


def usable(vector: str, dimensions: int) -> Column:
    """Whether a vector takes part: of the right length, finite in every component and not zero."""
    v = F.col(vector)
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimensions) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of the rows of ``x``, at most ``k``, by Lloyd's rounds from a random start."""
    distinct = np.unique(x, axis=0)
    random = np.random.default_rng(seed)
    if len(distinct) <= k:
        return distinct
    centres = distinct[random.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        for j in range(k):
            mine = x[own == j]
            if len(mine):
                centres[j] = mine.mean(0)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, worked out in blocks of rows."""
    return np.concatenate([np.empty(0, np.int64), *(squared(x[k : k + 2048], centres).argmin(1) for k in range(0, len(x), 2048))])


@dataclass
class MultiIndex:
    """Two codebooks, one a half of the dimensions, and the number of entries in each cell (pair of centroids)."""

    halves: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = self.halves[0].shape[1]
        return nearest(x[:, :middle], self.halves[0]), nearest(x[:, middle:], self.halves[1])

    def probe(self, query: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Cells by rising sum of the query's distances to their two centroids, until ``enough`` entries are in them.

        The multi-sequence walk: both halves' centroids are sorted by distance, and
        a heap holds the border of the pairs already taken.
        """
        middle = self.halves[0].shape[1]
        one, other = squared(query[None, :middle], self.halves[0])[0], squared(query[None, middle:], self.halves[1])[0]
        left, right = np.argsort(one, kind="stable"), np.argsort(other, kind="stable")
        sizes = self.sizes[np.ix_(left, right)].tolist()
        rows, columns, one, other = left.tolist(), right.tolist(), one[left].tolist(), other[right].tolist()
        taken, found, out = [0] * len(rows), 0, []  # how many cells of each row have been taken
        heap = [(one[0] + other[0], 0, 0)]
        while heap and found < enough:
            _, i, j = heappop(heap)
            taken[i] = j + 1
            if sizes[i][j]:
                found += sizes[i][j]
                out.append((rows[i], columns[j]))
            if i + 1 < len(rows) and taken[i + 1] == j:
                heappush(heap, (one[i + 1] + other[j], i + 1, j))
            if j + 1 < len(columns) and (i == 0 or taken[i - 1] > j + 1):
                heappush(heap, (one[i] + other[j + 1], i, j + 1))
        return out

    def entries_until(self, query: np.ndarray, cells: list[tuple[int, int]]) -> list[int]:
        """For each cell how many entries a walk has passed once it has taken that cell."""
        middle = self.halves[0].shape[1]
        far = squared(query[None, :middle], self.halves[0])[0][:, None] + squared(query[None, middle:], self.halves[1])[0]
        order = np.argsort(far, axis=None, kind="stable")
        passed = np.empty(order.size, np.int64)
        passed[order] = self.sizes.ravel()[order].cumsum()
        return [int(passed[i * far.shape[1] + j]) for i, j in cells]

    def blocks(self, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each cell, and in how many parts each block's entries are dealt.

        Cells next to each other in a row of the first codebook share a block up to
        ``block_rows`` entries; a larger cell is a block of its own, in as many parts as it needs.
        """
        at, parts = np.zeros(self.sizes.shape, np.int64), []
        for i, row in enumerate(self.sizes.tolist()):
            held = None
            for j, n in enumerate(row):
                if held is None or held + n > block_rows:
                    held = 0
                    parts.append(1)
                held += n
                parts[-1] = max(1, -(-held // block_rows))
                at[i, j] = len(parts) - 1
        return at, np.array(parts, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, scanned: float | None = None, centroids: int | None = None,
    sample_rows: int = 10_000, trials: int = 64, block_rows: int = 20_000, block_queries: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest vectors but its own, by Euclidean distance.

    Codebooks are learnt from about ``sample_rows`` vectors picked by a hash of the
    id; every vector is indexed. A half has ``centroids``, or as many as leave about four
    entries a cell, 256 at most. A query visits cells by rising summed distance, and
    the entries of these are ranked by their exact distance in double precision, ties
    by the smaller id. How far a walk goes is measured: up to ``trials`` of the queries are
    answered by brute force first, and a walk goes on until it has passed as many
    entries as hold the share ``recall`` of their true neighbours. ``scanned`` instead
    fixes the share of all entries to pass; 1.0 makes the result exact.

    Entries are dealt to blocks: cells next to each other, up to ``block_rows`` entries,
    or parts of one larger cell, as where a third of all vectors are equal. A query
    goes only to blocks that hold a cell it visits. Where over ``block_queries`` visit
    a block, it is copied for as many groups of them. A task takes one block and one
    group, 256 queries at a time, and keeps the best ``k``; the bests of a query's blocks
    are merged by a limited ranking.

    Vectors that are null, zero, of another length than most or hold null or
    non-finite components take no part on either side, nor do null ids. Rows that
    repeat an id are vectors of their own; a query leaves out every row of its own
    id. A repeated query id is one query, with the least vector. Extra columns are
    not read. With no vectors or no queries the result is empty.
    """
    spark = vectors.sparkSession
    prepare(spark)
    work = Workspace(spark, "neighbours")
    kind = vectors.schema[id_col].dataType.simpleString()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    seen = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    length = seen(vectors).groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if length is None or not length["n"]:
        return spark.createDataFrame([], result)
    dimensions = length["n"]
    entries = seen(vectors).where(usable("v", dimensions))
    asked = seen(queries).where(usable("v", dimensions)).groupBy("id").agg(F.min("v").alias("v"))

    total = entries.count()
    if not total:
        return spark.createDataFrame([], result)
    index = _learnt(entries, total, dimensions, centroids, sample_rows)

    def place(batches):
        for batch in batches:
            i, j = index.cells(_matrix(batch.column(1))) if batch.num_rows else (np.empty(0, int), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["id", "v", "i", "j"])

    element = entries.schema["v"].dataType.simpleString()
    indexed = work.keep(entries.mapInArrow(place, f"id {kind}, v {element}, i int, j int"), "index")
    index.sizes = np.zeros((len(index.halves[0]), len(index.halves[1])), np.int64)
    for r in indexed.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # at most a row for each pair of centroids
        index.sizes[r["i"], r["j"]] = r["n"]
    if scanned is None:
        enough = max(k, _enough(index, indexed, asked, k, recall, trials, kind))
    else:
        enough = max(k, int(scanned * total))
    at, parts = index.blocks(block_rows)

    def visit(batches):
        for batch in batches:
            rows, blocks, cells = [], [], []
            for n, q in enumerate(_matrix(batch.column(1))):
                by_block: dict[int, list[int]] = {}
                for i, j in index.probe(q, enough):
                    by_block.setdefault(int(at[i, j]), []).append(j)
                rows += [n] * len(by_block)
                blocks += by_block
                cells += by_block.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(blocks, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["id", "v", "block", "js"])

    def dealt(batches):
        for batch in batches:
            block = at[batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(block, pa.int32()), pa.array(parts[block], pa.int32()), pa.array(groups[block], pa.int32())], names=["id", "v", "j", "block", "parts", "groups"])

    # walks take time: no task has many, however few the queries are
    walkers = asked.repartition(max(1, min(-(-asked.count() // 8), int(spark.conf.get("spark.sql.shuffle.partitions")))), "id")
    visits = work.keep(walkers.mapInArrow(visit, f"id {kind}, v {element}, block int, js array<int>"), "visits")
    groups = np.ones(len(parts), np.int64)
    for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect():  # no more rows than blocks
        groups[r["block"]] = -(-r["n"] // block_queries)

    def told(batches):
        for batch in batches:
            block = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts[block], pa.int32()), pa.array(groups[block], pa.int32())], names=["id", "v", "block", "js", "parts", "groups"])

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_side = visits.mapInArrow(told, f"id {kind}, v {element}, block int, js array<int>, parts int, groups int")
    own_side = own_side.select("id", "v", "block", "js", spread("parts").alias("part"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"))
    other = indexed.mapInArrow(dealt, f"id {kind}, v {element}, j int, block int, parts int, groups int")
    other = other.select("id", "v", "block", "j", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), spread("groups").alias("group"))
    width = index.sizes.shape[1]

    def best(group, own):
        ids, qids = own.column("id").to_numpy(), group.column("id").to_numpy()
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(ids) and len(qids):
            x, q = _matrix(own.column("v").combine_chunks()), _matrix(group.column("v").combine_chunks())
            cell, visited = own.column("j").to_numpy(), group.column("js").to_pylist()
            for low in range(0, len(qids), 256):
                allowed = np.zeros((min(256, len(qids) - low), width), bool)
                for n, js in enumerate(visited[low : low + 256]):
                    allowed[n, js] = True
                near = squared(q[low : low + 256], x)
                near[~allowed[:, cell]] = np.inf
                near[qids[low : low + 256, None] == ids] = np.inf
                for n in range(len(near)):
                    ok = np.flatnonzero(np.isfinite(near[n]))
                    mine = q[low + n]
                    if len(ok) > k:  # within rounding of the k-th, for the exact ranking
                        edge = np.partition(near[n, ok], k - 1)[k - 1]
                        ok = ok[near[n, ok] <= edge + 1e-9 * (1 + edge + (mine**2).sum())]
                    exact = np.sqrt(((x[ok] - mine) ** 2).sum(1))
                    order = np.lexsort((ids[ok], exact))[:k]
                    out["query_id"] += [qids[low + n]] * len(order)
                    out["vec_id"] += ids[ok][order].tolist()
                    out["score"] += exact[order].tolist()
        same = group.schema.field("id").type
        return pa.table({"query_id": pa.array(out["query_id"], same), "vec_id": pa.array(out["vec_id"], same), "score": pa.array(out["score"], pa.float64())})

    on = ["block", "part", "group"]
    found = own_side.groupBy(on).cogroup(other.groupBy(on)).applyInArrow(best, f"query_id {kind}, vec_id {kind}, score double")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` least (score, vec_id) of each query; Spark limits the ranking before it shuffles."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _learnt(entries: DataFrame, total: int, dimensions: int, centroids: int | None, sample_rows: int) -> MultiIndex:
    """Codebooks of both halves from about ``sample_rows`` vectors, picked by a hash of the id."""
    wanted = centroids or int(min(256, max(8, (total / 4) ** 0.5)))
    space = 1 << 30
    limit = min(space, space * sample_rows // total)
    mark = F.pmod(F.xxhash64("id", F.lit("codebook")), F.lit(space))
    sample = entries.where(mark < limit).orderBy(mark, "id", "v").limit(2 * sample_rows).collect() or entries.orderBy("id", "v").limit(wanted).collect()
    x = np.array([r["v"] for r in sorted(sample, key=lambda r: (r["id"], r["v"]))], float)
    middle = max(1, dimensions // 2)
    return MultiIndex((kmeans(x[:, :middle], wanted), kmeans(x[:, middle:], wanted)), np.zeros(0))


def _enough(index: MultiIndex, indexed: DataFrame, asked: DataFrame, k: int, recall: float, trials: int, kind: str) -> int:
    """How many entries a walk must pass to hold the share ``recall`` of the true neighbours of up to ``trials`` queries.

    The trial queries, bounded by that number, go to all entries; each batch keeps
    its ``k`` nearest of each, so one map-only pass and a limited ranking answer them.
    """
    picked = sorted(asked.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(trials).collect(), key=lambda r: r["id"])
    if not picked:
        return 0
    ids, q = np.array([r["id"] for r in picked]), np.array([r["v"] for r in picked], float)

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, far = batch.column(0).to_numpy(), squared(q, _matrix(batch.column(1)))
            far[ids[:, None] == own] = np.inf
            top = np.argsort(far, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(ids)), top.shape[1])
            ok = np.isfinite(far[row, top.ravel()])
            row, take = row[ok], top.ravel()[ok]
            cells = (batch.column(c).take(pa.array(take)) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), batch.column(0).take(pa.array(take)), *cells, pa.array(far[row, take], pa.float64())], names=["query_id", "vec_id", "i", "j", "score"])

    cells: dict[int, list[tuple[int, int]]] = {}
    for r in _ranked(indexed.mapInArrow(near, f"query_id int, vec_id {kind}, i int, j int, score double"), k).collect():  # at most k rows a trial
        cells.setdefault(r["query_id"], []).append((r["i"], r["j"]))
    needs = sorted(n for row, held in cells.items() for n in index.entries_until(q[row], held))
    return needs[min(len(needs) - 1, int(recall * len(needs)))] if needs else 0
