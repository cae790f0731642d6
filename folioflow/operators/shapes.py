"""Shapes around points: hulls that combine, and the largest quadrilateral inside one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.functions import scan

#: So many points are held of a group before they are reduced to their hull.
HELD = 4096


def hulls(points: DataFrame, keys: list[str], x: str, y: str, parts: int = 64) -> DataFrame:
    """(keys, hull, area): the corners around each group's points, counter-clockwise where y rises, without those on a line.

    Of the points above one x only the lowest and the highest can be corners: an aggregate leaves these. A hull of hulls
    is the hull of all their points, so it combines: groups with over ``HELD`` x are dealt to ``parts`` parts, whose hulls meet at
    last by group. No task gets such a group's points, and one holds a few thousand points. Points with a null or not finite
    coordinate take no part, nor groups without others.
    """
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = points.where(sound(x) & sound(y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    fields = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    corner, whole = f"{fields}, _part int, _x double, _y double", f"{fields}, hull array<struct<x:double,y:double>>, area double"
    ends = rows.groupBy(*keys, "_x").agg(F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    large = ends.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HELD).select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.lit(True).alias("_large"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))
    part = F.when(F.col("_large"), F.pmod(F.hash("_x"), F.lit(parts))).otherwise(0).cast("int").alias("_part")
    dealt = ends.join(F.broadcast(large), same, "left").select(*keys, part, "_x", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_y"))
    met = _corners(dealt.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part"), keys, corner)
    return _corners(met.withColumn("_part", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys), keys, whole)


def _corners(rows: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """The hulls of rows (keys, _part, _x, _y) of groups that stand together in the partitions."""
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    n, whole = len(keys), "hull" in arrow.names

    def told(groups: dict | list) -> pa.RecordBatch:
        out = []
        for (*key, part), held in groups:
            outline = scan.hull(np.concatenate(held))
            if whole:
                out.append((*key, [{"x": a, "y": b} for a, b in outline.tolist()], area(outline)))
            else:
                out += [(*key, part, a, b) for a, b in outline.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([*c], f.type) for c, f in zip([*zip(*out)] or [()] * len(arrow), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, [], 0
        for batch in batches:
            points = np.column_stack([batch.column(n + k).to_numpy(zero_copy_only=False) for k in (1, 2)]) if batch.num_rows else np.empty((0, 2))
            names = [*zip(*(c.to_pylist() for c in batch.columns[: n + 1]))]
            starts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1])] if names else []
            for low, high in zip(starts, [*starts[1:], len(names)]):
                if names[low] != now:
                    if now is not None:
                        yield told([(now, held)])
                    now, held, count = names[low], [], 0
                held.append(points[low:high])
                count += high - low
                if count > HELD:
                    held = [scan.hull(np.concatenate(held))]
                    count = len(held[0])
        if now is not None:
            yield told([(now, held)])

    return rows.mapInArrow(run, fields)


def area(outline: np.ndarray) -> float:
    """what an outline encloses."""
    if len(outline) < 3:
        return 0.0
    x, y = outline.T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def largest_quad(outline: np.ndarray) -> np.ndarray | None:
    """The four of a hull's corners that enclose most, the first of equals; None with fewer than four.

    For each corner the opposite one goes round once, and the farthest corners on
    both sides of that diagonal only ever move on with it (rotating calipers), so the time is the square of the corners.
    """
    n = len(outline)
    if n < 4:
        return None
    p = [*map(tuple, outline.tolist())] * 2
    off = lambda a, b, c: abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0]))
    best, found = -1.0, None
    for i in range(n - 2):
        k, m = i + 1, i + 3
        for j in range(i + 2, n if i else n - 1):
            while k + 1 < j and off(i, j, k + 1) > off(i, j, k):
                k += 1
            m = max(m, j + 1)
            while m + 1 < i + n and off(i, j, m + 1) > off(i, j, m):
                m += 1
            both = off(i, j, k) + off(i, j, m)
            if both > best:
                best, found = both, (i, k, j, m % n)
    return outline[list(found)]


def quads(hulls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quad, quad_area) of hulls with four corners at least."""
    fields = ", ".join([*(f"`{k}` {hulls.schema[k].dataType.simpleString()}" for k in keys), "quad array<struct<x:double,y:double>>, quad_area double"])
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, corners in zip(*(c.to_pylist() for c in batch.columns)):
                found = largest_quad(np.array([(c["x"], c["y"]) for c in corners]))
                if found is not None:
                    out.append({**dict(zip(keys, key)), "quad": [{"x": a, "y": b} for a, b in found.tolist()], "quad_area": area(found)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return hulls.select(*keys, "hull").mapInArrow(run, fields)
