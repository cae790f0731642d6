"""Ordered-context operators: every table carries its ordinals, every window its partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line) of every text, numbered from 0; null texts have none."""
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def running(column: str, keys: list[str], order: list[str], inclusive: bool = True) -> Column:
    """Sum of the rows before, with the row itself if ``inclusive``; 0 where there are none."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def last_known(value: Column, keys: list[str], order: list[str], before: bool = False) -> Column:
    """The latest value that is not null, up to this row or only before it."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.last(value, ignorenulls=True).over(frame)


def islands(df: DataFrame, starts: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Rows numbered by runs: ``starts`` is true where a new one begins."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(frame).cast("int"))


def bands(df: DataFrame, low: str, high: str, gap: Column, keys: list[str]) -> DataFrame:
    """Intervals grouped where none of the earlier ones reaches within ``gap`` of the next."""
    by = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("_reach").isNull() | (F.col(low) - F.col("_reach") > gap)
    # equal intervals are one step of the frame, so that their order says nothing
    band = F.sum(F.when(starts, 1).otherwise(0)).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_reach", reach).withColumn("band", band.cast("int")).drop("_reach")


def moving(kind: str, column: str, radius: int, keys: list[str], order: list[str]) -> Column:
    """Minimum or maximum over ``radius`` rows to either side."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[kind](column).over(frame)


def box_mean(values: Column, radius: int) -> Column:
    """Moving mean of an array with its end values repeated beyond the ends."""
    n = F.size(values)
    spots = F.sequence(F.lit(-radius), F.lit(radius))
    at = lambda i: F.element_at(values, (F.greatest(F.lit(0), F.least(n - 1, i)) + 1).cast("int"))
    return F.transform(values, lambda _, i: F.aggregate(spots, F.lit(0.0), lambda a, d: a + at(i + d)) / (2 * radius + 1))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def evicted(df: DataFrame, keys: list[str], newest_first: list[Column], key: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """Cache entries that go: beyond the newest ``most`` or past ``most_bytes`` in all.

    What stays is among the newest ``most`` of each group, which Spark limits before
    it shuffles; all others go by an anti join on ``key``, so no group is sorted whole.
    """
    frame = Window.partitionBy(*keys).orderBy(*newest_first)
    newest = df.withColumn("_n", F.row_number().over(frame)).where(F.col("_n") <= most)
    upto = newest.withColumn("_sum", F.sum(size).over(Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(upto.where(F.coalesce(F.col("_sum"), F.lit(0)) <= most_bytes).select(key), key, "left_anti")


def next_at_most(df: DataFrame, keys: list[str], order: str, level: str, levels: int) -> Column:
    """The order of the next row whose level is at most this row's, of ``levels`` levels; null where there is none.

    One backward running frame a level, so a group costs its rows and not their pairs.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = F.lit(None).cast(df.schema[order].dataType)
    for n in range(levels, 0, -1):
        found = F.when(F.col(level) == n, F.last(F.when(F.col(level) <= n, F.col(order)), ignorenulls=True).over(later)).otherwise(found)
    return found


def folded(df: DataFrame, keys: list[str], order: list[str], start, step: Callable, schema: str) -> DataFrame:
    """Columns ``schema`` of what a fold over each key's rows tells, behind the key columns.

    ``step(state, row)`` takes the other columns of a row and returns the new state and
    the rows it tells. A ``start`` that changes is made by a function. Rows are sorted within partitions and streamed, so a task
    holds a batch of them and one state, however many rows a key has.
    """
    others = [c for c in df.columns if c not in keys]
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]
    fields = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), schema])
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, rest = row[: len(keys)], row[len(keys) :]
                if key != now:
                    now, state = key, start() if callable(start) else start
                state, told = step(state, rest)
                out += [dict(zip(names, (*key, *t))) for t in told]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)
