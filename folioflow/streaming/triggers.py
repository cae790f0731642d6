"""Incremental behaviours over event streams: throttles and stability with state that goes, analyses of growing documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from folioflow.operators import windows as w

#: The state store that state variables, timers and their expiry need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Pages of the first batch and of each later one.
FIRST_PAGES, MORE_PAGES = 3, 12


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of a folder as a stream (an incoming-file channel).

    Files that come before a query listens wait in the folder; with its checkpoint a query takes each once.
    """
    return spark.readStream.schema(schema).parquet(folder)


# ---- T2: throttle


def accepted(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    """Which of the rising times are at least ``gap`` after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out, last


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


class _Throttle(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        was = self.last.get()[0] if self.last.exists() else None
        times = sorted(r["at"] for r in rows if r["at"] is not None)
        ok, last = accepted(times, was, self.gap_ms * 1000)
        if last is not None and last != was:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(-(-last // 1000) + self.gap_ms)
        for t, taken in zip(times, ok):
            if taken:
                yield Row(key=key[0], at=t)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()


def throttled(stream: DataFrame, key: str, time: str, gap_ms: int = 450, late: str = "10 seconds") -> DataFrame:
    """(key, time) of each key's events that come at least ``gap_ms`` after the last one let through.

    The last time let through is the state. Once the watermark, ``late`` behind the
    newest event, has passed it by ``gap_ms``, every event that can still come is let through
    with or without it, so a timer takes it away: state is held for live keys
    only, and results don't depend on when it goes. Events behind the watermark are
    dropped by Spark; of the others, those that come after a later one was let through are held against that one.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    rows = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("time"), _micros(time).alias("at"))
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithState(_Throttle(gap_ms), f"key {kind}, at long", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time))


def throttled_table(df: DataFrame, key: str, time: str, gap_ms: int = 450) -> DataFrame:
    """The same over a table: (key, time).

    An event at least ``gap_ms`` after the one before it is let through whatever came
    earlier, so each burst of closer events is decided by itself, in one array.
    """
    rows = df.select(key, F.col(time).alias("_time"), _micros(time).alias("_at")).where("_at is not null")
    before = F.lag("_at").over(w.Window.partitionBy(key).orderBy("_at"))
    bursts = w.islands(rows.withColumn("_before", before), F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= gap_ms * 1000), [key], ["_at"], "_burst")
    held = bursts.groupBy(key, "_burst").agg(F.array_sort(F.collect_list("_at")).alias("at"))
    taken = F.aggregate("at", F.array().cast("array<bigint>"), lambda out, t: F.when((F.size(out) == 0) | (t - F.element_at(out, -1) >= gap_ms * 1000), F.concat(out, F.array(t))).otherwise(out))
    return held.select(key, F.explode(taken).alias("_at")).select(key, F.timestamp_micros("_at").alias(time))


# ---- T3: stability

Corners = tuple[float, ...]


def moved(one: Corners, other: Corners) -> float:
    """The largest distance between corners of the same place; corners are x and y in turn."""
    return max(((one[k] - other[k]) ** 2 + (one[k + 1] - other[k + 1]) ** 2) ** 0.5 for k in range(0, len(one), 2))


def stable(frames: Iterator[tuple[int, Corners | None]], state: tuple[Corners | None, int, int], move: float, hold: int, idle: int | None = None) -> tuple[list[int], tuple[Corners | None, int, int]]:
    """Times at which corners have stayed within ``move`` of a reference for over ``hold``; state: reference, since when, last seen.

    Then, on a frame without corners, on a move and after a silence of over ``idle`` it starts again.
    """
    reference, since, seen = state
    fired = []
    for t, corners in frames:
        if idle is not None and t - seen > idle:
            reference = None
        if corners is None:
            reference = None
        elif reference is None or moved(corners, reference) > move:
            reference, since = corners, t
        elif t - since > hold:
            fired.append(t)
            reference = None
        seen = max(seen, t)
    return fired, (reference, since, seen)


def _corners(told) -> Corners | None:
    return None if told is None or len(told) != 8 or any(x is None for x in told) else tuple(map(float, told))


class _Stability(StatefulProcessor):
    def __init__(self, move: float, hold_ms: int, idle_ms: int):
        self.move, self.hold_ms, self.idle_ms = move, hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "reference array<double>, since long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        was = self.held.get() if self.held.exists() else (None, 0, 0)
        was = (_corners(was[0]), was[1], was[2])
        frames = sorted(((r["at"], _corners(r["corners"])) for r in rows if r["at"] is not None), key=lambda f: (f[0], f[1] is not None, f[1] or ()))
        fired, now = stable(frames, was, self.move, self.hold_ms * 1000, self.idle_ms * 1000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[0] is None:
            self.held.clear()  # nothing to remember: the next frame starts anew
        else:
            self.held.update((list(now[0]), now[1], now[2]))
            self.handle.registerTimer(-(-now[2] // 1000) + self.idle_ms)
        for t in fired:
            yield Row(key=key[0], at=t)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()


def stability(stream: DataFrame, key: str, time: str, corners: str, move: float = 0.03, hold_ms: int = 1400, idle_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(key, time) at which the four corners of a key (x and y in turn, null where none were found) have been stable.

    The state is a reference, since when it holds and the last frame. A key that is silent
    for over ``idle_ms`` starts anew; once the watermark has passed that, a timer takes its state away.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    rows = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("time"), _micros(time).alias("at"), F.col(corners).cast("array<double>").alias("corners"))
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithState(_Stability(move, hold_ms, idle_ms), f"key {kind}, at long", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time))


def stable_table(df: DataFrame, key: str, time: str, corners: str, move: float = 0.03, hold_ms: int = 1400, idle_ms: int | None = None) -> DataFrame:
    """The same over a table: a fold over each key's frames in order, with one frame in memory."""
    hold, idle = hold_ms * 1000, None if idle_ms is None else idle_ms * 1000

    def step(state, row):
        at, told = row
        fired, state = stable([(at, _corners(told))], state, move, hold, idle)
        return state, [(t,) for t in fired]

    rows = df.select(key, _micros(time).alias("_at"), F.col(corners).cast("array<double>").alias("_corners")).where("_at is not null")
    return w.folded(rows, [key], ["_at", "_corners"], (None, 0, 0), step, "_fired long").select(key, F.timestamp_micros("_fired").alias(time))


# ---- T4: analyses of documents that are still growing


def reading_batch(place: Column) -> Column:
    """The extraction batch of a page by its place in the reading order: a small one first, larger ones then."""
    return F.when(place < FIRST_PAGES, 0).otherwise(1 + F.floor((place - FIRST_PAGES) / MORE_PAGES)).cast("int")


def passes(pages: Column) -> Column:
    """The page counts at which a document of ``pages`` pages is analysed: after a batch that has doubled what the last pass saw, and at the end."""
    more = F.when(pages > FIRST_PAGES, F.sequence(F.lit(FIRST_PAGES).cast("long"), pages - 1, F.lit(MORE_PAGES).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ends = F.concat(more, F.array(pages.cast("long")))
    due = lambda out, n: (F.size(out) == 0) | (n >= 2 * F.element_at(out, -1)) | (n == pages)
    return F.when(pages > 0, F.aggregate(ends, F.array().cast("array<bigint>"), lambda out, n: F.when(due(out, n), F.concat(out, F.array(n))).otherwise(out)))


class Progressive:
    """A foreachBatch function that analyses a growing table anew whenever it has doubled.

    ``analyse`` takes all rows so far and returns the result. In ``folder`` there are
    ``rows/epoch=n``, the rows of each micro-batch; ``passes/epoch=n``, how many rows there are after it and how
    many the last analysis saw; ``results/rows=n``, an analysis with the number of rows it
    saw. Every part is written anew where an epoch is replayed, so that counts nothing twice. Only
    the micro-batch is counted, not what came before. ``current`` has the result of the most rows; older ones are stale.
    """

    def __init__(self, folder: str, analyse: Callable[[DataFrame], DataFrame], first: int = 1):
        self.folder, self.analyse, self.first = folder.rstrip("/"), analyse, first

    def __call__(self, df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        part = f"{self.folder}/rows/epoch={epoch}"
        df.write.mode("overwrite").parquet(part)
        before, seen = self._before(spark, epoch)
        n = before + spark.read.schema(df.schema).parquet(part).count()
        if n > before and n >= max(self.first, 2 * seen):
            self._analyse(spark, df.schema, epoch, n)
            seen = n
        spark.createDataFrame([(n, seen)], "n long, seen long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/passes/epoch={epoch}")

    def _before(self, spark: SparkSession, epoch: int | None) -> tuple[int, int]:
        if not _there(spark, f"{self.folder}/passes"):
            return 0, 0
        told = spark.read.schema("n long, seen long, epoch long").parquet(f"{self.folder}/passes")
        last = (told if epoch is None else told.where(F.col("epoch") < epoch)).agg(F.max_by(F.struct("n", "seen"), "epoch").alias("last")).first()["last"]
        return (last["n"], last["seen"]) if last else (0, 0)

    def _analyse(self, spark: SparkSession, schema: StructType, epoch: int | None, n: int) -> None:
        rows = self.rows(spark, schema)
        rows = rows if epoch is None else rows.where(F.col("epoch") <= epoch)
        self.analyse(rows.select(schema.names)).write.mode("overwrite").parquet(f"{self.folder}/results/rows={n}")

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All rows so far, with their epoch."""
        return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(f"{self.folder}/rows")

    def finish(self, spark: SparkSession, schema: StructType) -> None:
        """After the last rows: one more analysis if the last one has not seen them all."""
        n, seen = self._before(spark, None)
        if n > seen:
            self._analyse(spark, schema, None, n)

    def current(self, spark: SparkSession) -> DataFrame | None:
        """The result of the analysis that saw the most rows; None before the first."""
        if not _there(spark, f"{self.folder}/results"):
            return None
        found = [f for f in _children(spark, f"{self.folder}/results") if f.startswith("rows=")]
        return spark.read.parquet(f"{self.folder}/results/rows={max(int(f[5:]) for f in found)}") if found else None


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, folder: str) -> bool:
    path, store = _path(spark, folder)
    return store.exists(path)


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of analyses that were finished; their number grows with the logarithm of the rows."""
    path, store = _path(spark, folder)
    return [x.getPath().getName() for x in store.listStatus(path) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
