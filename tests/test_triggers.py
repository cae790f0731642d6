"""Throttles, stability and progressive analyses: plain versions, restarts, late rows, state that goes, replayed epochs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import triggers

SCHEMA = "cam int, ts timestamp, corners array<double>"
SQUARE = (0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0)
START = 1_700_000_000_000


def at(ms):
    return dt.datetime.fromtimestamp((START + ms) / 1000, dt.timezone.utc).replace(tzinfo=None)


def shifted(by):
    return [x + by for x in SQUARE[:2]] + list(SQUARE[2:])


def put(spark, folder, n, rows):
    spark.createDataFrame([(k, at(ms), c) for k, ms, c in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")


class Run:
    """A query over a folder's files that is started again for each batch."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.folder, self.make = spark, str(tmp_path), make

    def feed(self, n, rows):
        put(self.spark, f"{self.folder}/in", n, rows)
        stream = self.make(triggers.events(self.spark, f"{self.folder}/in/*", SCHEMA))
        q = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").outputMode("append").option("checkpointLocation", f"{self.folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    def out(self):
        return sorted((r[0], int(r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - START) for r in self.spark.read.parquet(f"{self.folder}/out").collect())

    def state(self, name):
        return sorted(r["key"]["key"] for r in self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.folder}/ck").collect())


def test_kernels():
    assert triggers.accepted([0, 100, 450, 800, 900, 1400], None, 450) == ([True, False, True, False, True, True], 1400)
    assert triggers.moved(SQUARE, (0.03, 0.04, *SQUARE[2:])) == pytest.approx(0.05)
    frames = [(0, SQUARE), (700, tuple(shifted(0.02))), (1500, SQUARE), (1600, SQUARE), (3200, None)]
    assert triggers.stable(frames, (None, 0, 0), 0.03, 1400) == ([1500], (None, 1600, 3200))
    assert triggers.stable([(0, SQUARE), (1400, SQUARE)], (None, 0, 0), 0.03, 1400)[0] == []
    # the distance counts, not each coordinate; one corner is enough
    assert triggers.stable([(0, SQUARE), (1500, tuple(shifted(0.025)))], (None, 0, 0), 0.03, 1400)[0] == []
    assert triggers.stable([(0, SQUARE), (9000, SQUARE)], (None, 0, 0), 0.03, 1400, idle=5000)[0] == []


def test_throttle_over_restarts_late_rows_and_idle_keys(spark, tmp_path):
    run = Run(spark, tmp_path, lambda s: triggers.throttled(s, "cam", "ts"))
    run.feed(1, [(1, 0, None), (1, 449, None), (1, 450, None), (2, 100, None), (1, 500, None)])
    run.feed(2, [(1, 899, None), (1, 900, None), (2, 5000, None)])
    assert run.out() == [(1, 0), (1, 450), (1, 900), (2, 100), (2, 5000)]
    assert run.state("last") == [1, 2]
    run.feed(3, [(2, 60_000, None)])  # the watermark goes to 50 s
    run.feed(4, [(1, 3000, None), (2, 60_100, None), (3, 55_000, None)])  # too late: 3 s
    assert run.out() == [(1, 0), (1, 450), (1, 900), (2, 100), (2, 5000), (2, 60_000), (3, 55_000)]
    assert run.state("last") == [2, 3]  # key 1 has gone
    run.feed(5, [(1, 61_000, None)])
    assert run.out()[3] == (1, 61_000)


def test_stability_over_restarts_and_idle_keys(spark, tmp_path):
    run = Run(spark, tmp_path, lambda s: triggers.stability(s, "cam", "ts", "corners", idle_ms=20_000))
    run.feed(1, [(1, 0, list(SQUARE)), (1, 700, shifted(0.02)), (2, 0, list(SQUARE)), (3, 0, list(SQUARE)), (4, 0, list(SQUARE))])
    run.feed(2, [(1, 1401, list(SQUARE)), (2, 1401, shifted(0.04)), (3, 1000, None), (3, 1401, list(SQUARE)), (1, 1500, list(SQUARE))])
    assert run.out() == [(1, 1401)] and run.state("held") == [1, 2, 3, 4]
    run.feed(3, [(2, 2900, shifted(0.05)), (3, 2802, [None] * 8), (1, 40_000, list(SQUARE))])
    assert run.out() == [(1, 1401), (2, 2900)]
    run.feed(4, [(1, 41_500, list(SQUARE))])
    run.feed(5, [(4, 42_000, list(SQUARE))])  # 42 s of silence: no moment
    assert run.out() == [(1, 1401), (1, 41_500), (2, 2900)] and run.state("held") == [4]


def test_tables_agree_with_the_kernels(spark):
    r = random.Random(3)
    rows, t = [], 0
    for _ in range(600):
        t += r.choice([5, 100, 300, 449, 450, 2000])
        corners = None if r.random() < 0.05 else shifted(r.choice([0.0, 0.01, 0.02, 0.2]) if r.random() < 0.3 else 0.0)
        rows.append((r.randrange(3), t, corners))
    df = spark.createDataFrame([(k, at(ms), c) for k, ms, c in rows] + [(1, None, None)], SCHEMA).repartition(7)
    plain = lambda found: sorted((x[0], int(x[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - START) for x in found.collect())
    mine = {k: [(ms, c and tuple(c)) for key, ms, c in rows if key == k] for k in range(3)}
    assert plain(triggers.throttled_table(df, "cam", "ts")) == sorted((k, ms) for k, held in mine.items() for (ms, _), ok in zip(held, triggers.accepted([f[0] for f in held], None, 450)[0]) if ok)
    for idle in (None, 1500):
        want = sorted((k, ms) for k, held in mine.items() for ms in triggers.stable(held, (None, 0, 0), 0.03, 1400, idle)[0])
        assert plain(triggers.stable_table(df, "cam", "ts", "corners", idle_ms=idle)) == want and (idle or want)


def test_batches_and_passes(spark):
    places = spark.range(40).select(triggers.reading_batch(F.col("id")).alias("b"))
    assert [r["b"] for r in places.collect()] == [0] * 3 + [1] * 12 + [2] * 12 + [3] * 12 + [4]
    counts = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 15, 20, 100)], "n long").select(triggers.passes(F.col("n")).alias("p"))
    assert [r["p"] for r in counts.collect()] == [None, [1], [3], [3, 4], [3, 15], [3, 15, 20], [3, 15, 39, 87, 100]]


def test_progressive_analyses_count_replayed_epochs_once(spark, tmp_path):
    schema = spark.range(1).schema
    analyse = lambda df: df.agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    seen = []
    for epoch, (low, high) in enumerate([(0, 1), (1, 2), (2, 3), (3, 4), (4, 7), (7, 8), (8, 20), (20, 20)]):
        run = triggers.Progressive(f"file://{tmp_path}", analyse)  # started again for each batch
        for _ in range(2 if epoch % 2 else 1):  # every second epoch is replayed
            run(spark.range(low, high), epoch)
        now = run.current(spark).first()
        seen.append(now["n"])
        assert now["s"] == sum(range(now["n"]))
    assert seen == [1, 2, 2, 4, 4, 8, 20, 20]
    run(spark.range(20, 25), 8)
    assert run.current(spark).first()["n"] == 20
    run.finish(spark, schema)
    run.finish(spark, schema)
    assert run.current(spark).first()["n"] == 25
    assert triggers.Progressive(f"file://{tmp_path}/none", analyse).current(spark) is None


def test_progressive_analysis_of_a_stream(spark, tmp_path):
    for n in range(5):
        put(spark, tmp_path / "in", n, [(n, 10 * n + k, None) for k in range(4)])
    run = triggers.Progressive(f"file://{tmp_path}/work", lambda df: df.groupBy("cam").count())
    stream = triggers.events(spark, f"{tmp_path}/in/*", SCHEMA)
    stream.sparkSession.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    run.finish(spark, stream.schema)
    assert sorted(map(tuple, run.current(spark).collect())) == [(n, 4) for n in range(5)]
