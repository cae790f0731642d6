"""Queries over event streams taken as tables: the rules of ``folioflow.streaming``, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.session import table
from folioflow.streaming import triggers

GAP_MS, HOLD_MS = 26_000_000, 90_000_000


@query(
    "throttled_events",
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
t(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY user_id UNION ALL SELECT t.user_id, min(e.us) FROM t JOIN e ON e.user_id = t.user_id AND e.us >= t.us + {GAP_MS}000 GROUP BY t.user_id)
SELECT user_id, us FROM t""",
)
def throttled_events(spark, sf_dir):
    """Of each user's events those at least some hours after the last one let through."""
    events = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "ts")
    return triggers.throttled_table(events, "user_id", "ts", GAP_MS).select("user_id", F.unix_micros("ts").alias("us"))


@query(
    "stable_moments",
    f"""WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN floor(value / 100) * 0.01 END AS v FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, v NULLS FIRST) AS n FROM v),
s(user_id, n, us, ref, since, fired) AS (SELECT user_id, n, us, v, us, false FROM e WHERE n = 1 UNION ALL
  SELECT user_id, n, us, CASE WHEN v IS NULL THEN NULL WHEN anew THEN v WHEN us - since > {HOLD_MS}000 THEN NULL ELSE ref END, CASE WHEN v IS NOT NULL AND anew THEN us ELSE since END, v IS NOT NULL AND NOT anew AND us - since > {HOLD_MS}000
  FROM (SELECT e.*, s.ref, s.since, s.ref IS NULL OR sqrt(2.0) * abs(e.v - s.ref) > 0.03 AS anew FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, us FROM s WHERE fired""",
)
def stable_moments(spark, sf_dir):
    """When corners that follow the events' values, none for errors, have been stable for a day."""
    v = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100) * 0.01)
    fixed = [F.lit(x).cast("double") for x in (1, 0, 1, 1, 0, 1)]
    frames = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "ts", F.when(v.isNotNull(), F.array(v, v, *fixed)).alias("corners"))
    return triggers.stable_table(frames, "user_id", "ts", "corners", hold_ms=HOLD_MS).select("user_id", F.unix_micros("ts").alias("us"))


@query(
    "analysis_passes",
    """WITH RECURSIVE c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
p(user_id, n, pages) AS (SELECT user_id, n, least(3, n) FROM c UNION ALL SELECT user_id, n, least(n, 3 + 12 * CAST(ceil((2 * pages - 3) / 12.0) AS BIGINT)) FROM p WHERE pages < n)
SELECT user_id, pages FROM p""",
)
def analysis_passes(spark, sf_dir):
    """T4: the page counts at which a document with a page for each event of a user is analysed while it is read."""
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return pages.select("user_id", F.explode(triggers.passes(F.col("n"))).alias("pages"))


@query(
    "reading_batches",
    "SELECT event_id, user_id, CAST(CASE WHEN place < 3 THEN 0 ELSE 1 + (place - 3) // 12 END AS INT) AS batch FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY page < n // 2, page) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page, count(*) OVER (PARTITION BY user_id) AS n FROM events))",
)
def reading_batches(spark, sf_dir):
    """The extraction batch of each page, read from the middle on and then from the first."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    counts = events.groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("n"))
    paged = events.withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    # the place follows from the page: those from the start on come first
    start = F.floor(F.col("n") / 2)
    place = F.when(F.col("page") >= start, F.col("page") - start).otherwise(F.col("page") + F.col("n") - start)
    return paged.join(counts, F.col("user_id").eqNullSafe(F.col("user"))).select("event_id", "user_id", triggers.reading_batch(place).alias("batch"))
