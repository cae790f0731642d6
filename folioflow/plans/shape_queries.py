"""Queries over shapes of points, with SQL that wraps them corner by corner."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import shapes
from folioflow.plans.registry import query
from folioflow.session import table


@query(
    "hull_areas",
    """WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS s, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_orderkey % 89 AS DOUBLE) AS y FROM lineitem),
w(s, n, sx, sy, x, y, dir) AS (SELECT s, 0, m[1], m[2], m[1], m[2], -pi() / 2 FROM (SELECT s, min([x, y]) AS m FROM p GROUP BY s) UNION ALL
  SELECT s, n + 1, sx, sy, m[3], m[4], m[5] FROM (SELECT s, n, sx, sy, min([round(CASE WHEN turn < -1e-9 THEN turn + 2 * pi() ELSE turn END, 9), -far, qx, qy, a]) AS m
    FROM (SELECT w.s, w.n, w.sx, w.sy, q.x AS qx, q.y AS qy, (q.x - w.x) * (q.x - w.x) + (q.y - w.y) * (q.y - w.y) AS far, atan2(q.y - w.y, q.x - w.x) AS a, atan2(q.y - w.y, q.x - w.x) - w.dir AS turn
      FROM w JOIN p q ON q.s = w.s AND (q.x <> w.x OR q.y <> w.y) WHERE n = 0 OR w.x <> sx OR w.y <> sy) GROUP BY s, n, sx, sy)),
h AS (SELECT s, n, x, y FROM w WHERE n > 0),
e AS (SELECT s, CAST(count(*) AS INT) AS corners, sum(x * ny - nx * y) / 2 AS area FROM (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM h WINDOW o AS (PARTITION BY s ORDER BY n)) GROUP BY s),
d AS (SELECT a.s, greatest(max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)), 0) + greatest(max((b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y)), 0) AS reach FROM h a JOIN h b ON a.s = b.s AND a.n < b.n JOIN h c ON c.s = a.s GROUP BY a.s, a.n, b.n)
SELECT e.s AS l_suppkey, corners, round(area, 3) AS area, CASE WHEN corners >= 4 THEN round(quad, 3) END AS quad_area FROM e JOIN (SELECT s, max(reach) / 2 AS quad FROM d GROUP BY s) q ON q.s = e.s""",
)
def hull_areas(spark, sf_dir):
    """The hull of each supplier's points and the largest quadrilateral in it."""
    points = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 97).alias("x"), (F.col("l_orderkey") % 89).alias("y"))
    hulls = shapes.hulls(points, ["l_suppkey"], "x", "y")
    quads = shapes.quads(hulls, ["l_suppkey"])
    return hulls.join(quads, "l_suppkey", "left").select("l_suppkey", F.size("hull").alias("corners"), F.round("area", 3).alias("area"), F.round("quad_area", 3).alias("quad_area"))
