"""Hulls by parts and largest quadrilaterals against plain versions."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from folioflow.functions import scan
from folioflow.operators import shapes


def test_hulls_of_parts_are_those_of_all_points(spark):
    random = np.random.default_rng(6)
    held = {k: random.normal(0, 100, (n, 2)).round(k % 3) for k, n in enumerate([1, 2, 3, 50, 30_000])}
    held[5] = np.column_stack([np.arange(9.0), np.arange(9.0)])  # all on a line
    rows = [(k, float(a), float(b)) for k, points in held.items() for a, b in points] + [(7, None, 1.0), (8, float("nan"), 1.0), (4, float("inf"), 0.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(9)
    got = {r["k"]: ([(c["x"], c["y"]) for c in r["hull"]], r["area"]) for r in shapes.hulls(df, ["k"], "x", "y", parts=3).collect()}
    assert got.keys() == {*held, None}
    for k, points in held.items():
        want = scan.hull(points)
        assert got[k][0] == [*map(tuple, want.tolist())] and np.isclose(got[k][1], shapes.area(want))
    assert got[5][1] == 0.0 and shapes.hulls(df.limit(0), ["k"], "x", "y").count() == 0
    quads = {r["k"]: r["quad_area"] for r in shapes.quads(shapes.hulls(df, ["k"], "x", "y"), ["k"]).collect()}
    assert quads.keys() == {3, 4} and all(quads[k] <= got[k][1] + 1e-9 for k in quads)


def test_largest_quadrilateral_is_that_of_all_fours():
    random = np.random.default_rng(7)
    for n in [4, 5, 6, 9, 14] * 12:
        outline = scan.hull(random.normal(0, 1, (n * 3, 2)) * random.uniform(0.1, 3, 2))
        if len(outline) < 4:
            continue
        most = max(shapes.area(outline[list(four)]) for four in combinations(range(len(outline)), 4))
        assert np.isclose(shapes.area(shapes.largest_quad(outline)), most)
    circle = scan.hull(np.column_stack([f(np.linspace(0, 2 * np.pi, 400, endpoint=False)) for f in (np.cos, np.sin)]))
    assert np.isclose(shapes.area(shapes.largest_quad(circle)), 2.0)
    assert shapes.largest_quad(circle[:3]) is None


def test_hulls_get_the_ends_above_each_x_only(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from folioflow.functions import scan
    from folioflow.operators import shapes

    points = spark.range(4000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 40).alias("x"), (F.col("id") * 7 % 20).cast("double").alias("y"))
    assert "_low" in shapes.hulls(points, ["k"], "x", "y")._jdf.queryExecution().toString()
    # a group of more x than one task holds, and one without a key
    held = points.union(spark.range(9000).select(F.lit(2), F.col("id"), (F.col("id") * F.col("id") % 101).cast("double"))).union(spark.createDataFrame([(None, 1, 2.0), (None, 3, 2.0), (None, 1, 5.0)], "k long, x long, y double"))
    rows, got = held.collect(), shapes.hulls(held, ["k"], "x", "y").collect()
    assert len(got) == 4
    for r in got:
        want = scan.hull(np.array([(p["x"], p["y"]) for p in rows if p["k"] == r["k"]], float))
        assert [(c["x"], c["y"]) for c in r["hull"]] == [*map(tuple, want.tolist())]
