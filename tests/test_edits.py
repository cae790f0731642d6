"""Where watermarks stand."""

import pytest

from folioflow.operators import edits


def test_watermarks(spark):
    pages = spark.createDataFrame([(1, 200.0, 300.0, 100.0, 20.0), (2, 50.0, 50.0, 400.0, 60.0)], "page int, w double, h double, wide double, high double")
    at = lambda position, **more: {p: sorted((r["y"], r["x"]) for r in edits.watermarked(pages, ["page"], "w", "h", "wide", "high", position, **more).where(f"page = {p}").collect()) for p in (1, 2)}
    assert at("tile")[1] == [(y, x) for y, xs in ((60.0, (65.0, 195.0, 325.0)), (180.0, (0.0, 130.0, 260.0)), (300.0, (65.0, 195.0, 325.0))) for x in xs]
    assert at("tile")[2] == [(120.0, 260.0)]
    assert at("center") == {1: [(150.0, 100.0)], 2: [(25.0, 25.0)]} and at("top")[1] == [(250.0, 100.0)] and at("bottom")[2] == [(80.0, 25.0)]
    text, image = (edits.watermarked(pages, ["page"], "w", "h", "wide", "high", degrees=90.0, text=t).where("page = 1").first() for t in (True, False))
    assert (text["dx"], text["dy"], image["dy"]) == (-50.0, -7.0, -10.0) and abs(text["cos"]) < 1e-12 and text["sin"] == 1.0
    assert edits.watermarked(pages.limit(0), ["page"], "w", "h", "wide", "high", "tile").count() == 0
    with pytest.raises(ValueError):
        edits.watermarked(pages, ["page"], "w", "h", "wide", "high", "left")
