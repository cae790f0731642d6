"""Kernels over tiles against the same kernels over whole planes."""

import numpy as np
import pytest

from folioflow.operators import scans, tiles

KERNELS = [("box_blur", 2), ("local_mean", 3), ("local_variance", 7), ("smallest", 1), ("largest", 2), ("gaussian", 1.2), ("black_white", 2)]


def planes(spark):
    random = np.random.default_rng(4)
    made = [(k, w, h, random.integers(0, 256, w * h).tolist()) for k, (w, h) in enumerate([(1, 1), (5, 3), (23, 17), (40, 9), (8, 8)])]
    return spark.createDataFrame(made + [(9, 3, 3, [1, 2]), (10, 2, 2, None)], "image_id int, width int, height int, pixels array<int>")


def put_together(df, side):
    out = {}
    for r in tiles.pixels_of(df, side).collect():
        out.setdefault(r["image_id"], {})[r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("side", [1, 4, 64])
def test_tiles_are_as_whole_planes(spark, side):
    held = tiles.cut(planes(spark), side)
    for kernel, parameter in KERNELS if side == 4 else KERNELS[1::2]:
        got = put_together(tiles.tile_filtered(held, side, kernel, parameter), side)
        want = {r["image_id"]: (r["width"], r["pixels"]) for r in scans.filtered(planes(spark), kernel, parameter).collect()}
        assert got.keys() == want.keys()
        for k, (w, pixels) in want.items():
            mine = [got[k][n // w, n % w] for n in range(len(pixels))]
            assert len(got[k]) == len(pixels)
            assert mine == pixels if kernel != "gaussian" else np.allclose(mine, pixels, atol=1e-3)


def test_tiles_from_pixels(spark):
    random = np.random.default_rng(5)
    plane = random.integers(0, 256, (11, 7))
    rows = [("a", y, x, int(plane[y, x])) for y in range(11) for x in range(7)] + [("lost", 0, 0, 1), ("lost", 1, 1, 1), ("twice", 0, 0, 1), ("twice", 0, 0, 1), ("null", 0, 0, None)]
    pixels = spark.createDataFrame(rows, "k string, y int, x int, v int").repartition(5)
    parts = tiles.tiled(pixels, "k", "y", "x", "v", side=4)
    assert {r["k"] for r in parts.collect()} == {"a"} and parts.count() == 6
    assert {(r["y"], r["x"]): r["v"] for r in tiles.pixels_of(parts, 4, "k").collect()} == {(y, x): float(plane[y, x]) for y in range(11) for x in range(7)}
    assert tiles.tile_filtered(parts.limit(0), 4, "box_blur", 1, key="k").count() == 0
