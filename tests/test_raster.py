"""Image kernels against loops over every pixel's window."""

import numpy as np
import pytest

from folioflow.functions import raster

PLANE = np.random.default_rng(5).integers(0, 256, (9, 13)).astype(np.uint8)


def _windows(plane, radius):
    height, width = plane.shape
    for y in range(height):
        for x in range(width):
            rows = np.clip(range(y - radius, y + radius + 1), 0, height - 1)
            columns = np.clip(range(x - radius, x + radius + 1), 0, width - 1)
            yield y, x, plane[np.ix_(rows, columns)].astype(float)


@pytest.mark.parametrize("radius", [1, 3, 15])
def test_windows(radius):
    blurred, (mean, variance) = raster.box_blur(PLANE, radius), raster.box_mean_variance(PLANE, radius)
    high, low = raster.rank_filter(PLANE, radius, True), raster.rank_filter(PLANE, radius, False)
    for y, x, seen in _windows(PLANE, radius):
        assert blurred[y, x] == pytest.approx(seen.mean(), rel=1e-5) and mean[y, x] == pytest.approx(seen.mean(), rel=1e-5)
        assert variance[y, x] == pytest.approx(seen.var(), rel=1e-4, abs=1e-3)
        assert (high[y, x], low[y, x]) == (seen.max(), seen.min())


def test_gaussian():
    bell = np.exp(-(np.arange(-3, 4) ** 2) / 2)
    weights = np.outer(bell, bell) / bell.sum() ** 2
    blurred = raster.gaussian_blur(PLANE, 1.0)
    for y, x, seen in _windows(PLANE, 3):
        assert blurred[y, x] == pytest.approx((seen * weights).sum(), rel=1e-5)


def test_specks():
    plane = np.full((7, 7), 255, np.uint8)
    plane[2, 2] = plane[0, 5] = plane[4, 4] = plane[5, 5] = 0
    assert np.argwhere(raster.without_specks(plane) == 0).tolist() == [[0, 5], [4, 4], [5, 5]]


def test_empty_and_tiny():
    empty = np.zeros((0, 0), np.uint8)
    assert raster.box_blur(empty, 2).size == raster.gaussian_blur(empty, 1.0).size == raster.rank_filter(empty, 2, True).size == 0
    assert raster.without_specks(np.zeros((1, 1), np.uint8)).tolist() == [[0]]
    assert raster.box_blur(PLANE, 0).tolist() == PLANE.tolist()
