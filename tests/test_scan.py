"""Kernels of page scans against plain versions."""

import numpy as np
import pytest

from folioflow.functions import scan

RANDOM = np.random.default_rng(3)


def test_homography_takes_corners_to_corners():
    for _ in range(40):
        source = np.array([(0, 0), (100, 0), (100, 80), (0, 80)]) + RANDOM.uniform(-15, 15, (4, 2))
        target = np.array([(0, 0), (50, 0), (50, 70), (0, 70)]) + RANDOM.uniform(-10, 10, (4, 2))
        m = scan.homography(source, target)
        assert np.allclose(scan.applied(m, source), target) and np.allclose(scan.applied(np.linalg.inv(m), target), source)
    with pytest.raises(ValueError):
        scan.homography([(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 0), (1, 0), (1, 1), (0, 1)])


def test_warp_of_an_upright_page_is_a_cut():
    plane = RANDOM.uniform(0, 255, (20, 30))
    got = scan.warped(plane, [(5, 4), (14, 4), (14, 11), (5, 11)], 10, 8)
    assert np.allclose(got, plane[4:12, 5:15])
    assert scan.sampled(np.array([[0.0, 10.0], [20.0, 30.0]]), np.array([0.5, -3]), np.array([0.5, 9])).tolist() == [15.0, 20.0]


def test_resizing_keeps_means():
    plane = RANDOM.uniform(0, 255, (12, 18))
    assert np.allclose(scan.resized(plane, 9, 4), plane.reshape(4, 3, 9, 2).mean((1, 3)))
    assert np.isclose(scan.resized(plane, 7, 5).mean(), plane.mean()) and scan.turned(plane, 1)[0, -1] == plane[0, 0]


def test_ink_and_lighting():
    page = np.full((40, 40), 200.0) + np.linspace(0, 40, 40)
    page[10:12, 5:30] = 30
    ink = scan.sauvola(page, 6)
    assert ink[10:12, 5:30].all() and ink.sum() == 50
    assert np.abs(scan.lighting(page) - (200 + np.linspace(0, 40, 40))).max() < 3
    assert (scan.stretched(50, 60) == np.arange(256)).all()
    assert scan.stretched(50, 150)[[0, 50, 100, 150, 255]].tolist() == [0, 0, 127, 255, 255]  # 50 * (255 / 100) is just under 127.5


def _flooded(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = n
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return labels


def test_components_match_a_flood():
    for share in (0.1, 0.3, 0.45, 0.7):
        mask = RANDOM.random((25, 31)) < share
        assert (scan.components(mask) == _flooded(mask)).all()
    assert not scan.components(np.zeros((3, 4), bool)).any()


def test_hull_holds_all_points():
    points = RANDOM.integers(0, 20, (60, 2))
    around = scan.hull(points)
    edge = np.roll(around, -1, 0) - around
    for p in points:
        assert (edge[:, 0] * (p[1] - around[:, 1]) - edge[:, 1] * (p[0] - around[:, 0]) >= -1e-9).all()
    assert scan.hull([(1, 1), (1, 1)]).tolist() == [[1, 1]]
    assert scan.corners_in_order([(9, 8), (0, 1), (1, 9), (10, 0)]).tolist() == [[0, 1], [10, 0], [9, 8], [1, 9]]
