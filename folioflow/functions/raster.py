"""Kernels over one image's plane, for Arrow functions: an image is one value, so its pixels never leave their row.

A plane is a two-dimensional numpy array. Windows reach ``radius`` to each side and
see the edge's pixels repeated beyond the edge.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _box_sums(plane: np.ndarray, radius: int) -> np.ndarray:
    """Sums over square windows, by differences of running sums: the time doesn't grow with the radius."""
    size = 2 * radius + 1
    running = np.pad(np.pad(plane, radius, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return running[size:, size:] - running[:-size, size:] - running[size:, :-size] + running[:-size, :-size]


def box_blur(plane: np.ndarray, radius: int) -> np.ndarray:
    """Mean over square windows."""
    if radius <= 0 or plane.size == 0:
        return plane.astype(np.float32)
    return (_box_sums(plane.astype(np.float64), radius) / (2 * radius + 1) ** 2).astype(np.float32)


def mean_variance(plane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Local mean and variance of an 8-bit plane in double precision, from sums of whole numbers."""
    if plane.size == 0:
        return plane.astype(float), plane.astype(float)
    whole, area = plane.astype(np.int64), (2 * radius + 1) ** 2
    mean = _box_sums(whole, radius) / area
    return mean, np.maximum(_box_sums(whole * whole, radius) / area - mean * mean, 0)


def box_mean_variance(plane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Local mean and variance of an 8-bit plane, held in single precision."""
    mean, variance = mean_variance(plane, radius)
    return mean.astype(np.float32), variance.astype(np.float32)


def rank_filter(plane: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Largest or smallest value of square windows, one axis after the other."""
    out = plane.astype(np.float32)
    for axis in (0, 1) if radius > 0 and plane.size else ():
        windows = sliding_window_view(np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), 2 * radius + 1, axis)
        out = windows.max(-1) if largest else windows.min(-1)
    return out


def gaussian_blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """A bell of three sigmas to each side, one axis after the other."""
    radius = max(1, int(np.ceil(3 * sigma)))
    bell = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    bell /= bell.sum()
    out = plane.astype(np.float64)
    for axis in (0, 1) if plane.size else ():
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sliding_window_view(padded, 2 * radius + 1, axis) @ bell
    return out.astype(np.float32)


def without_specks(plane: np.ndarray) -> np.ndarray:
    """Black pixels off the border whose eight neighbours are all white turn white."""
    out = plane.copy()
    if min(plane.shape) < 3:
        return out
    white = sliding_window_view(plane == 255, (3, 3)).sum((-2, -1)) == 8
    inner = out[1:-1, 1:-1]
    inner[white & (inner == 0)] = 255
    return out
