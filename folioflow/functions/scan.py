"""Kernels of page scans: perspective, resizing, thresholds, lighting, components and hulls. Planes are float arrays of one image."""

from __future__ import annotations

import numpy as np

from folioflow.functions.raster import mean_variance

#: Weight of the spread in Sauvola's threshold, and the spread that counts as full.
SAUVOLA, FULL_SPREAD = 0.25, 128.0
#: A range of fewer values isn't stretched.
LEAST_RANGE = 16
#: Places between pixels that are worked out at once, so that what is told of them stays near the processor.
PLACES = 1 << 13


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """the 3 x 3 matrix that takes four points to four others; ValueError where three of them are in line."""
    rows = []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    system = np.array(rows)
    if np.linalg.cond(system[:, :8]) > 1e12:
        raise ValueError("points in line have no perspective")
    return np.append(np.linalg.solve(system[:, :8], system[:, 8]), 1.0).reshape(3, 3)


def applied(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through a perspective."""
    moved = np.column_stack([points, np.ones(len(points))]) @ matrix.T
    return moved[:, :2] / moved[:, 2:]


def sampled(plane: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Values between pixels, from the four around; places outside take the nearest pixel."""
    return sampled_all([plane], x, y, of)[0]


def sampled_all(planes: list[np.ndarray], x: np.ndarray, y: np.ndarray, of: np.ndarray | None = None) -> list[np.ndarray]:
    """``sampled`` of planes of one size at the same places, which are worked out once, ``PLACES`` at a time.

    Planes may be stacks (n, height, width); ``of`` tells for each row of places which plane it takes.
    """
    h, w = planes[0].shape[-2:]
    flat, xs, ys = [plane.ravel() for plane in planes], x.reshape(len(x), -1), y.reshape(len(x), -1)
    right, below = int(w > 1), w * int(h > 1)
    out, rows = [np.empty(xs.shape) for _ in planes], max(1, PLACES // max(1, xs.shape[1]))
    for k in range(0, len(xs), rows):
        dx, dy = (np.minimum(np.maximum(v[k : k + rows], 0), most) for v, most in ((xs, w - 1), (ys, h - 1)))
        left, top = np.minimum(dx.astype(int), max(w - 2, 0)), np.minimum(dy.astype(int), max(h - 2, 0))
        dx -= left
        dy -= top
        ex, ey = 1 - dx, 1 - dy
        top *= w
        top += left
        if of is not None:
            top += of[k : k + rows, None] * (h * w)
        for plane, held in zip(flat, out):
            upper, lower = plane.take(top) * ex, plane.take(top + below) * ex
            upper += plane.take(top + right) * dx
            lower += plane.take(top + (right + below)) * dx
            upper *= ey
            lower *= dy
            np.add(upper, lower, out=held[k : k + rows])
    return [held.reshape(np.shape(x)) for held in out]


def warped(plane: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """the quadrilateral with ``corners`` (clockwise from the upper left) as an upright page."""
    page = np.array([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], float)
    back = homography(page, corners)
    y, x = np.mgrid[:height, :width]
    at = applied(back, np.column_stack([x.ravel(), y.ravel()]).astype(float))
    return sampled(plane, at[:, 0], at[:, 1]).reshape(height, width)


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """each new pixel the mean of the area it covers, borders by their share."""

    def shares(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        over = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(over, 0) * (m / n)

    h, w = plane.shape
    return shares(h, height) @ plane @ shares(w, width).T


def turned(plane: np.ndarray, quarters: int) -> np.ndarray:
    """Clockwise by quarters."""
    return np.rot90(plane, -quarters)


def sauvola(plane: np.ndarray, radius: int, k: float = SAUVOLA, closed: bool = False) -> np.ndarray:
    """which pixels are ink: below the local mean lowered where the local spread is small, in double precision; ``closed`` has pixels at that very value in it."""
    mean, variance = mean_variance(plane, radius)
    limit = mean * (1 + k * (np.sqrt(np.maximum(variance, 0)) / FULL_SPREAD - 1))
    return plane <= limit if closed else plane < limit


def stretched(low: float, high: float) -> np.ndarray:
    """a table of 256 values that spreads low..high over all; under 16 values there is too little to spread."""
    values = np.arange(256)
    if high - low < LEAST_RANGE:
        return values.astype(np.uint8)
    return np.floor(np.clip((values - low) * (255.0 / (high - low)), 0, 255) + 0.5).astype(np.uint8)


def lighting(plane: np.ndarray, passes: int = 5) -> np.ndarray:
    """A quadratic surface through the paper's brightness, fitted again and again without what lies well below it.

    The first fit takes the brighter half. Fewer than 12 samples have no surface but
    their upper median.
    """
    h, w = plane.shape
    across, down = (2 * np.arange(n) / max(n - 1, 1) - 1 for n in (w, h))
    terms = lambda x, y: np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], -1)
    step = max(1, min(h, w) // 40)
    samples, values = terms(*np.meshgrid(across[::step], down[::step])).reshape(-1, 6), plane[::step, ::step].astype(float).ravel()
    middle = np.sort(values)[len(values) // 2]
    weights, held = None, values >= middle
    for _ in range(passes):
        if held.sum() < 12 or np.linalg.matrix_rank(samples[held]) < 6:
            break
        weights = np.linalg.lstsq(samples[held], values[held], rcond=None)[0]
        fit = samples @ weights
        before, held = held, values >= fit - np.maximum(8.0, 0.1 * fit)
        if (before == held).all():
            break
    if weights is None or not weights.any():
        return np.full((h, w), max(float(middle), 1.0))
    return np.clip(terms(*np.meshgrid(across, down)) @ weights, 1, 255)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the areas that touch at sides or corners, in the order of their first pixels; 0 elsewhere.

    Pixels side by side are one run. Each pass hands the least run of either side of
    a touch to the first run of the other side and then jumps to the first run of that
    one, so that winding areas take few passes.
    """
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    turns = np.diff(wide.ravel(), prepend=0)
    starts, ends = np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)  # a run ends before its end
    low, high = np.searchsorted(ends, starts + (w + 1), side="right"), np.searchsorted(starts, ends + (w + 2), side="right")
    touched = np.maximum(high - low, 0)
    one = np.repeat(np.arange(len(starts)), touched)
    other = np.arange(len(one)) - np.repeat(touched.cumsum() - touched - low, touched)
    first = np.arange(len(starts))
    while True:
        a, b = first[one], first[other]
        if (a == b).all():
            break
        np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
        while (first != (ahead := first[first])).any():
            first = ahead
    labels = np.zeros((h, w), int)
    labels[np.asarray(mask, bool)] = np.repeat((first == np.arange(len(first))).cumsum()[first], ends - starts)
    return labels


def hull(points: np.ndarray) -> np.ndarray:
    """The corners around all points, none on a line between two others, counter-clockwise where y rises upwards."""
    held = np.asarray(points, float).reshape(-1, 2)
    held = held[np.lexsort((held[:, 1], held[:, 0]))]
    held = held[np.append(True, (held[1:] != held[:-1]).any(1))[: len(held)]]
    turns = held[1:, 0] != held[:-1, 0]
    ordered = held[(np.append(True, turns) | np.append(turns, True))[: len(held)]].tolist()  # the lowest and highest above each x
    if len(ordered) < 3:
        return np.array(ordered)

    def half(run) -> list:
        out: list = []
        for x, y in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(half(ordered) + half(reversed(ordered)))


def corners_in_order(points: np.ndarray) -> np.ndarray:
    """four corners clockwise on a screen, from the one nearest to the upper left."""
    p = np.asarray(points, float)
    away = p - p.mean(0)
    around = p[np.argsort(np.arctan2(away[:, 1], away[:, 0]), kind="stable")]
    return np.roll(around, -int(np.argmin(around.sum(1))), axis=0)
