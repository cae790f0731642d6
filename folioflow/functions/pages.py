"""The corners of a page on a photo: edges, lines and areas propose quadrilaterals, and the one that edges support best is taken.

All quadrilaterals are rows of arrays (n, 4, 2), clockwise on a screen, so that a
step looks at all of them at once, those of several photos of one size together;
``of`` tells the photo of each. Coordinates are those of pixel middles.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import lru_cache
from itertools import combinations

import numpy as np

from folioflow.functions import raster, scan
from folioflow.functions.colors import LIGHT, whole

# Side of the copy that is looked at, least side and share of a page, how far corners may lie outside, its angles.
SIDE, SMALLEST, SHARE, OUTSIDE, ANGLES = 384, 16, 0.13, 0.04, (30, 150)
#: Edges: blur, least slope, strong ones as a share of what Otsu's rule tells or in medians of all slopes, weak ones as a share of these.
BLUR, SLOPE, STRONG, OVER_MEDIAN, LEAST_STRONG, WEAK = 1.4, 0.5, 0.6, 3.0, 2.0, 0.4
#: How far apart the inside and outside of a side are looked at, the least step between them, support that a border of the photo counts for.
REACH, LEAST_STEP, BORDER_SUPPORT, BORDER_NEAR = 3.0, 8.0, 0.55, 2.5
#: Least support of each side that is no border, by the number of borders.
LEAST_SUPPORT = (0.45, 0.55, 0.65)
#: Lines closer to parallel than this sine don't meet.
PARALLEL = 0.17
#: Own choices: lines and rough quadrilaterals that are looked at, areas and points of an outline, pixels that a side may move.
LINES, TRIED, AREAS, OUTLINE, MOVE = 16, 24, 3, 64, 6.0
#: Images of one size that are looked at together, and sides that are moved at a time.
TOGETHER, SIDES = 16, 16
#: Odd factors that the bits of a side's ends are mixed by.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def paperness(image: np.ndarray) -> np.ndarray:
    """Light less half of how far a pixel is from grey: paper is bright and neutral."""
    image = image.astype(float)
    return image @ np.array(LIGHT) - 0.5 * (image.max(-1) - image.min(-1))


def otsu(plane: np.ndarray) -> int:
    """The value that parts whole numbers 0 to 255 with the most variance between both sides."""
    counts = np.bincount(plane.ravel(), minlength=256).astype(float)
    below, sums = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


@dataclass
class Edges:
    """A blurred plane, or a stack of planes, with its slopes, edge pixels and the step that counts as contrast."""

    plane: np.ndarray
    dx: np.ndarray
    dy: np.ndarray
    slope: np.ndarray
    mask: np.ndarray
    step: np.ndarray | float


def stacked(several: list[Edges]) -> Edges:
    return Edges(*(np.stack([getattr(e, f.name) for e in several]) for f in fields(Edges)))


def edges(plane: np.ndarray) -> Edges:
    """slopes over three by three pixels, thinned to ridges; ridges that are strong or touch strong ones are edges."""
    g = raster.gaussian_blur(plane, BLUR).astype(float)
    dx, dy = np.zeros(g.shape), np.zeros(g.shape)
    across, down = g[:, 2:] - g[:, :-2], g[2:] - g[:-2]
    dx[1:-1, 1:-1] = (across[:-2] + 2 * across[1:-1] + across[2:]) / 8
    dy[1:-1, 1:-1] = (down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]) / 8
    slope = np.hypot(dx, dy)
    eighth = np.floor(np.degrees(np.arctan2(dy, dx)) / 45 + 0.5).astype(int) % 4
    wide = np.pad(slope, 1)
    h, w = slope.shape
    moved = lambda x, y: wide[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    ways = ((1, 0), (1, 1), (0, 1), (-1, 1))
    before, behind = (np.choose(eighth, [moved(s * x, s * y) for x, y in ways]) for s in (-1, 1))
    ridge = np.where((slope >= SLOPE) & (slope >= before) & (slope > behind), slope, 0)
    top = ridge.max(initial=0)
    split = (otsu((ridge[ridge > 0] * (255 / top)).astype(int)) + 0.5) * top / 255 if top else 0.0
    strong = max(STRONG * split, OVER_MEDIAN * float(np.median(slope)), LEAST_STRONG)
    labels = scan.components(ridge >= WEAK * strong)
    held = np.bincount(labels[ridge >= strong], minlength=labels.max(initial=0) + 1) > 0
    held[0] = False
    mask = held[labels]
    apart = np.concatenate([np.abs(g[:, 4:] - g[:, :-4]).ravel(), np.abs(g[4:] - g[:-4]).ravel()])
    return Edges(g, dx, dy, slope, mask, max(LEAST_STEP, 3 * float(np.median(apart))) if len(apart) else LEAST_STEP)


def lines(e: Edges) -> np.ndarray:
    """(a, b, c) of lines a * x + b * y = c that most edge pixels vote for, each for directions within ten degrees of its own; then the borders."""
    h, w = e.plane.shape
    y, x = np.nonzero(e.mask)
    own = np.degrees(np.arctan2(e.dy[y, x], e.dx[y, x]))
    degree = (np.floor(own + 0.5).astype(int)[:, None] + np.arange(-10, 11)) % 180
    cos, sin = np.cos(np.radians(np.arange(180))), np.sin(np.radians(np.arange(180)))
    reach = int(np.hypot(h, w)) + 2
    at = np.floor((x[:, None] * cos[degree] + y[:, None] * sin[degree]) / 2 + 0.5).astype(int) + reach // 2
    size = reach + 2
    votes = np.bincount((degree * size + at).ravel(), minlength=180 * size).reshape(180, size).astype(float)
    votes = votes + np.pad(votes, ((0, 0), (1, 0)))[:, :-1] / 2 + np.pad(votes, ((0, 0), (0, 1)))[:, 1:] / 2
    least, found = 0.12 * min(h, w), []
    for _ in range(LINES):
        t, r = np.unravel_index(votes.argmax(), votes.shape)
        if votes[t, r] < least:
            break
        found.append((cos[t], sin[t], (r - reach // 2) * 2.0))
        for d in range(-7, 8):
            turned = (t + d) % 180
            middle = r if 0 <= t + d < 180 else 2 * (reach // 2) - r  # a half turn on, a line lies at the other side
            votes[turned, max(0, middle - 4) : middle + 5] = 0
    return np.array([*found, (1, 0, 0), (1, 0, w - 1), (0, 1, 0), (0, 1, h - 1)], float)


def met(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where lines (..., 3) meet; nan where they are nearly parallel."""
    (a, b, c), (d, e, f) = np.moveaxis(one, -1, 0), np.moveaxis(other, -1, 0)
    det = a * e - b * d
    det = np.where(np.abs(det) < PARALLEL, np.nan, det)
    return np.stack([(c * e - b * f) / det, (a * f - c * d) / det], -1)


def _following(quads: np.ndarray) -> np.ndarray:
    return quads[:, [1, 2, 3, 0]]


def areas(quads: np.ndarray) -> np.ndarray:
    """areas, over 0 where the corners go round clockwise on a screen."""
    following = _following(quads)
    return (quads[..., 0] * following[..., 1] - quads[..., 1] * following[..., 0]).sum(-1) / 2


def plausible(quads: np.ndarray, of: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadrilaterals that are convex, large, within the photo or almost and of no extreme angle, clockwise, and their photos."""
    finite = np.isfinite(quads).all((1, 2))
    quads, of = quads[finite], of[finite]
    quads = np.where((areas(quads) < 0)[:, None, None], quads[:, ::-1], quads)
    ahead, back = _following(quads) - quads, quads[:, [3, 0, 1, 2]] - quads
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = (ahead * back).sum(-1) / (np.linalg.norm(ahead, axis=-1) * np.linalg.norm(back, axis=-1))
    angle = np.degrees(np.arccos(np.clip(np.nan_to_num(cosine, nan=1.0), -1, 1)))
    convex = (ahead[..., 0] * back[..., 1] - ahead[..., 1] * back[..., 0] > 0).all(1)
    slack = OUTSIDE * max(h, w)
    inside = (quads >= -slack).all((1, 2)) & (quads <= np.array([w - 1, h - 1]) + slack).all((1, 2))
    fits = (angle >= ANGLES[0]).all(1) & (angle <= ANGLES[1]).all(1)
    held = convex & inside & fits & (areas(quads) >= SHARE * (w - 1) * (h - 1))
    return quads[held], of[held]


@lru_cache(maxsize=64)
def _fours(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4)), int).reshape(-1, 4)


def from_lines(found: np.ndarray, h: int, w: int) -> np.ndarray:
    """Quadrilaterals of any four lines, in each of the three ways to make two pairs of opposite sides, but those with a corner far off the photo.

    Where two lines meet is worked out once.
    """
    n, fours, slack = len(found), _fours(len(found)), OUTSIDE * max(h, w)
    corner = met(found[:, None], found[None]).reshape(-1, 2)
    near = ((corner >= -slack) & (corner <= np.array([w - 1, h - 1]) + slack)).all(1)
    tried = []
    for p, q, r, s in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)):
        a, b, c, d = (fours[:, k] for k in (p, q, r, s))
        ends = np.stack([a * n + c, c * n + b, b * n + d, d * n + a], 1)
        tried.append(corner[ends[near[ends].all(1)]])
    return np.concatenate(tried)


def largest_inside(outline: np.ndarray) -> np.ndarray | None:
    """The largest quadrilateral with corners on a convex outline: a diagonal and the farthest points on both sides of it."""
    if len(outline) < 4:
        return None
    p = outline[np.linspace(0, len(outline) - 1, min(len(outline), OUTLINE)).astype(int)]
    along = p[None] - p[:, None]
    off = along[:, :, None, 0] * (p[None, None, :, 1] - p[:, None, None, 1]) - along[:, :, None, 1] * (p[None, None, :, 0] - p[:, None, None, 0])
    i, j = np.unravel_index((off.max(-1) - off.min(-1)).argmax(), off.shape[:2])
    return np.array([p[i], p[off[i, j].argmax()], p[j], p[off[i, j].argmin()]])


def from_areas(e: Edges) -> np.ndarray:
    """Quadrilaterals of the largest bright, dark and edge-enclosed areas."""
    h, w = e.plane.shape
    bright = e.plane > otsu(whole(e.plane))
    enclosed = raster.rank_filter(e.mask, 1, True) == 0
    tried = []
    for mask in (bright, ~bright, enclosed):
        labels = scan.components(mask)
        sizes = np.bincount(labels.ravel())[1:]
        for n in np.argsort(-sizes, kind="stable")[:AREAS]:
            if sizes[n] >= SHARE / 2 * h * w:
                y, x = np.nonzero(labels == n + 1)
                low, high = (f.reduceat(x, np.flatnonzero(np.diff(y, prepend=-1))) for f in (np.minimum, np.maximum))
                rows = np.unique(y)
                quad = largest_inside(scan.hull(np.concatenate([np.column_stack([low, rows]), np.column_stack([high, rows])])))
                tried += [] if quad is None else [quad]
    return np.array(tried, float).reshape(-1, 4, 2)


def _apart(quads: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sides (m, 4) of quadrilaterals, from one end to the other, their photos, and (n, 4) which of them each has."""
    sides, photos = np.concatenate([quads, _following(quads)], -1).reshape(-1, 4), np.repeat(of, 4)
    mixed = (np.ascontiguousarray(sides).view(np.uint64) * MIX).sum(1) + photos.astype(np.uint64)
    _, kept, held = np.unique(mixed, return_index=True, return_inverse=True)
    if (sides[kept][held] != sides).any() or (photos[kept][held] != photos).any():  # two sides of one mixed value
        kept = held = np.arange(len(sides))
    return sides[kept], photos[kept], held.reshape(-1, 4)


def _along(sides: np.ndarray, samples: int) -> tuple[np.ndarray, ...]:
    """x and y (m, samples) of points along sides but their ends, and of the outward normals (m, 1)."""
    along = sides[:, 2:] - sides[:, :2]
    share = 0.06 + 0.88 * (np.arange(samples) + 0.5) / samples
    length = np.maximum(np.linalg.norm(along, axis=-1, keepdims=True), 1e-9)
    return *(sides[:, n, None] + along[:, n, None] * share for n in (0, 1)), along[:, 1:] / length, -along[:, :1] / length


def _edges_along(e: Edges, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether an edge that rises outwards, and one that falls outwards, is within a pixel of points (m, samples): (2, m, samples)."""
    h, w = e.plane.shape[1:]
    hit = np.zeros((2, x.size), bool)
    mask, dx, dy, slope = (plane.ravel() for plane in (e.mask, e.dx, e.dy, e.slope))
    base = of[:, None] * (h * w)
    across, down = ([(np.minimum(np.maximum(at + o, 0), size - 1) * step + more).ravel() for o in (-1, 0, 1)] for at, size, step, more in ((np.floor(x + 0.5).astype(int), w, 1, 0), (np.floor(y + 0.5).astype(int), h, w, base)))
    nx, ny = (np.repeat(n[:, 0], x.shape[1]) for n in (nx, ny))
    for right in across:
        for below in down:
            at = right + below
            on = np.flatnonzero(mask.take(at))
            at = at.take(on)
            rise, limit = dx.take(at) * nx.take(on) + dy.take(at) * ny.take(on), 0.85 * slope.take(at)
            hit[0][on[rise >= limit]] = True
            hit[1][on[-rise >= limit]] = True
    return hit.reshape(2, *x.shape)


def _supported(e: Edges, sides: np.ndarray, of: np.ndarray, samples: int, full: bool) -> np.ndarray:
    """For each side how often its inside is brighter, and darker, than its outside, and if ``full`` how often an edge of that direction is there: (2 or 4, m)."""
    h, w = e.plane.shape[1:]
    x, y, nx, ny = _along(sides, samples)
    seen = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    within, beyond = (scan.sampled(e.plane, x + s * nx, y + s * ny, of) for s in (-REACH, REACH))
    step, least = within - beyond, e.step[of][:, None]
    found = [step > least, -step > least]
    if full:
        found += [*_edges_along(e, x, y, nx, ny, of)[::-1]]
    return np.stack([(f & seen).mean(-1) for f in found])


def scores(e: Edges, quads: np.ndarray, of: np.ndarray, samples: int, full: bool) -> np.ndarray:
    """How well sides are supported, times the least support and a little of the area; 0 for what can't be a page.

    A side's support is how often its inside differs from its outside as it does all
    around, and if ``full`` how often an edge of its direction is there as well. A side
    that many quadrilaterals have is looked at once.
    """
    h, w = e.plane.shape[1:]
    if not len(quads):
        return np.zeros(0)
    sides, photos, held = _apart(quads, of)
    near = [np.abs(sides[:, n::2] - at) < BORDER_NEAR for n, at in ((0, 0), (0, w - 1), (1, 0), (1, h - 1))]
    border = np.any([x.all(-1) for x in near], axis=0)[held]
    rows = max(1, scan.PLACES // samples)
    found = np.concatenate([_supported(e, sides[k : k + rows], photos[k : k + rows], samples, full) for k in range(0, len(sides), rows)], 1)[:, held]
    brighter = np.where(border, 0, found[0] - found[1]).sum(1) >= 0
    support = np.where(brighter[:, None], found[0], found[1])
    if full:
        support = (support + np.where(brighter[:, None], found[2], found[3])) / 2
    least = np.where(border, 1, support).min(1)
    support = np.where(border, BORDER_SUPPORT, support)
    borders = border.sum(1)
    sound = (borders <= 2) & (~np.bool_(full) | (least >= np.array(LEAST_SUPPORT)[np.minimum(borders, 2)]))
    return np.where(sound, support.mean(1) * support.min(1) * (areas(quads) / ((w - 1) * (h - 1))) ** 0.3, 0)


def _steepest(e: Edges, sides: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steepest places (m, 48, 2) near points along sides, and how steep they are: 0 off the photo."""
    h, w = e.plane.shape[1:]
    x, y, nx, ny = _along(sides, 48)
    shifts = np.arange(-MOVE, MOVE + 0.25, 0.5)
    across, down = scan.sampled_all([e.dx, e.dy], x[..., None] + shifts * nx[..., None], y[..., None] + shifts * ny[..., None], of)
    across *= nx[..., None]
    across += down * ny[..., None]
    steep = np.abs(across, out=across)
    best = steep.argmax(-1)
    at = np.stack([x + shifts[best] * nx, y + shifts[best] * ny], -1)
    return at, np.take_along_axis(steep, best[..., None], 2)[..., 0] * ((at >= 0) & (at <= [w - 1, h - 1])).all(-1)


def refined(e: Edges, quads: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides moved to the steepest places near them: the line of least weighted squares through these, outliers left out."""
    if not len(quads):
        return quads, of
    sides, photos, held = _apart(quads, of)
    found = [_steepest(e, sides[k : k + SIDES], photos[k : k + SIDES]) for k in range(0, len(sides), SIDES)]
    at, weight = (np.concatenate(x) for x in zip(*found))
    weight += 1e-9
    for _ in range(4):
        total = weight.sum(-1, keepdims=True)
        middle = (weight[..., None] * at).sum(1) / total
        off = at - middle[:, None]
        xx, xy, yy = ((weight * off[..., a] * off[..., b]).sum(-1) for a, b in ((0, 0), (0, 1), (1, 1)))
        angle = np.arctan2(2 * xy, xx - yy) / 2
        normal = np.stack([-np.sin(angle), np.cos(angle)], -1)
        away = np.abs((off * normal[:, None]).sum(-1))
        weight = np.where(away <= np.maximum(1.0, 2 * np.median(away, -1, keepdims=True)), weight, 1e-9)
    side = np.concatenate([normal, (normal * middle).sum(-1, keepdims=True)], -1)[held]
    return plausible(met(side[:, [3, 0, 1, 2]], side), of, *e.plane.shape[1:])


def _joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])


def quads_of(planes: list[np.ndarray]) -> list[np.ndarray | None]:
    """the corners of the page on each plane of paperness, all of one size, or nothing."""
    h, w = planes[0].shape
    if min(h, w) < SMALLEST:
        return [None] * len(planes)
    each = [edges(plane) for plane in planes]
    e = stacked(each)
    drawn, of = plausible(*_joined([from_lines(lines(x), h, w) for x in each]), h, w)
    rough = scores(e, drawn, of, 12, False)
    best = [np.flatnonzero(of == n) for n in range(len(planes))]
    best = np.concatenate([at[np.argsort(-rough[at], kind="stable")[:TRIED]] for at in best])
    areal, of_areal = plausible(*_joined([from_areas(x) for x in each]), h, w)
    tried, of = np.concatenate([drawn[best], areal]), np.concatenate([of[best], of_areal])
    moved, of_moved = refined(e, tried, of)
    tried, of = np.concatenate([tried, moved]), np.concatenate([of, of_moved])
    known = scores(e, tried, of, 80, True)
    out: list[np.ndarray | None] = []
    for n in range(len(planes)):
        at = np.flatnonzero(of == n)
        top = at[known[at].argmax()] if len(at) else -1
        out.append(scan.corners_in_order(tried[top]) if top >= 0 and known[top] > 0 else None)
    return out


def corners_of(images: list[np.ndarray]) -> list[np.ndarray | None]:
    """for each colour image the corners of the page, clockwise from the one nearest to the upper left; nothing if there is none.

    Images are looked at ``TOGETHER`` at a time where they are of one size.
    """
    out: list[np.ndarray | None] = [None] * len(images)
    sizes: dict[tuple[int, int], list[int]] = {}
    for n, image in enumerate(images):
        h, w = image.shape[:2]
        if min(h, w) >= SMALLEST:
            shrunk = min(1.0, SIDE / max(h, w))
            sizes.setdefault(tuple(max(1, int(side * shrunk + 0.5)) for side in (w, h)), []).append(n)
    for (sw, sh), places in sizes.items():
        for k in range(0, len(places), TOGETHER):
            some = places[k : k + TOGETHER]
            small = [np.stack([whole(scan.resized(images[n][..., c].astype(float), sw, sh)) for c in range(3)], -1) for n in some]
            for n, found in zip(some, quads_of([paperness(x) for x in small])):
                h, w = images[n].shape[:2]
                out[n] = None if found is None else np.clip((found + 0.5) * [w / sw, h / sh], 0, [w, h])
    return out


def corners(image: np.ndarray) -> np.ndarray | None:
    """``corners_of`` one image."""
    return corners_of([image])[0]
