"""Rectangles, page transforms and colours as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    """Edges of an axis-aligned rectangle, top left origin."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @property
    def area(self) -> Column:
        return (self.right - self.left) * (self.bottom - self.top)

    def intersects(self, o: Rect) -> Column:
        return (self.left < o.right) & (o.left < self.right) & (self.top < o.bottom) & (o.top < self.bottom)

    def common_area(self, o: Rect) -> Column:
        wide = F.greatest(F.lit(0.0), F.least(self.right, o.right) - F.greatest(self.left, o.left))
        high = F.greatest(F.lit(0.0), F.least(self.bottom, o.bottom) - F.greatest(self.top, o.top))
        return wide * high

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(self.left, self.right) & y.between(self.top, self.bottom)

    def covers(self, o: Rect, slack: float = 0.0) -> Column:
        return (o.left >= self.left - slack) & (o.right <= self.right + slack) & (o.top >= self.top - slack) & (o.bottom <= self.bottom + slack)

    def inflated(self, by: float) -> Rect:
        return Rect(self.left - by, self.top - by, self.right + by, self.bottom + by)


def turned(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of an unrotated page, bottom left origin, as shown with the page turned by 0, 90, 180 or 270."""
    shown_x = F.when(rotation == 0, x).when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, height - y)
    shown_y = F.when(rotation == 0, height - y).when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, width - x)
    return shown_x, shown_y


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24) + F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")


def channel(colour: Column, shift: int) -> Column:
    return F.shiftright(colour, shift).bitwiseAND(255)


def hex_rgb(colour: Column) -> Column:
    return F.lpad(F.hex(colour.bitwiseAND(0xFFFFFF)), 6, "0")


def ink(colour: Column) -> Column:
    """A colour, or null where it is as good as black: every channel under 40."""
    dark = (channel(colour, 16) < 40) & (channel(colour, 8) < 40) & (channel(colour, 0) < 40)
    return F.when(~dark, colour)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a pixel in whole numbers, weights in 256ths."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def shoelace(points: Column) -> Column:
    """Area of a polygon given as an array of structs x, y."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (F.pmod(i + 1, n) + 1).cast("int"))["y"] - F.element_at(points, (F.pmod(i + 1, n) + 1).cast("int"))["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def _next(points: Column, i: Column, step: int = 1) -> Column:
    return F.element_at(points, (F.pmod(i + step, F.size(points)) + 1).cast("int"))


def perimeter(points: Column) -> Column:
    """Length around a polygon given as an array of structs x, y."""
    sides = F.transform(points, lambda p, i: F.hypot(_next(points, i)["x"] - p["x"], _next(points, i)["y"] - p["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda a, s: a + s)


def turns(points: Column) -> Column:
    """The cross product at each corner; of one sign in convex polygons."""
    def cross(p: Column, i: Column) -> Column:
        q, r = _next(points, i), _next(points, i, 2)
        return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    return F.transform(points, cross)


def is_convex(points: Column) -> Column:
    """Whether all corners turn the same way, none of them straight on."""
    t = turns(points)
    return F.forall(t, lambda x: x > 0) | F.forall(t, lambda x: x < 0)


def line_rects(signs: Column, margin: float = 1.0) -> Column:
    """Rectangles (l, t, r, b) of signs in their order, one for each line, made larger by ``margin``.

    A sign goes on with a line if its middle is within half the line's height of the
    line's and it begins and ends near it; signs without an area take no part.
    """
    seen = F.filter(signs, lambda c: (c["r"] > c["l"]) & (c["b"] > c["t"]))
    box = lambda x, y: F.struct(*(f(x[k], y[k]).alias(k) for k, f in (("l", F.least), ("t", F.least), ("r", F.greatest), ("b", F.greatest))))

    def step(done: Column, c: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        high, off = last["b"] - last["t"], F.abs((last["t"] + last["b"] - c["t"] - c["b"]) / 2)
        near = (off < high * 0.5) & (c["l"] <= last["r"] + high * 1.5) & (c["r"] >= last["l"] - high)
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(box(last, c)))).otherwise(F.concat(done, F.array(box(c, c))))

    lines = F.aggregate(seen, F.array().cast("array<struct<l:double,t:double,r:double,b:double>>"), step)
    return F.transform(lines, lambda x: F.struct((x["l"] - margin).alias("l"), (x["t"] - margin).alias("t"), (x["r"] + margin).alias("r"), (x["b"] + margin).alias("b")))
