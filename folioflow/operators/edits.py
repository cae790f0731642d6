"""Document edits as transforms of tables: boxes, images, annotations, vectors, artifacts and metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import windows as w
from folioflow.operators.joins import rect, tiled

#: Smallest side of a page's crop box.
LEAST_SIDE = 10.0


def cropped(df: DataFrame, width: str, height: str) -> DataFrame:
    """D3: boxes (l, t, r, b) within their page, with whether they stay large enough to be used."""
    inside = lambda side, most: F.greatest(F.lit(0.0), F.least(F.col(side), F.col(most)))
    clamped = df.withColumns({"l": inside("l", width), "t": inside("t", height), "r": inside("r", width), "b": inside("b", height)})
    return clamped.withColumn("usable", (F.col("r") - F.col("l") >= LEAST_SIDE) & (F.col("b") - F.col("t") >= LEAST_SIDE))


def compressed(images: DataFrame, largest: str, dpi: float) -> DataFrame:
    """The scale for ``dpi`` of images (width, height, bits, stencil, bytes, new_bytes) and whether the new form is used.

    Stencils, images of one bit and small ones stay, as do those that win less than a
    twentieth; ``largest`` is the larger side in points where the image is placed largest.
    """
    pixels = F.greatest("width", "height")
    scale = F.when(F.col(largest) > 0, F.least(F.lit(1.0), F.col(largest) / 72.0 * dpi / pixels)).otherwise(1.0)
    tried = ~F.col("stencil") & (F.col("bits") > 1) & (F.col("width") * F.col("height") >= 64 * 64)
    used = tried & (F.col("new_bytes") < F.col("bytes") * 0.95)
    return images.withColumns({"scale": scale, "used": used, "after": F.when(used, F.col("new_bytes")).otherwise(F.col("bytes"))})


def remapped(x: Column, low: Column, high: Column, new_low: Column, new_high: Column) -> Column:
    """A coordinate at the same share of a moved or resized side; a side without length maps to the new low."""
    return F.when(high > low, new_low + (x - low) / (high - low) * (new_high - new_low)).otherwise(new_low)


def mapped(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """a point through the matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def transformed(df: DataFrame, m: tuple[float, float, float, float, float, float]) -> DataFrame:
    """The bounds of each rectangle's corners after the matrix."""
    xs, ys = zip(*(mapped(F.col(x), F.col(y), m) for x in "lr" for y in "tb"))
    return df.withColumns({"l": F.least(*xs), "t": F.least(*ys), "r": F.greatest(*xs), "b": F.greatest(*ys)})


def right_limits(blocks: DataFrame, keys: list[str], key: str, page_right: float, size: float = 64.0) -> DataFrame:
    """How far each block (l, t, r, b) may grow: to the next block beside it, else to the page's right edge.

    Blocks meet in stripes of the page, so that the join is an equi join.
    """
    striped = blocks.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("t") / size), F.floor(F.col("b") / size))))
    x, y = striped.alias("x"), striped.select(*keys, "stripe", "l", "t", "b").alias("y")
    beside = (F.col("y.l") >= F.col("x.r")) & (F.col("y.t") < F.col("x.b")) & (F.col("y.b") > F.col("x.t"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "stripe")]
    joined = x.join(y, [*same, beside], "left")
    return joined.groupBy(*(F.col(f"x.{k}") for k in (*keys, key))).agg(F.coalesce(F.min("y.l"), F.lit(page_right)).alias("limit"))


# Steps of tiled marks in their own widths and heights and at least in points; space of a mark at the page's edge; how far below its middle a text begins.
TILE_ACROSS, TILE_DOWN, TILE_LEAST, EDGE_HEIGHT, EDGE_SPACE, TEXT_RISE = 1.3, 4.0, 120.0, 30.0, 20.0, 0.35
POSITIONS = ("center", "top", "bottom", "tile")


def watermarked(pages: DataFrame, keys: list[str], width: str, height: str, wide: str, high: str, position: str = "center", degrees: float = 45.0, text: bool = True) -> DataFrame:
    """(keys, mark, x, y, cos, sin, dx, dy): where each page's marks stand and how they are turned.

    ``width`` and ``height`` are a page's, ``wide`` and ``high`` its mark's, a text or an image. One mark
    stands in the middle, at the top or at the bottom; ``tile`` covers the page in rows from below, every second one
    half a step further left. (x, y) is a mark's middle; it is drawn from (dx, dy) on, in axes turned by the angle.
    """
    if position not in POSITIONS:
        raise ValueError(f"no position {position}")
    w_, h_, page_w, page_h = (F.col(c).cast("double") for c in (wide, high, width, height))
    if position == "tile":
        step_x, step_y = F.greatest(w_ * TILE_ACROSS, F.lit(TILE_LEAST)), F.greatest(h_ * TILE_DOWN, F.lit(TILE_LEAST))
        # steps from a start that are less than one past the page's far side
        steps = lambda start, step, size: F.sequence(F.lit(0), (F.ceil((size + step - start) / step) - 1).cast("int"))
        rows = F.transform(steps(step_y / 2, step_y, page_h), lambda r: F.struct(r.alias("r"), F.when(r % 2 == 0, step_x / 2).otherwise(0.0).alias("start")))
        at = F.flatten(F.transform(rows, lambda row: F.transform(steps(row["start"], step_x, page_w), lambda c: F.struct((row["start"] + c * step_x).alias("x"), (step_y / 2 + row["r"] * step_y).alias("y")))))
    else:
        edge = F.greatest(h_, F.lit(EDGE_HEIGHT)) + EDGE_SPACE
        at = F.array(F.struct((page_w / 2).alias("x"), {"top": page_h - edge, "bottom": edge, "center": page_h / 2}[position].alias("y")))
    angle = math.radians(degrees)
    shown = pages.select(*keys, (-w_ / 2).alias("dx"), (-h_ * TEXT_RISE if text else -h_ / 2).alias("dy"), F.posexplode(at).alias("mark", "_at"))
    return shown.select(*keys, "mark", "_at.x", "_at.y", F.lit(math.cos(angle)).alias("cos"), F.lit(math.sin(angle)).alias("sin"), "dx", "dy")


def without_artifacts(ops: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, ours: Column) -> DataFrame:
    """Content operators but marked content that is ``ours``, with all that is nested in it.

    The depth is a running sum of marks that open and close; content is within a
    mark of ours from where it opens to where the depth falls below it again.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)
    held = ops.withColumn("_depth", depth).withColumn("_opens", opens & ours).withColumn("_closes", closes)
    # a mark of ours at depth d ends at the first closing mark that brings the depth to d - 1
    starts = held.where("_opens").select(*keys, F.col(order).alias("_from"), F.col("_depth").alias("_at"))
    ends = held.where("_closes").select(*keys, F.col(order).alias("_to"), (F.col("_depth") + 1).alias("_at"))
    from_behind = Window.partitionBy(*keys, "_at").orderBy(F.desc("_place"), F.desc("_end"))
    marks = starts.select(*keys, "_at", F.col("_from").alias("_place"), F.lit(0).alias("_end")).union(ends.select(*keys, "_at", F.col("_to").alias("_place"), F.lit(1).alias("_end")))
    pairs = marks.withColumn("_last", F.min(F.when(F.col("_end") == 1, F.col("_place"))).over(from_behind.rowsBetween(Window.unboundedPreceding, 0))).where("_end = 0")
    reach = pairs.groupBy(*keys, F.col("_place").alias(order)).agg(F.max(F.coalesce("_last", F.lit((1 << 62)))).alias("_last"))
    marked = held.join(reach, [*keys, order], "left").withColumn("_until", F.max("_last").over(upto))
    return marked.where(F.col("_until").isNull() | (F.col(order) > F.col("_until"))).select(ops.columns)


def overlaid(old: Column, new: Column, supplied: Column) -> Column:
    """A metadata value: only what was supplied changes, and blanks become null."""
    return F.when(supplied, F.nullif(F.trim(new), F.lit(""))).otherwise(old)


def first_link(items: DataFrame, links: DataFrame, keys: list[str], key: str, size: float = 64.0) -> DataFrame:
    """For each item (l, t, r, b) the first link, by ``ord``, whose rectangle holds the item's middle."""
    middle_x, middle_y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    points = items.select(*keys, key, middle_x.alias("mx"), middle_y.alias("my"), F.floor(middle_x / size).alias("tile_x"), F.floor(middle_y / size).alias("tile_y")).alias("i")
    areas = tiled(links, size).alias("a")
    same = [F.col(f"i.{k}") == F.col(f"a.{k}") for k in (*keys, "tile_x", "tile_y")]
    held = points.join(areas, [*same, rect("a").holds(F.col("i.mx"), F.col("i.my"))])
    return held.groupBy(*(F.col(f"i.{k}") for k in (*keys, key))).agg(F.min_by("a.link", "a.ord").alias("link"))


def fitted_lines(points: DataFrame, keys: list[str], x: str, y: str, weight: Column) -> DataFrame:
    """Centre and direction, an angle, of the line with the least weighted squared distances; from moments, so partial sums combine."""
    sums = {n: F.sum(weight * c).alias(n) for n, c in (("w", F.lit(1.0)), ("wx", F.col(x)), ("wy", F.col(y)), ("xx", F.col(x) * F.col(x)), ("xy", F.col(x) * F.col(y)), ("yy", F.col(y) * F.col(y)))}
    s = points.groupBy(*keys).agg(*sums.values()).where("w > 0").withColumns({"cx": F.col("wx") / F.col("w"), "cy": F.col("wy") / F.col("w")})
    xx, xy, yy = F.col("xx") / F.col("w") - F.col("cx") * F.col("cx"), F.col("xy") / F.col("w") - F.col("cx") * F.col("cy"), F.col("yy") / F.col("w") - F.col("cy") * F.col("cy")
    return s.select(*keys, "cx", "cy", (F.atan2(2 * xy, xx - yy) / 2).alias("angle"))


def continued(blocks: DataFrame, keys: list[str], order: list[str], text: str, ends: Column, goes_on: Column) -> DataFrame:
    """Blocks numbered by runs: a block goes on with the one before if that has no end and this starts as a rest does."""
    before = Window.partitionBy(*keys).orderBy(*order)
    marked = blocks.withColumn("_open", F.lag(~ends).over(before)).withColumn("_hyphen", F.lag(F.col(text).rlike("-$")).over(before))
    starts = ~(F.coalesce("_open", F.lit(False)) & (goes_on | F.coalesce("_hyphen", F.lit(False))))
    return w.islands(marked, starts, keys, order, "paragraph").drop("_open", "_hyphen")


def indent_levels(lefts: Column, body: Column) -> Column:
    """Left edges that begin a level, in rising order: each over 0.6 body sizes right of the last one kept."""
    up = F.array_sort(F.array_distinct(lefts))
    return F.aggregate(up, F.slice(up, 1, 1), lambda kept, x: F.when(x - F.element_at(kept, -1) > body * 0.6, F.concat(kept, F.array(x))).otherwise(kept))
