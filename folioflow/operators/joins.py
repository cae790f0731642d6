"""Joins of document editing: spatial, range, nearest, keyed updates and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import Rect


def rect(alias: str) -> Rect:
    return Rect(*(F.col(f"{alias}.{side}") for side in ("l", "t", "r", "b")))


def tiled(df: DataFrame, size: float, slack: float = 0.0) -> DataFrame:
    """A row for each tile that a row's rectangle touches, so that a spatial join is an equi join on tiles."""
    span = lambda low, high: F.sequence(F.floor((F.col(low) - slack) / size), F.floor((F.col(high) + slack) / size))
    return df.withColumn("tile_x", F.explode(span("l", "r"))).withColumn("tile_y", F.explode(span("t", "b")))


def redacted(glyphs: DataFrame, areas: DataFrame, keys: list[str], key: list[str], size: float = 64.0) -> DataFrame:
    """Glyphs that an area takes: it holds the centre or over a fifth of the glyph; each once."""
    g, a = tiled(glyphs, size).alias("g"), tiled(areas, size).alias("a")
    glyph, area = rect("g"), rect("a")
    centre = area.holds((glyph.left + glyph.right) / 2, (glyph.top + glyph.bottom) / 2)
    much = (glyph.area > 0) & (glyph.common_area(area) > glyph.area * 0.2)
    same = [F.col(f"g.{k}") == F.col(f"a.{k}") for k in (*keys, "tile_x", "tile_y")]
    hit = g.join(a, [*same, centre | much], "left_semi")
    return hit.select(*key).distinct()


def touched(items: DataFrame, areas: DataFrame, keys: list[str], key: list[str], size: float = 64.0) -> DataFrame:
    """Items that an area touches, with whether one area covers them whole."""
    i, a = tiled(items, size).alias("i"), tiled(areas, size).alias("a")
    same = [F.col(f"i.{k}") == F.col(f"a.{k}") for k in (*keys, "tile_x", "tile_y")]
    return i.join(a, [*same, rect("i").intersects(rect("a"))]).groupBy(*(F.col(f"i.{k}") for k in key)).agg(F.bool_or(rect("a").covers(rect("i"))).alias("covered"))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, reach: float, left_key: str, right_key: str) -> DataFrame:
    """For each left row the right row with the least distance in ``at`` of at most ``reach``; of equals the smaller key.

    Both sides are dealt to bands of width ``reach``; a match is in the same band or a next one.
    """
    band = F.floor(F.col(at) / reach)
    l = left.select(*keys, F.col(left_key), F.col(at).alias("_x"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))  # noqa: E741
    r = right.select(*keys, F.col(right_key), F.col(at).alias("_y"), band.alias("_band"))
    gap = F.abs(F.col("_x") - F.col("_y"))
    return l.join(r, [*keys, "_band"]).where(gap <= reach).groupBy(*keys, left_key).agg(F.min_by(right_key, F.struct(gap.alias("g"), F.col(right_key).alias("k"))).alias(right_key))


def updated(base: DataFrame, changes: DataFrame, key: str, column: str, allowed: Column) -> DataFrame:
    """``column`` replaced where a change exists and the row allows it."""
    new = changes.select(key, F.col(column).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.when(allowed & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


def without(df: DataFrame, keys: DataFrame, key: list[str], child_of: str | None = None) -> DataFrame:
    """Rows but those with a listed key, and but those whose parent has one."""
    listed = keys.select(*key).distinct()
    left = df.join(listed, key, "left_anti")
    if child_of is None:
        return left
    return left.join(listed.withColumnRenamed(key[-1], child_of), [*key[:-1], child_of], "left_anti")


def organised(spec: DataFrame, pages: DataFrame, out: str = "out") -> DataFrame:
    """Pages in the order of a specification (``out``, pos, file, index), numbered from 0 in each output: repeats allowed, blanks without a page.

    Where both have a ``turn`` in degrees, each use is turned from the page's own;
    blanks from 0. The result is 0 to 359.
    """
    if "turn" not in spec.columns:
        joined = spec.join(pages, ["file", "index"], "left")
    else:
        own = pages.withColumnRenamed("turn", "_own") if "turn" in pages.columns else pages.withColumn("_own", F.lit(0))
        turn = F.pmod(F.coalesce("_own", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(360))
        joined = spec.join(own, ["file", "index"], "left").withColumn("turn", turn).drop("_own")
    return joined.withColumn("position", F.row_number().over(Window.partitionBy(out).orderBy("pos")) - 1)


def split_ranges(pages: DataFrame, ranges: DataFrame, page: str) -> DataFrame:
    """Pages of each range, which may overlap: ranges are spelt out to an equi join."""
    return ranges.withColumn(page, F.explode(F.sequence("first", "last"))).join(pages, page)


#: Keys that more than one in this many of all rows have are broadcast; there are never more of them.
HOT_KEYS = 2000


def join_hot(rows: DataFrame, keyed: DataFrame, on: str, count: str = "n", least: int = 1000) -> DataFrame:
    """``rows`` with what ``keyed``, a written table of distinct keys with the number of rows that have each, says of their key.

    Frequent keys, a bounded number, go to their rows by broadcast, so no task gets a key's rows; all others are shuffled.
    """
    held = keyed.agg(F.sum(count).alias("all"), F.max(count).alias("most")).first()
    limit = max(least, (held["all"] or 0) // HOT_KEYS)
    if (held["most"] or 0) <= limit:
        return rows.join(keyed.drop(count), on)
    hot, cold = keyed.where(F.col(count) > limit).drop(count), keyed.where(F.col(count) <= limit).drop(count)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
