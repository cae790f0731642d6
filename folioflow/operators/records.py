"""Scans, filters and edits of a document's records: files, fields, annotations, bookmarks, images and content operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Annotation kinds that lists leave out, and the kinds that can be added.
HIDDEN_KINDS = ("Widget", "Popup")
KINDS = ("highlight", "underline", "strikeout", "squiggly", "ink", "square", "circle", "line", "arrow", "freetext", "note", "stamp", "link")
#: The flags of a permission mask, from its lowest bit on.
PERMISSIONS = ("print", "print_high", "modify", "copy", "annotate", "fill_forms", "extract_accessibility", "assemble")


def child_counts(entries: DataFrame, parent: str, name: str) -> DataFrame:
    """(parent, children): how many entries of each folder are visible."""
    return entries.groupBy(parent).agg(F.count_if(~F.col(name).startswith(".")).alias("children"))


def on_device(path: Column, extension: str, deepest: int = 8, skipped: str = "Android") -> Column:
    """S3: whether a walk of the device would find a file: by its extension, not too deep, under no hidden folder nor the system's."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    return F.lower(path).endswith(f".{extension}") & (F.size(parts) <= deepest) & ~hidden & (F.element_at(parts, 1) != skipped)


def pages_of(fields: DataFrame, widgets: DataFrame, pages: DataFrame, field: str, widget: str) -> DataFrame:
    """One row a widget with its field and page: its own page, else that which lists it, else -1."""
    joined = widgets.join(fields, field).join(pages.select(widget, F.col("page").alias("found_page")), widget, "left")
    return joined.withColumn("page", F.coalesce("page", "found_page", F.lit(-1))).drop("found_page")


def fillable(fields: DataFrame, page: Column) -> DataFrame:
    """Fields of a page that are neither hidden nor buttons."""
    return fields.where((F.col("page") == page) & ~F.coalesce("hidden", F.lit(False)) & (F.col("type") != "button"))


def listed_annotations(notes: DataFrame, page: Column | None = None) -> DataFrame:
    """Annotations with a rectangle but widgets and popups, of all pages or one."""
    rows = notes.where(~F.col("type").isin(*HIDDEN_KINDS) & F.col("l").isNotNull())
    return rows if page is None else rows.where(F.col("page") == page)


def hit(notes: DataFrame, keys: list[str], order: str, x: Column, y: Column, slack: float = 6.0) -> DataFrame:
    """Of each page the topmost annotation, no link, whose rectangle, made larger by ``slack``, holds a point."""
    held = (x >= F.col("l") - slack) & (x < F.col("r") + slack) & (y >= F.col("t") - slack) & (y < F.col("b") + slack)
    return notes.where((F.col("type") != "Link") & held).groupBy(*keys).agg(F.max(order).alias(order))


def with_ids(notes: DataFrame, page: str, index: str, own: str = "id") -> DataFrame:
    """Annotations without an id get ``p{page}#{index}``."""
    return notes.withColumn(own, F.coalesce(own, F.concat(F.lit("p"), F.col(page).cast("string"), F.lit("#"), F.col(index).cast("string"))))


def added(notes: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Annotations with new ones behind the last of their page; an unknown kind is an error when it is read."""
    known = F.when(F.col("type").isin(*KINDS), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("no such kind: "), F.col("type"))).cast("string"))
    last = notes.groupBy(*keys).agg((F.max("index") + 1).alias("first"))
    numbered = new.withColumn("type", known).join(last, keys, "left")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    numbered = numbered.withColumn("index", (F.coalesce("first", F.lit(0)) + place).cast(notes.schema["index"].dataType)).drop("first")
    return notes.unionByName(numbered.select(notes.columns))


def flattened(records: DataFrame, wanted: Column) -> DataFrame:
    """Records that become page content (drawn) and those that stay; hidden ones are not drawn and go."""
    drawn = wanted & ~F.coalesce("hidden", F.lit(False))
    return records.where(drawn | ~wanted).withColumn("drawn", drawn)


def without_pages(fields: DataFrame, removed: DataFrame, field: str) -> DataFrame:
    """Fields that have a widget on a page that stays."""
    gone = removed.select("page").distinct().withColumn("_gone", F.lit(True))
    left = fields.join(gone, "page", "left").groupBy(field).agg(F.bool_or(F.col("_gone").isNull()).alias("_stays"))
    return left.where("_stays").drop("_stays")


def latest_bookmarks(marks: DataFrame, keys: list[str], page: str, order: list[str]) -> DataFrame:
    """One bookmark a page, the one added last, as an array by page."""
    newest = marks.groupBy(*keys, page).agg(F.max(F.struct(*order)).alias("_last"))
    return newest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col("_last")))).alias("bookmarks"))


def from_page(page: Column, start: Column) -> list[Column]:
    """The order of pages from ``start`` on and then from the first."""
    return [page < start, page]


def in_range(pages: Column, count: Column) -> Column:
    """P10: of the pages asked for those that there are; where none were asked for all."""
    return F.coalesce(F.filter(pages, lambda p: (p >= 0) & (p < count)), F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>")))


def permissions(mask: Column) -> dict[str, Column]:
    """The flags of a permission mask."""
    return {name: mask.bitwiseAND(F.lit(1 << n)) != 0 for n, name in enumerate(PERMISSIONS)}


def split_every(pages: Column, n: int) -> Column:
    """U8: ranges (first, last) of ``n`` pages each, the last one shorter."""
    if n < 1:
        raise ValueError("a range needs a page")
    return F.when(pages > 0, F.transform(F.sequence(F.lit(1).cast("long"), pages, F.lit(n).cast("long")), lambda s: F.struct(s.alias("first"), F.least(s + n - 1, pages).alias("last"))))


def custom_ranges(told: Column, pages: Column) -> Column:
    """U8: the ranges of ``a-b, c``, which may overlap; null where a part is no range, is reversed or leaves the document."""
    parts = F.filter(F.transform(F.split(told, ","), lambda p: F.trim(p)), lambda p: p != "")
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("long")
    last = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("long"), first(p))
    sound = F.forall(parts, lambda p: p.rlike(r"^\d+\s*(-\s*\d+)?$") & (first(p) >= 1) & (last(p) <= pages) & (first(p) <= last(p)))
    return F.when(sound & (F.size(parts) > 0), F.transform(parts, lambda p: F.struct(first(p).alias("first"), last(p).alias("last"))))


# ---- images, vectors and content operators


def objects(images: DataFrame, keys: list[str], order: list[str], least: float = 4.0) -> DataFrame:
    """Images (l, t, r, b) over ``least`` on both sides, numbered before any is left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return images.withColumn("id", place).where((F.col("r") - F.col("l") > least) & (F.col("b") - F.col("t") > least))


def vectors(paths: DataFrame, keys: list[str], order: list[str], width: Column, height: Column) -> DataFrame:
    """Paths but those that only clip, are under 3 points on both sides or fill the page; numbered before any is left out."""
    wide, high = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return paths.withColumn("id", place).where(~F.col("clip_only") & ((wide >= 3) | (high >= 3)) & ~((wide > width * 0.95) & (high > height * 0.95)))


def shown_images(images: DataFrame, keys: list[str], order: list[str], width: Column, height: Column, most: int = 12) -> DataFrame:
    """Of each page the first ``most`` images, each stream and box once, but small ones and scanned backgrounds of text.

    A background covers over nine tenths of a page that has text.
    """
    box = ["l", "t", "r", "b"]
    sized = images.where((F.col("r") - F.col("l") >= 24) & (F.col("b") - F.col("t") >= 24))
    once = F.row_number().over(Window.partitionBy(*keys, "stream", *box).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    taken = sized.withColumn("_once", once).where("_once = 1").withColumn("_place", place).where(F.col("_place") <= most).drop("_once", "_place")
    across = F.greatest(F.lit(0.0), F.least(F.col("r"), width) - F.greatest(F.col("l"), F.lit(0.0)))
    down = F.greatest(F.lit(0.0), F.least(F.col("b"), height) - F.greatest(F.col("t"), F.lit(0.0)))
    covers = (width * height > 0) & (across * down / (width * height) > 0.9) & F.col("has_text")
    return taken.where((F.col("bytes") > 0) & ~covers)


def captioned(blocks: DataFrame, keys: list[str], order: str, caption: Column, spacing: Column) -> DataFrame:
    """For each image block the caption that goes with it: the next block, else the one before, within three line spacings.

    ``caption`` tells a block that can be one. A caption that an earlier image takes
    from behind is not there for the image after it.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    image = F.col("kind") == "image"
    near = lambda gap: (gap >= -2) & (gap <= 3 * spacing)
    marked = blocks.withColumns({
        "_caption": caption, "_next_gap": F.lead("y0").over(by) - F.col("y1"), "_prev_gap": F.col("y0") - F.lag("y1").over(by),
        "_to_table": (F.lead("kind", 2).over(by) == "table") & F.lower(F.lead("text").over(by)).startswith("table"),
    })
    ahead = image & F.coalesce(F.lead("_caption").over(by) & near(F.col("_next_gap")) & ~F.coalesce("_to_table", F.lit(False)), F.lit(False))
    marked = marked.withColumn("_ahead", ahead)
    free = ~F.coalesce(F.lag("_ahead", 2).over(by), F.lit(False))
    behind = image & ~F.col("_ahead") & F.coalesce(F.lag("_caption").over(by) & near(F.col("_prev_gap")) & free, F.lit(False))
    text = F.when(F.col("_ahead"), F.lead("text").over(by)).when(behind, F.lag("text").over(by))
    return marked.withColumn("caption", text).where(image).select(*keys, order, "caption")


def edited_images(images: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Images deleted, moved to another box or given another stream; what an edit leaves out stays."""
    new = edits.select(*key, "action", *(F.col(c).alias(f"_{c}") for c in ("l", "t", "r", "b", "stream")))
    joined = images.join(new, key, "left").where(F.coalesce(F.col("action") != "delete", F.lit(True)))
    boxes = {c: F.when(F.col("action") == "move", F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("l", "t", "r", "b")}
    return joined.withColumns({**boxes, "stream": F.when(F.col("action") == "replace", F.coalesce("_stream", "stream")).otherwise(F.col("stream"))}).select(images.columns)


def rewritten(ops: DataFrame, plan: DataFrame, unit: str, ordinal: str, body: str) -> DataFrame:
    """Content operators with those of a plan (action, before, after) replaced, left out or given neighbours.

    ``before`` and ``after`` hold what is put next to an operator; an action ``drop``
    leaves it out, ``put`` replaces it by the plan's own ``body``.
    """
    own = plan.select(unit, ordinal, "action", F.col(body).alias("_new"), "before", "after")
    joined = ops.join(own, [unit, ordinal], "left")
    kept = F.when(F.col("action") == "drop", F.array().cast("array<string>")).when(F.col("action") == "put", F.array("_new")).otherwise(F.array(body))
    parts = F.concat(F.coalesce("before", F.array().cast("array<string>")), kept, F.coalesce("after", F.array().cast("array<string>")))
    return joined.select(unit, ordinal, F.posexplode(parts).alias("part", body))


def appended(content: DataFrame, new: DataFrame, keys: list[str], order: str, place: str) -> DataFrame:
    """New content behind what each page has, in its own order."""
    last = content.groupBy(*keys).agg(F.max(place).alias("_last"))
    numbered = new.join(last, keys, "left")
    at = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return content.unionByName(numbered.withColumn(place, at.cast(content.schema[place].dataType)).select(content.columns))


def struck(glyphs: DataFrame, strokes: DataFrame, keys: list[str], key: str, tile: float = 32.0) -> DataFrame:
    """(key, underline, strike) of the glyphs (l, r, baseline, size) whose middle a thin stroke (l, t, r, b) runs past.

    At the baseline it underlines, through the small letters it strikes out. Both
    sides meet in stripes of ``tile`` points, so the join is an equi join.
    """
    size, base = F.col("size"), F.col("baseline")
    own = glyphs.select(*keys, key, ((F.col("l") + F.col("r")) / 2).alias("x"), "baseline", "size", F.explode(F.sequence(F.floor((base - size) / tile), F.floor((base + size) / tile))).alias("stripe"))
    middle, high = (F.col("t") + F.col("b")) / 2, F.col("b") - F.col("t")
    thin = strokes.where((high <= 2.5) & (F.col("r") - F.col("l") > 2)).select(*keys, "l", "r", middle.alias("y"), high.alias("high"), F.floor(middle / tile).alias("stripe"))
    met = own.join(thin, [*keys, "stripe"]).where(F.col("x").between(F.col("l"), F.col("r")) & (F.col("high") <= F.greatest(F.lit(1.5), size * 0.15)))
    under = (F.col("y") >= base - size * 0.05) & (F.col("y") <= base + size * 0.22)
    through = (F.col("y") < base - size * 0.15) & (F.col("y") > base - size * 0.6)
    return met.where(under | through).groupBy(*keys, key).agg(F.bool_or(under).alias("underline"), F.bool_or(through).alias("strike"))


def upright(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Text operators that are seen and turned by under three degrees, numbered by baseline and left edge."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("baseline", "l", "id")) - 1
    return ops.where(~F.col("invisible") & (F.abs("angle") < 3)).withColumn("place", place)


def layer_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """How many recognised words become a page's text layer: those with text and a width."""
    return words.groupBy(*keys).agg(F.count_if((F.trim("text") != "") & (F.col("r") > F.col("l"))).alias("words"))


def leadings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """the mean step between a block's baselines, 1.2 sizes of its first line where it has one line; and how far a new font is stretched.

    The ratio of the old width to the new one stays within 0.8 and 1.1; without either it is 1.
    """
    found = lines.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("baseline").alias("_low"), F.max("baseline").alias("_high"), F.min_by("size", F.struct("baseline", "id")).alias("_size"), F.sum(F.when(F.col("new_width") > 0, F.col("width"))).alias("_old"), F.sum(F.when(F.col("new_width") > 0, F.col("new_width"))).alias("_new"))
    leading = F.when(F.col("_n") < 2, F.col("_size") * 1.2).otherwise((F.col("_high") - F.col("_low")) / (F.col("_n") - 1))
    ratio = F.when((F.col("_old") > 0) & (F.col("_new") > 0), F.greatest(F.lit(0.8), F.least(F.lit(1.1), F.col("_old") / F.col("_new")))).otherwise(1.0)
    return found.select(*keys, leading.alias("leading"), ratio.alias("ratio"))


def decoded_spans(c: Column) -> Column:
    """spans of a JSON list, with defaults for what a span leaves out."""
    given = F.from_json(c, "array<struct<text:string,size:double,bold:boolean,color:bigint>>")
    return F.transform(given, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["size"], F.lit(10.0)).alias("size"), F.coalesce(s["bold"], F.lit(False)).alias("bold"), F.coalesce(s["color"], F.lit(0xFF000000)).alias("color")))


def same_blocks(one: DataFrame, other: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Blocks of two analyses that have the same number on the same page."""
    numbered = lambda df, name: df.select(*keys, F.col(order).alias(name), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_n"))
    return numbered(one, "left").join(numbered(other, "right"), [*keys, "_n"]).drop("_n")


def largest(df: DataFrame, keys: list[str], size: str, key: str, most: int) -> DataFrame:
    """The ``most`` largest of each group, of equals those with the smaller key; Spark limits before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), key))
    return df.withColumn("rank", place).where(F.col("rank") <= most)


def stretched(low: Column, high: Column) -> Column:
    """a lookup table of 256 entries that stretches low..high to 0..255; under 16 values nothing is stretched."""
    ends = F.struct(low.alias("low"), high.alias("high"))
    spread = lambda e, v: F.when(e["high"] - e["low"] >= 16, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - e["low"]) * (F.lit(255.0) / (e["high"] - e["low"])))) + 0.5)).otherwise(v)
    return _bound(ends, lambda e: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: spread(e, v).cast("int")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def looked_up(values: Column, *tables: Column) -> Column:
    """values 0 to 255 through one lookup table after the other."""
    for lut in tables:
        values = _bound(lut, _entries(values))
    return values


def without_first(parts: Column, n: Column) -> Column:
    """texts of spans without their first ``n`` signs in all, empty ones left out."""
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    kept = F.zip_with(parts, ends, lambda p, e: F.when(e - F.length(p) >= n, p).when(e > n, F.right(p, e - n)).otherwise(F.lit("")))
    return F.filter(kept, lambda p: p != "")


def tail_text(parts: Column, n: int) -> Column:
    """the last ``n`` signs of spans."""
    return F.right(F.array_join(parts, ""), F.lit(n))


def _entries(values: Column) -> Callable[[Column], Column]:
    return lambda lut: F.transform(values, lambda v: F.element_at(lut, v + 1))
