"""What a document's lines tell of it as a whole: body size, line pitch, heading sizes, extents and what repeats in its margins.

All of it is aggregates and joins over a table of lines; the fold over a page (``layout``) reads the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators import aggregates as a

# Sizes from this many body sizes on are headings; shares of a page's
# height that are margin, and where a page number may stand as first or last line;
# the share of pages that a repeated text needs, and the most signs of a heading.
HEADING, MARGIN, NUMBER_MARGIN, REPEATED, HEADING_SIGNS = 1.15, 0.08, 0.15, 0.4, 250
#: Lines within so many points of the body size are body lines; steps between them that count, in body sizes; the place of the pitch among them.
BODY_POINTS, STEPS, PITCH_AT = 0.6, (0.5, 3.0), 0.35


def half(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def lines_of(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page, line_no, text, x0, y0, x1, y1, size) of lines with text; the size is that of most signs, of equals the first.

    A gap of over 0.15 sizes between two spans counts as a blank.
    """
    shown = spans.where(F.trim("text") != "").dropna(subset=["line_no", "span_no", "text", "x0", "y0", "x1", "y1", "size"])
    held = F.array_sort(F.collect_list(F.struct("span_no", "x0", "x1", "text", "size")))
    grouped = shown.groupBy(id_col, "page", "line_no").agg(held.alias("spans"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    blank = lambda out, s: F.when((s["x0"] - out["end"] > 0.15 * s["size"]) & ~out["text"].endswith(" ") & ~s["text"].startswith(" "), " ").otherwise("")
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    text = F.aggregate("spans", none, lambda out, s: F.struct(F.concat(out["text"], blank(out, s), s["text"]).alias("text"), s["x1"].cast("double").alias("end")), lambda out: out["text"])
    sizes = F.array_distinct(F.transform("spans", lambda s: s["size"].cast("double")))
    signs = lambda size: F.aggregate("spans", F.lit(0), lambda n, s: n + F.when(s["size"] == size, F.greatest(F.lit(1), F.length(F.trim(s["text"])))).otherwise(0))
    most = F.array_max(F.transform(sizes, lambda size, i: F.struct(signs(size).alias("n"), (-i).alias("i"), size.alias("size"))))["size"]
    return grouped.select(id_col, "page", "line_no", text.alias("text"), "x0", "y0", "x1", "y1", most.alias("size"))


def next_steps(lines: DataFrame, keys: list[str], key: str, body: Column) -> DataFrame:
    """(keys, key, step) from each line down to the next one that overlaps it in x and is half a body size to three below.

    Lines are dealt to bands of three body sizes; the next line is in at most two of them, so the join has equal
    keys whatever the number of columns, and each line meets only what is near it.
    """
    low, high = STEPS
    rows = lines.select(*keys, F.col(key).alias("_key"), body.alias("_body"), "x0", "x1", "y0").where("_body > 0")
    band = lambda y, size: F.floor(y / (size * high))
    upper = rows.select(*keys, "_key", "_body", F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.col("y0").alias("_y"))
    first, last = band(F.col("_y") + F.col("_body") * low, F.col("_body")), band(F.col("_y") + F.col("_body") * high, F.col("_body"))
    upper = upper.withColumn("_band", F.explode(F.sequence(first, last)))
    lower = rows.select(*keys, "_body", "x0", "x1", "y0", band(F.col("y0"), F.col("_body")).alias("_band"))
    step = F.col("y0") - F.col("_y")
    near = (step >= F.col("_body") * low) & (step <= F.col("_body") * high) & (F.least("x1", "_r") > F.greatest("x0", "_l"))
    return upper.join(lower, [*keys, "_body", "_band"]).where(near).groupBy(*keys, F.col("_key").alias(key)).agg(F.min(step).alias("step"))


def in_margin(height: Column) -> Column:
    """Whether the middle of a line (y0, y1) is in the top or bottom 8 % of its page."""
    middle = (F.col("y0") + F.col("y1")) / 2
    return F.coalesce((height > 0) & ((middle < height * MARGIN) | (middle > height * (1 - MARGIN))), F.lit(False))


def margin_lines(lines: DataFrame, pages: DataFrame, body: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with ``margin``, whether they are running heads, feet or page numbers.

    ``lines``: id, page, line_no, text, y0, y1, size; ``pages``: id, page, height, a row for each page; ``body``: id, body.
    In the margin that are page numbers, and texts under heading size that repeat, digits apart, on two pages at least and on 40 % of
    all. The first and last line of a page are, too, if they are page numbers in the top or bottom 15 %.
    """
    held = lines.join(pages.select(id_col, "page", F.col("height").cast("double").alias("_height")), [id_col, "page"], "left").join(body.select(id_col, F.col("body").alias("_body")), id_col, "left")
    held = held.withColumns({"_edge": in_margin(F.col("_height")), "_form": t.margin_text(F.col("text")), "_number": t.is_page_number(F.col("text"))})
    small = F.col("size") < F.coalesce("_body", F.lit(10.0)) * HEADING - 0.01
    seen = held.where(F.col("_edge") & small & (F.col("_form") != "")).groupBy(id_col, "_form").agg(F.count_distinct("page").alias("_on"))
    counts = pages.groupBy(id_col).agg(F.count("*").alias("_pages"))
    often = seen.join(counts, id_col).where(F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * REPEATED))).select(id_col, "_form", F.lit(True).alias("_often"))
    on_page = Window.partitionBy(id_col, "page")
    held = held.join(often, [id_col, "_form"], "left")
    first = F.min(F.struct("y0", "line_no")).over(on_page)["line_no"] == F.col("line_no")
    last = F.max(F.struct(F.col("y1"), (-F.col("line_no")).alias("n"))).over(on_page)["n"] == -F.col("line_no")
    middle = (F.col("y0") + F.col("y1")) / 2
    outer = F.coalesce((middle < F.col("_height") * NUMBER_MARGIN) | (middle > F.col("_height") * (1 - NUMBER_MARGIN)), F.lit(False))
    gone = (F.col("_edge") & (F.coalesce("_often", F.lit(False)) | F.col("_number"))) | ((first | last) & F.col("_number") & outer)
    return held.withColumn("margin", gone).select(*lines.columns, "margin")


def body_sizes(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, body): the size, to the half point, that most signs of a document have (A1); of equals the smaller."""
    weight = F.length(F.trim("text"))
    shown = spans.where((weight > 0) & (F.col("size") > 0)).withColumn("half", half(F.col("size")))
    return a.weighted_mode(shown, [id_col], "half", weight).select(id_col, F.col("half").alias("body"))


def statistics(lines: DataFrame, body: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, body, pitch, headings, text_left, text_right) from lines, which may have ``margin``, by aggregates: A5-A7, W5.

    The pitch is the 35th percentile of the steps of body lines (``next_steps``), 1.2 body sizes without any;
    headings are the distinct larger sizes of lines with letters that are not margin; the text's edges are
    medians over pages with three body lines at least, null without such pages.
    """
    sized = lines.join(body, id_col)
    heading = (half(F.col("size")) >= F.col("body") * HEADING - 0.01) & (F.length(t.strip(F.col("text"))) <= HEADING_SIGNS) & F.col("text").rlike("\\p{L}")
    heading = heading & ~F.col("margin") if "margin" in lines.columns else heading
    heads = sized.where(heading).groupBy(id_col).agg(a.size_clusters(F.collect_set(half(F.col("size")))).alias("headings"))
    bodied = sized.where(F.abs(F.col("size") - F.col("body")) <= BODY_POINTS)
    steps = next_steps(bodied, [id_col, "page"], "line_no", F.col("body"))
    pitch = a.placed_values(steps, [id_col], "step", {"pitch": a.at_share(PITCH_AT)})
    sides = bodied.groupBy(id_col, "page").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).where("n >= 3")
    edges = sides.groupBy(id_col).agg(F.median("x0").alias("text_left"), F.median("x1").alias("text_right"))
    found = body.join(pitch, id_col, "left").join(heads, id_col, "left").join(edges, id_col, "left")
    return found.select(id_col, "body", F.coalesce("pitch", F.col("body") * 1.2).alias("pitch"), F.coalesce("headings", F.array().cast("array<double>")).alias("headings"), "text_left", "text_right")


#: What a page tells of its document: a step of so many lines, a heading size, an edge of its text on the left or right.
STEP, HEAD, LEFT, RIGHT = range(4)


def page_statistics(pages: DataFrame, body: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``statistics`` of pages (id, page, spans, margin) that are held whole: spans sorted by line, margin the numbers of lines that are no headings.

    Each page tells its counts, which add up by value, so no line is shuffled again.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    given = pages.join(body.select(id_col, "body"), id_col).select(id_col, "spans", "margin", "body")

    def tell(batches):
        for batch in batches:
            page, what, value, n = _told(batch.column(1), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page, pa.int64())), pa.array(what, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=[id_col, "what", "value", "n"])

    counts = given.mapInArrow(tell, f"`{id_col}` {kind}, what int, value double, n long").groupBy(id_col, "what", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(id_col, "what")
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.repartition(F.col(id_col)).withColumn("_all", F.sum("n").over(group)).withColumn("_upto", upto)
    of = lambda what: F.when(F.col("what") == what, F.col("value"))
    found = placed.groupBy(id_col).agg(
        F.min(F.when(F.col("_upto") > a.at_share(PITCH_AT)(F.col("_all")), of(STEP))).alias("pitch"), a.size_clusters(F.collect_set(of(HEAD))).alias("headings"),
        F.percentile(of(LEFT), F.lit(0.5), F.col("n")).alias("text_left"), F.percentile(of(RIGHT), F.lit(0.5), F.col("n")).alias("text_right"),
    )
    found = body.select(id_col, "body").join(found, id_col, "left")
    return found.select(id_col, "body", F.coalesce("pitch", F.col("body") * 1.2).alias("pitch"), F.coalesce("headings", F.array().cast("array<double>")).alias("headings"), "text_left", "text_right")


def _told(spans: pa.ListArray, margin: pa.ListArray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, what, value, n) of pages' lines with text."""
    flat, lengths = spans.flatten(), spans.value_lengths().to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(spans)), lengths)
    number = flat.field("line_no").to_numpy(zero_copy_only=False)
    x0, y0, x1, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "size"))
    starts = np.flatnonzero(np.append(True, (np.diff(page) != 0) | (np.diff(number) != 0))[: len(page)])
    if not len(starts):
        return np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int)
    ends = np.append(starts[1:], len(page))
    held = lambda n: sorted(flat.slice(starts[n], ends[n] - starts[n]).to_pylist(), key=lambda s: tuple(s[c] for c in ("span_no", "x0", "x1", "text", "size")))
    sizes = size[starts]
    for n in np.flatnonzero(np.minimum.reduceat(size, starts) != np.maximum.reduceat(size, starts)).tolist():
        signs: dict[float, int] = {}
        for s in held(n):
            signs[float(s["size"])] = signs.get(float(s["size"]), 0) + max(1, len(s["text"].strip(" ")))
        sizes[n] = max(signs, key=signs.__getitem__)
    left, top, right, page, number = np.minimum.reduceat(x0, starts), np.minimum.reduceat(y0, starts), np.maximum.reduceat(x1, starts), page[starts], number[starts]
    of, out = body[page], []
    half_size = np.floor(sizes * 2 + 0.5) / 2
    heads = [n for n in np.flatnonzero(half_size >= of * HEADING - 0.01).tolist() if _heading(_line_text(held(n)))]
    if heads and len(margin.flatten()):
        gone = margin.to_pylist()
        heads = [n for n in heads if number[n] not in (gone[page[n]] or ())]
    out.append((page[heads], HEAD, half_size[heads], np.ones(len(heads), int)))
    bodied = np.flatnonzero(np.abs(sizes - of) <= BODY_POINTS)
    if len(bodied):
        first = np.flatnonzero(np.append(True, np.diff(page[bodied]) != 0))
        lines = np.diff(np.append(first, len(bodied)))
        for what, edge in ((LEFT, np.minimum.reduceat(left[bodied], first)), (RIGHT, np.maximum.reduceat(right[bodied], first))):
            out.append((page[bodied][first][lines >= 3], what, edge[lines >= 3], np.ones((lines >= 3).sum(), int)))
        out.append(_steps(page[bodied], left[bodied], top[bodied], right[bodied], of[bodied]))
    pages, values, counts = (np.concatenate([o[k] for o in out]) for k in (0, 2, 3))
    return pages, np.repeat([o[1] for o in out], [len(o[0]) for o in out]), values, counts


def _steps(page: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """W5, as ``next_steps``: each line meets those below it one after the other, until one overlaps it or is too far down."""
    low, high = STEPS
    order = np.lexsort((top, page))
    page, left, top, right, body = (x[order] for x in (page, left, top, right, body))
    open_, told, k = np.flatnonzero(body > 0), [], 1
    while len(open_):
        open_ = open_[open_ + k < len(page)]
        below = open_ + k
        step = top[below] - top[open_]
        near = (page[below] == page[open_]) & (step <= body[open_] * high)
        meets = near & (step >= body[open_] * low) & (np.minimum(right[below], right[open_]) > np.maximum(left[below], left[open_]))
        told.append((page[open_[meets]], step[meets]))
        open_, k = open_[near & ~meets], k + 1
    pages, steps = (np.concatenate([x[i] for x in told]) if told else np.empty(0) for i in (0, 1))
    pairs, counts = np.unique(np.stack([pages.astype(float), steps], 1), axis=0, return_counts=True)
    return pairs[:, 0].astype(int), STEP, pairs[:, 1], counts


def _line_text(spans: list[dict]) -> str:
    """A line's text, with a blank where a gap of over 0.15 sizes parts two spans (``lines_of``)."""
    text, end = "", None
    for s in spans:
        blank = end is not None and s["x0"] - end > 0.15 * s["size"] and not text.endswith(" ") and not s["text"].startswith(" ")
        text, end = f"{text}{' ' * blank}{s['text']}", float(s["x1"])
    return text


def _heading(text: str) -> bool:
    return len(text.strip(t.BLANKS)) <= HEADING_SIGNS and any(map(str.isalpha, text))
