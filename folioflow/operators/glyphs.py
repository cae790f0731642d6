"""Glyphs and text operators of pages put together: lines of styled spans, and blocks of lines that can be edited.

Both depend on what was put together before, so a page is one task's fold over its rows, which
holds a line or the open lines and blocks only; pages are independent of each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values, in sizes of type but for degrees: what keeps glyphs in a line, parts words, parts spans; how far text may be turned.
SAME_BASELINE, STEP_BACK, WORD_GAP, SPAN_GAP, MOST_DEGREES = 0.45, 0.6, 0.15, 0.8, 3.0
#: What joins operators to a line: baseline, size, gap before and behind; and a blank between them.
OP_BASELINE, OP_SIZE, OP_GAP, OP_BEFORE, OP_BLANK = 0.35, 0.3, 2.5, 1.0, 0.18
#: What joins lines to a block: sizes, least and most step, left edges.
BLOCK_SIZE, BLOCK_STEP, BLOCK_LEFT = 0.15, (0.5, 1.9), 3.0

#: So many rows of a batch are Python objects at a time.
AT_ONCE = 1024

STYLE = ("size", "bold", "italic", "font", "color", "underline", "strike", "link")
SPAN = "struct<text:string,x0:double,x1:double,size:double,bold:boolean,italic:boolean,font:string,color:bigint,underline:boolean,strike:boolean,link:string>"


def _lines(glyphs: Iterable[dict]) -> Iterator[list[dict]]:
    """Runs of glyphs on one baseline that don't step back behind what the run has reached."""
    run: list[dict] = []
    reach = 0.0
    for g in glyphs:
        if run:
            em = max(run[0]["size"], g["size"])
            if abs(g["baseline"] - run[0]["baseline"]) >= SAME_BASELINE * em or g["l"] < reach - STEP_BACK * em:
                yield run
                run = []
        if not run:
            reach = float("-inf")
        run.append(g)
        if not g["sign"].isspace():
            reach = max(reach, g["r"])
    if run:
        yield run


def _spans(run: list[dict]) -> list[dict]:
    """Spans of one style each; wide gaps part them too, narrower ones leave a blank. Empty ones are left out."""
    told, worn = [], {"underline": False, "strike": False, "link": None}
    for g in run:  # blanks wear the strokes and links of what stands before them
        blank = g["sign"].isspace()
        worn = worn if blank else {k: g[k] for k in worn}
        told.append((tuple({**g, **worn}[k] for k in STYLE), blank, g))
    out: list[dict] = []
    for style, held in groupby(told, lambda x: x[0]):
        fresh = True
        for _, blank, g in held:
            last = out[-1] if out else None
            gap = g["l"] - last["x1"] if last else 0.0
            em = max(g["size"], 1.0)
            apart = last is not None and not blank and gap > SPAN_GAP * em
            if last and not blank and not apart and gap > WORD_GAP * em and not last["text"].endswith(" "):
                last["text"] += " "
            if fresh or apart:
                out.append({"text": "", "x0": g["l"], "x1": g["l"], **dict(zip(STYLE, style))})
                fresh = False
            span = out[-1]
            if not blank:
                span["text"] += g["sign"]
                span["x1"] = max(span["x1"], g["r"])
            elif span["text"] and not span["text"].endswith(" "):
                span["text"] += " "
    return [{**s, "text": s["text"].rstrip(" ")} for s in out if s["text"].strip()]


def _by_page(df: DataFrame, names: list[str], keys: list[str], order: list[str], fields: str, read: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``read`` over the rows of each page, in order, as dicts of ``names``.

    Rows stream through it: pages stand together and sorted in the partitions, and no row or
    task holds a page, only what ``read`` keeps of it.
    """
    held = [n for n in dict.fromkeys([*order, *names]) if n not in keys]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    arrow = to_arrow_schema(StructType.fromDDL(f"{kinds}, {fields}"))
    # of equals in ``order`` the other columns tell which comes first; a given number of parts is not put together again for being small
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, *held).repartition(parts, *keys).sortWithinPartitions(*keys, *held)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                found = [*zip(*(part.column(n).to_pylist() for n in range(len(keys))))]
                yield from zip(found, part.select(held).to_pylist())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, page in groupby(told(batches), lambda x: x[0]):
            for row in read(x for _, x in page):
                out.append({**dict(zip(keys, key)), **row})
                if len(out) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(step, f"{kinds}, {fields}")


def lines(glyphs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, line_no, baseline, x0, y0, x1, y1, spans) of the glyphs of each page in the order they are drawn.

    ``glyphs``: l, t, r, b, sign, baseline, angle and the columns of ``STYLE``. Text
    turned by over three degrees and glyphs without a sign take no part; lines of
    blanks are left out.
    """
    names = ["l", "t", "r", "b", "sign", "baseline", *STYLE]
    shown = glyphs.where((F.abs("angle") <= MOST_DEGREES) & (F.col("sign") != ""))

    def read(page: Iterator[dict]) -> Iterator[dict]:
        count = 0
        for run in _lines(page):
            inked = [g for g in run if not g["sign"].isspace()]
            if spans := _spans(run):
                sides = {"x0": min(g["l"] for g in inked), "y0": min(g["t"] for g in inked), "x1": max(g["r"] for g in inked), "y1": max(g["b"] for g in inked)}
                yield {"line_no": count, "baseline": run[0]["baseline"], **sides, "spans": spans}
                count += 1

    return _by_page(shown, names, keys, order, f"line_no int, baseline double, x0 double, y0 double, x1 double, y1 double, spans array<{SPAN}>", read)


def _op_lines(ops: Iterable[dict]) -> Iterator[dict]:
    """Lines of operators, which come by baseline: a line that lies too far back for one takes none after it, so only a few are open at a time.

    Lines come in the order of their first operators, each once it and those before take no more.
    """
    out: deque[dict] = deque()
    open_: list[dict] = []
    for op in ops:
        base, size, left, right = op["baseline"], max(op["size"], 1.0), op["l"], op["r"]
        open_ = [x for x in open_ if base - x["baseline"] < OP_BASELINE * x["size"]]
        while out and base - out[0]["baseline"] >= OP_BASELINE * out[0]["size"]:
            yield out.popleft()
        line = next((x for x in reversed(open_) if abs(x["size"] - size) < OP_SIZE * x["size"] and left - x["r"] < OP_GAP * x["size"] and right > x["l"] - OP_BEFORE * x["size"]), None)
        if line is None:
            open_.append({"text": op["text"], "l": left, "t": op["t"], "r": right, "b": op["b"], "baseline": base, "size": size})
            out.append(open_[-1])
            continue
        part = left - line["r"] > OP_BLANK * line["size"] and not line["text"].endswith(" ") and not op["text"].startswith(" ")
        pair = (line["text"], op["text"]) if left >= line["l"] else (op["text"], line["text"])
        line.update(text=(" " if part else "").join(pair), l=min(line["l"], left), t=min(line["t"], op["t"]), r=max(line["r"], right), b=max(line["b"], op["b"]))
    yield from out


def _op_blocks(lines: Iterable[dict]) -> Iterator[dict]:
    """Blocks of lines, which come by baseline too; a block is held by its last line, its first line's left edge and its number of lines."""
    count = 0
    open_: list[dict] = []
    for line in lines:
        base, size, left, right = line["baseline"], line["size"], line["l"], line["r"]
        open_ = [x for x in open_ if base - x["baseline"] < BLOCK_STEP[1] * x["size"]]
        fits = lambda x: abs(x["size"] - size) < BLOCK_SIZE * x["size"] and base - x["baseline"] > BLOCK_STEP[0] * x["size"] and left < x["r"] and right > x["l"] and abs(left - x["left"]) < BLOCK_LEFT * x["size"]  # noqa: B023, E731
        block = next((x for x in reversed(open_) if fits(x)), None)
        if block is None:
            block = {"no": count, "lines": 0, "left": left}
            open_.append(block)
            count += 1
        block.update(baseline=base, l=left, r=right, lines=block["lines"] + 1, size=size)
        yield {"block_no": block["no"], "line_no": block["lines"] - 1, **line}


def text_blocks(ops: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(keys, block_no, line_no, text, l, t, r, b, baseline, size): lines of text operators, and the blocks they make.

    ``ops``: an id, l, t, r, b, baseline, size, text, angle and invisible. Operators
    join the last line that they fit, lines the last block; both in the order of
    baseline and left edge.
    """
    shown = ops.where(~F.col("invisible") & (F.trim("text") != "") & (F.abs("angle") < MOST_DEGREES))

    def read(page: Iterator[dict]) -> Iterator[dict]:
        by_left = (sorted(same, key=lambda x: x["l"]) for _, same in groupby(_op_lines(page), lambda x: x["baseline"]))
        return _op_blocks(chain.from_iterable(by_left))

    names = [id_col, "l", "t", "r", "b", "baseline", "size", "text"]
    return _by_page(shown, names, keys, ["baseline", "l", id_col], "block_no int, line_no int, text string, l double, t double, r double, b double, baseline double, size double", read)


def paragraph_texts(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text) of blocks as one would type them: lines (text, r, size) are joined, hyphens before a small letter go.

    A break stays where a line ends over four sizes left of its block's right edge.
    """
    by = Window.partitionBy(*keys)
    ahead = by.orderBy(*order)
    shown = F.rtrim("text")
    rest = F.rtrim(F.lead("text").over(ahead))
    marked = lines.select(*keys, *order, shown.alias("_shown"), rest.alias("_rest"), (F.col("r") < F.max("r").over(by) - F.col("size") * 4).alias("_short"), F.row_number().over(ahead).alias("_n"))
    own = F.when(F.col("_n") > 1, F.ltrim("_shown")).otherwise(F.col("_shown"))
    hyphen = F.col("_shown").endswith("-") & F.col("_rest").rlike("^\\p{Ll}")
    parted = F.when(F.col("_rest").isNull(), own).when(F.col("_short"), F.concat(own, F.lit("\n"))).when(hyphen, F.expr("left(_own, length(_own) - 1)")).otherwise(F.concat(own, F.lit(" ")))
    parts = F.array_sort(F.collect_list(F.struct("_n", parted.alias("x"))))
    return marked.withColumn("_own", own).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("text"))
