"""Queries over readers and sinks; folds that SQL can't express are held by tests instead of oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import layout, page_lines
from folioflow.operators import windows as w
from folioflow.plans.registry import query
from folioflow.plans.text_queries import LINES, TRIM
from folioflow.sinks import block_cache, html, markdown, word, workbook
from folioflow.sinks import plain_text as sink
from folioflow.sources import block_cache as cache_source
from folioflow.sources import markdown as markdown_source
from folioflow.sources import plain_text
from folioflow.sources import word as word_source
from folioflow.sources import workbook as workbook_source
from folioflow.session import table


@query("text_blocks")
def text_blocks(spark, sf_dir):
    """Every text as paragraphs, list items and page breaks."""
    return plain_text.read_blocks(table(spark, sf_dir, "documents"))


@query("exported_text")
def exported_text(spark, sf_dir):
    """The blocks of every text written out again, items numbered within their level's run."""
    blocks = plain_text.read_blocks(table(spark, sf_dir, "documents"))
    listed = F.col("kind") == "list_item"
    runs = w.islands(blocks.withColumn("level", F.lit(1)), ~listed, ["doc_id"], ["block_no"])
    return sink.rendered(w.ranked(runs, ["doc_id", "island", "indent", "ordered"], [F.col("block_no")], "number"))


@query("markdown_blocks")
def markdown_blocks(spark, sf_dir):
    """Every text read as Markdown."""
    return markdown_source.read_blocks(table(spark, sf_dir, "documents")).select("doc_id", "block_no", "kind", "level", "ordered", "marker", "indent", "spans", "rows")


@query("markdown_export")
def markdown_export(spark, sf_dir):
    """The blocks of every text as Markdown."""
    return markdown.rendered(plain_text.as_blocks(plain_text.read_blocks(table(spark, sf_dir, "documents"))))


@query("html_export")
def html_export(spark, sf_dir):
    """K2: the blocks of every text as a page."""
    return html.rendered(plain_text.as_blocks(plain_text.read_blocks(table(spark, sf_dir, "documents"))))


@query(
    "workbook_cells",
    """WITH s AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS INT) AS n, [coalesce(role, ''), coalesce(text, '')] AS v FROM conversations),
t AS (FROM s UNION ALL SELECT DISTINCT conv_id, 0, ['role', 'text'] FROM s),
b AS (SELECT conv_id, 3 AS block_no, n AS r, v FROM t UNION ALL SELECT conv_id, 1, n + 1, v FROM t UNION ALL SELECT DISTINCT conv_id, 1, 0, ['', ''] FROM s)
SELECT conv_id, block_no, r, CAST(c AS INT) AS c, v[c + 1] AS value FROM b, (SELECT unnest([0, 1]) AS c)""",
)
def workbook_cells(spark, sf_dir):
    """The turns of each conversation as a workbook's table, written, read back and dealt into cells of the sheet of all content and of its own."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.array(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("row"))))
    rows = F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), F.transform(said, lambda s: s["row"]))
    tables = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("rows"))
    blocks = tables.select("conv_id", F.lit(0).alias("block_no"), F.lit("table").alias("kind"), "rows", F.lit(True).alias("has_header"))
    back = workbook_source.read_blocks(workbook.rendered(blocks, "conv_id"), "conv_id").where("kind = 'table'")
    lines = back.select("conv_id", "block_no", F.posexplode("rows").alias("r", "line"))
    return lines.select("conv_id", "block_no", "r", F.posexplode("line").alias("c", "value"))


@query("document_round_trip")
def document_round_trip(spark, sf_dir):
    """The blocks of every text written as a DOCX file and read back."""
    blocks = plain_text.as_blocks(plain_text.read_blocks(table(spark, sf_dir, "documents")))
    back = word_source.read_blocks(word.rendered(blocks), "doc_id")
    text = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    return back.select("doc_id", "block_no", "kind", "level", "ordered", "marker", "indent", text.alias("text"))


def _spans(spark, sf_dir):
    """The lines of every text laid out on pages. A line in capitals counts as bold; a line that ends in a colon is set larger."""
    lines = w.document_lines(table(spark, sf_dir, "documents"), "doc_id", "text").where("trim(line) <> ''")
    y = F.pmod(F.col("line_no"), F.lit(50)) * 12.0
    size = F.when(F.col("line").rlike(":\\s*$"), 14.0).otherwise(10.0)
    indent = (F.length("line") - F.length(F.ltrim("line"))) * 5.0
    return lines.select(
        "doc_id", F.floor(F.col("line_no") / 50).cast("int").alias("page"), "line_no", F.lit(0).alias("span_no"), F.trim("line").alias("text"), indent.alias("x0"), y.alias("y0"),
        (F.length("line") * 5.0).alias("x1"), (y + size).alias("y1"), size.alias("size"), (F.upper("line") == F.col("line")).alias("bold"), F.lit(False).alias("italic"),
    )


_STEPS = """l AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS line_no, l_linenumber % 2 * 300.0::DOUBLE AS x0, l_linenumber % 2 * 300.0::DOUBLE + 200 + l_partkey % 3 * 60 AS x1, CAST(l_partkey * 7 % 3000 AS DOUBLE) AS y0 FROM lineitem)"""


@query("column_steps", f"WITH {_STEPS} SELECT a.page, a.line_no, min(b.y0 - a.y0) AS step FROM l a JOIN l b ON a.page = b.page AND b.y0 - a.y0 BETWEEN 5 AND 30 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY ALL")
def column_steps(spark, sf_dir):
    """From each line of pages in two columns, some lines across both, down to the next that overlaps it."""
    x0 = F.col("l_linenumber") % 2 * 300.0
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), x0.alias("x0"), (x0 + 200 + F.col("l_partkey") % 3 * 60).alias("x1"), (F.col("l_partkey") * 7 % 3000).cast("double").alias("y0"))
    return page_lines.next_steps(lines, ["page"], "line_no", F.lit(10.0))


@query(
    "margin_lines",
    rf"""WITH {LINES}, p AS (SELECT doc_id, line_no // 10 AS page, line_no, CASE line_no % 10 WHEN 0 THEN 'Report of ' || (doc_id % 5) || ', part ' || (line_no // 10) WHEN 9 THEN 'Page ' || (line_no // 10) || ' of 20' WHEN 8 THEN CAST(line_no AS VARCHAR) ELSE line END AS text, line_no % 10 * 60.0 AS y0, CASE WHEN line_no % 7 = 0 THEN 14.0 ELSE 10.0 END AS size FROM lines),
q AS (SELECT *, y0 + size / 2 AS middle, regexp_replace(regexp_replace(lower({TRIM.format('text')}), '[0-9]', '#', 'g'), '\s+', ' ', 'g') AS form, regexp_replace({TRIM.format('text')}, '\s+', ' ', 'g') AS t FROM p WHERE trim(text) <> ''),
r AS (SELECT *, middle < 48 OR middle > 552 AS edge, regexp_replace(t, '^[\s\-–—|]+|[\s\-–—|]+$', '', 'g') AS core, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, line_no) = 1 OR row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 + size DESC, line_no) = 1 AS outer_line FROM q),
n AS (SELECT *, t <> '' AND (regexp_matches(t, '^[\s\-–—|]*\d{{1,4}}[\s\-–—|]*$') OR regexp_matches(t, '(?i)^(page|p\.|pg\.?)\s*\d{{1,4}}(\s*(of|/)\s*\d{{1,4}})?$') OR regexp_matches(t, '(?i)^\d{{1,4}}\s*(of|/)\s*\d{{1,4}}$')
  OR (core <> '' AND length(core) <= 7 AND (core = lower(core) OR core = upper(core)) AND regexp_matches(lower(core), '^m{{0,4}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$'))) AS number FROM r),
o AS (SELECT doc_id, form FROM n JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1) USING (doc_id) WHERE edge AND size < 11.49 AND form <> '' GROUP BY doc_id, form, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages * 0.4)))
SELECT n.doc_id, CAST(n.page AS INT) AS page, CAST(n.line_no AS INT) AS line_no, (edge AND (o.form IS NOT NULL OR number)) OR (outer_line AND number AND (middle < 90 OR middle > 510)) AS margin FROM n LEFT JOIN o ON o.doc_id = n.doc_id AND o.form = n.form""",
)
def margin_lines(spark, sf_dir):
    """Which lines of pages of ten lines, with running heads, feet and numbers put in, are margin."""
    n, page = F.col("line_no") % 10, F.floor(F.col("line_no") / 10)
    head = F.concat(F.lit("Report of "), (F.col("doc_id") % 5).cast("string"), F.lit(", part "), page.cast("string"))
    foot = F.concat(F.lit("Page "), page.cast("string"), F.lit(" of 20"))
    text = F.when(n == 0, head).when(n == 9, foot).when(n == 8, F.col("line_no").cast("string")).otherwise(F.col("line"))
    size = F.when(F.col("line_no") % 7 == 0, 14.0).otherwise(10.0)
    lines = w.document_lines(table(spark, sf_dir, "documents")).select("doc_id", page.cast("int").alias("page"), "line_no", text.alias("text"), (n * 60.0).alias("y0"), (n * 60.0 + size).alias("y1"), size.alias("size"))
    pages = lines.select("doc_id", "page").distinct().withColumn("height", F.lit(600.0))
    body = lines.select("doc_id").distinct().withColumn("body", F.lit(10.0))
    return page_lines.margin_lines(lines.where("trim(text) <> ''"), pages, body).select("doc_id", "page", "line_no", "margin")


@query("page_blocks")
def page_blocks(spark, sf_dir):
    """The lines of every text on pages of 50, analysed again."""
    spans = _spans(spark, sf_dir)
    pages = spans.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(0.0)})
    return layout.analysed(spans, pages=pages)


def _small_pages(spark, sf_dir):
    """Texts in lines of eight words on pages of ten lines."""
    lines = F.regexp_extract_all(F.regexp_replace("text", "\\s+", " "), F.lit("[^ ]+(?: [^ ]+){0,7}"), F.lit(0))
    # an outer generator, so that no filter needs the words of a text beforehand and forms them twice
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(lines).alias("line_no", "text")).where("text is not null")
    y = F.col("line_no") % 10 * 12.0
    return docs.select(
        "doc_id", F.floor(F.col("line_no") / 10).cast("int").alias("page"), "line_no", F.lit(0).alias("span_no"), "text", F.lit(0.0).alias("x0"), y.alias("y0"),
        F.lit(300.0).alias("x1"), (y + 10).alias("y1"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"),
    )


@query("flowing_blocks")
def flowing_blocks(spark, sf_dir):
    """The blocks of small pages, paragraphs that go on from page to page as one."""
    return layout.flowing(layout.analysed(_small_pages(spark, sf_dir)))


@query("illustrated_blocks", "SELECT doc_id, page, CAST(page AS BIGINT) * 10 + 5 AS image_no FROM (SELECT doc_id, unnest(range(0, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 80.0) AS BIGINT))) AS page FROM documents WHERE text IS NOT NULL)")
def illustrated_blocks(spark, sf_dir):
    """Small pages with an image behind their fifth line each: every image has a block of its own, whether text goes on around it or not."""
    spans = _small_pages(spark, sf_dir)
    y = F.when(F.col("line_no") % 10 >= 5, 100.0).otherwise(0.0)
    moved = spans.withColumns({"y0": F.col("y0") + y, "y1": F.col("y1") + y})
    images = spans.groupBy("doc_id", "page").agg((F.first("page") * 10 + 5).alias("image_no"), *(F.lit(v).alias(n) for n, v in (("x0", 0.0), ("y0", 62.0), ("x1", 300.0), ("y1", 150.0))))
    shown = layout.analysed(moved, images=images).where("kind = 'image'")
    return shown.select("doc_id", F.col("page").cast("long").alias("page"), F.col("image_no").cast("long").alias("image_no"))


@query("cached_blocks")
def cached_blocks(spark, sf_dir):
    """The blocks of every text as a cache and back."""
    blocks = plain_text.as_blocks(plain_text.read_blocks(table(spark, sf_dir, "documents")))
    back = cache_source.read_blocks(block_cache.rendered(blocks))
    return back.select("doc_id", "block_no", "kind", "page", "ordered", "marker", "indent", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"))
