"""Queries over records of documents, with their oracle SQL; parts, orders and events stand for boxes, fields and notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import binary as b
from folioflow.functions import geometry as g
from folioflow.functions import reading
from folioflow.functions import text as t
from folioflow.functions.numbers import is_numeric_text
from folioflow.operators import glyphs
from folioflow.operators import hierarchies as h
from folioflow.operators import records as r
from folioflow.operators import scans, tiles
from folioflow.plans.registry import query
from folioflow.session import spread, table

BOXES = """x AS (SELECT p_partkey AS k, p_partkey % 97 AS page, CAST(p_partkey % 7 * 40 AS DOUBLE) AS l, CAST(p_size * 9 AS DOUBLE) AS t, CAST(p_partkey % 7 * 40 + p_size % 13 * 25 AS DOUBLE) AS r, CAST(p_size * 9 + p_partkey % 5 * 110 AS DOUBLE) AS b, p_size % 3 AS stream FROM part)"""


def boxes(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    left, top = k % 7 * 40, size * 9
    sides = zip("ltrb", (left, top, left + size % 13 * 25, top + k % 5 * 110))
    return table(spark, sf_dir, "part").select(k.alias("k"), (k % 97).alias("page"), *(c.cast("double").alias(n) for n, c in sides), (size % 3).alias("stream"))


# ---- files and names


@query("folder_children", "SELECT p_brand AS folder, count(*) FILTER (NOT starts_with(CASE WHEN p_partkey % 6 = 0 THEN '.' || p_name ELSE p_name END, '.')) AS children FROM part GROUP BY p_brand")
def folder_children(spark, sf_dir):
    """Visible entries of each folder; every sixth name is hidden."""
    name = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("."), "p_name")).otherwise(F.col("p_name"))
    return r.child_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), name.alias("name")), "folder", "name")


PATHS = "p AS (SELECT page_id, ['Android', 'sdcard', '.trash', 'a/b/c/d/e/f/g'][page_id % 4 + 1] || '/' || regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS path FROM pages WHERE url IS NOT NULL)"


@query("device_walk", rf"WITH {PATHS}, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p) SELECT page_id, path FROM s WHERE ends_with(lower(path), '.pdf') AND len(parts) <= 8 AND parts[1] <> 'Android' AND len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0")
def device_walk(spark, sf_dir):
    """S3: what a walk of the device finds below four folders."""
    under = F.element_at(F.array(*(F.lit(x) for x in ("Android", "sdcard", ".trash", "a/b/c/d/e/f/g"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(under, F.lit("/"), F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".txt"))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", path.alias("path")).where(r.on_device(F.col("path"), "pdf"))


@query("index_cleaned", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def index_cleaned(spark, sf_dir):
    """Entries of the import index whose target is still there."""
    there = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(there, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("starred_documents", "SELECT o_custkey, count(*) AS opened, bool_or(o_orderkey % 10 = 3) AS bookmarked FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING bool_or(o_orderpriority LIKE '1%')")
def starred_documents(spark, sf_dir):
    """Starred records, with whether page 3 has a bookmark."""
    marks = F.collect_list(F.struct((F.col("o_orderkey") % 10).alias("page")))
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("opened"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("starred"), marks.alias("bookmarks"))
    return held.where("starred").select("o_custkey", "opened", F.exists("bookmarks", lambda b: b["page"] == 3).alias("bookmarked"))


@query("bookmarks_by_page", "WITH m AS (SELECT user_id, event_id % 10 AS page, max(struct_pack(ts := ts, event_id := event_id)) AS l FROM events GROUP BY 1, 2) SELECT user_id, string_agg(page || ':' || l.event_id, ',' ORDER BY page) AS bookmarks FROM m GROUP BY user_id")
def bookmarks_by_page(spark, sf_dir):
    """The bookmark added last on each page, by page."""
    marks = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 10).alias("page"), "ts", "event_id")
    kept = r.latest_bookmarks(marks, ["user_id"], "page", ["ts", "event_id"])
    return kept.select("user_id", F.array_join(F.transform("bookmarks", lambda b: F.concat(b["page"].cast("string"), F.lit(":"), b["_last"]["event_id"].cast("string"))), ",").alias("bookmarks"))


@query("reading_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn < conv_id % 4, turn, text) AS INT) AS position FROM conversations")
def reading_order(spark, sf_dir):
    """Pages from the current one on, then from the first."""
    order = [*r.from_page(F.col("turn"), F.col("conv_id") % 4), F.col("text")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("position"))


@query("extraction_batches", "WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, CAST((n - 1) // 8 AS INT) AS batch, count(*) AS pages, CAST(max(n) AS DOUBLE) / max(total) AS progress FROM x GROUP BY 1, 2")
def extraction_batches(spark, sf_dir):
    """T5: batches of eight pages and how far each brings a document."""
    by = Window.partitionBy("conv_id")
    n = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(by.orderBy("turn", "text")).alias("n"), F.count("*").over(by).alias("total"))
    return n.groupBy("conv_id", F.floor((F.col("n") - 1) / 8).cast("int").alias("batch")).agg(F.count("*").alias("pages"), (F.max("n").cast("double") / F.max("total")).alias("progress"))


@query("revisions", "SELECT user_id, event_id, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events")
def revisions(spark, sf_dir):
    """A document's revision counter after each event; looking changes nothing."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count_if(F.col("event_type") != "view").over(upto).alias("revision"))


@query("export_ranges", "WITH x AS (SELECT o_orderkey, o_orderkey % 30 + 1 AS pages, o_custkey % 12 + 1 AS a, o_orderkey % 17 AS b FROM orders) SELECT o_orderkey, (pages + 6) // 7 AS every, CASE WHEN a <= b AND b <= pages THEN b - a + 1 + CASE WHEN 1 <= pages THEN 1 ELSE 0 END END AS custom FROM x")
def export_ranges(spark, sf_dir):
    """U8: ranges of seven pages, and custom ranges, of which a reversed one or one beyond the document is none."""
    pages, first, last = F.col("o_orderkey") % 30 + 1, F.col("o_custkey") % 12 + 1, F.col("o_orderkey") % 17
    told = F.concat(first.cast("string"), F.lit("-"), last.cast("string"), F.lit(", 1"))
    made = r.custom_ranges(told, pages)
    total = F.aggregate(made, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(r.split_every(pages, 7)).cast("long").alias("every"), F.when(made.isNotNull(), total).alias("custom"))


@query("page_subsets", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 9 ELSE len(list_filter([o_orderkey % 7, o_custkey % 20, CAST(-1 AS BIGINT)], lambda p: p >= 0 AND p < o_custkey % 9)) END AS pages FROM orders")
def page_subsets(spark, sf_dir):
    """P10: pages asked for that there are, or all."""
    count = F.col("o_custkey") % 9
    asked = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 20, F.lit(-1).cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(r.in_range(asked, count)).cast("long").alias("pages"))


@query("permission_flags", f"SELECT p_partkey, {', '.join(f'(p_size & {1 << n}) <> 0 AS {name}' for n, name in enumerate(r.PERMISSIONS))} FROM part")
def permission_flags(spark, sf_dir):
    """P16."""
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in r.permissions(F.col("p_size")).items()))


# ---- fields and annotations

FIELDS = "w AS (SELECT o_orderkey AS widget, o_custkey AS field, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 8 END AS own FROM orders), f AS (SELECT c_custkey AS field, c_mktsegment AS type, c_nationkey % 6 = 0 AS hidden FROM customer), g AS (SELECT DISTINCT o_orderkey AS widget, o_orderkey % 11 AS found FROM orders WHERE o_orderkey % 4 = 1), a AS (SELECT widget, field, type, hidden, coalesce(own, found, -1) AS page FROM w JOIN f USING (field) LEFT JOIN g USING (widget))"


def fields(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    widgets = orders.select(key.alias("widget"), F.col("o_custkey").alias("field"), F.when(key % 3 == 0, key % 8).alias("page"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field"), F.col("c_mktsegment").alias("type"), (F.col("c_nationkey") % 6 == 0).alias("hidden"))
    pages = orders.where(key % 4 == 1).select(key.alias("widget"), (key % 11).alias("page")).distinct()
    return r.pages_of(own, widgets, pages, "field", "widget")


@query("widget_pages", f"WITH {FIELDS} SELECT widget, field, CAST(page AS BIGINT) AS page FROM a")
def widget_pages(spark, sf_dir):
    """One row a widget, with its field and the page that it names or that lists it."""
    return fields(spark, sf_dir).select("widget", "field", F.col("page").cast("long").alias("page"))


@query("fillable_fields", f"WITH {FIELDS} SELECT widget, field FROM a WHERE page = 2 AND NOT hidden AND type <> 'MACHINERY'")
def fillable_fields(spark, sf_dir):
    """One segment stands for buttons."""
    made = fields(spark, sf_dir).withColumn("type", F.when(F.col("type") == "MACHINERY", "button").otherwise(F.col("type")))
    return r.fillable(made, F.lit(2)).select("widget", "field")


@query("fields_left", f"WITH {FIELDS} SELECT field FROM a GROUP BY field HAVING bool_or(page NOT IN (0, 1, 5, -1))")
def fields_left(spark, sf_dir):
    """Fields that keep a widget when pages go."""
    removed = spark.createDataFrame([(0,), (1,), (5,), (-1,)], "page long")
    return r.without_pages(fields(spark, sf_dir).withColumn("page", F.col("page").cast("long")), removed, "field")


NOTES = "n AS (SELECT event_id, user_id AS page, CASE event_type WHEN 'click' THEN 'Link' WHEN 'view' THEN 'Highlight' WHEN 'purchase' THEN 'Popup' ELSE 'Text' END AS type, value AS l, value + 2 AS r, value * 2 AS t, value * 2 + 3 AS b FROM events)"


def notes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Link").when(F.col("event_type") == "view", "Highlight").when(F.col("event_type") == "purchase", "Popup").otherwise("Text")
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page"), kind.alias("type"), v.alias("l"), (v + 2).alias("r"), (v * 2).alias("t"), (v * 2 + 3).alias("b"))


@query("listed_annotations", f"WITH {NOTES} SELECT event_id, page, type FROM n WHERE type NOT IN ('Widget', 'Popup') AND l IS NOT NULL AND page = 7")
def listed_annotations(spark, sf_dir):
    """S9."""
    return r.listed_annotations(notes(spark, sf_dir), F.lit(7)).select("event_id", "page", "type")


@query("annotation_hits", f"WITH {NOTES} SELECT page, max(event_id) AS event_id FROM n WHERE type <> 'Link' AND 8 >= l - 6 AND 8 < r + 6 AND 14 >= t - 6 AND 14 < b + 6 GROUP BY page")
def annotation_hits(spark, sf_dir):
    """The topmost annotation under a point of each page."""
    return r.hit(notes(spark, sf_dir), ["page"], "event_id", F.lit(8.0), F.lit(14.0))


@query("annotation_ids", f"WITH {NOTES}, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY event_id) - 1 AS i FROM n) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'nm' || event_id ELSE 'p' || page || '#' || i END AS id FROM i")
def annotation_ids(spark, sf_dir):
    """Own names, else synthetic ids by page and place."""
    place = F.row_number().over(Window.partitionBy("page").orderBy("event_id")) - 1
    held = notes(spark, sf_dir).withColumn("i", place).withColumn("id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("nm"), F.col("event_id").cast("string"))))
    return r.with_ids(held, "page", "i").select("event_id", "id")


@query("annotations_added", "WITH n AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, 'note' AS type FROM events WHERE event_type = 'view'), l AS (SELECT page, max(i) + 1 AS f FROM n GROUP BY page), a AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j FROM events WHERE event_type = 'click') SELECT page, CAST(i AS INT) AS index, type FROM n UNION ALL SELECT page, CAST(coalesce(f, 0) + j AS INT), 'highlight' FROM a LEFT JOIN l USING (page)")
def annotations_added(spark, sf_dir):
    """Highlights behind the notes of each page."""
    held = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "event_id", "event_type")
    place = F.row_number().over(Window.partitionBy("page").orderBy("event_id")) - 1
    own = held.where("event_type = 'view'").select("page", place.alias("index"), F.lit("note").alias("type"))
    return r.added(own, held.where("event_type = 'click'").select("page", "event_id", F.lit("highlight").alias("type")), ["page"], "event_id")


@query("flattened_records", "SELECT o_orderkey, o_orderstatus = 'F' AS drawn FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 4 <> 0")
def flattened_records(spark, sf_dir):
    """Finished orders are drawn, hidden ones of them go, others stay."""
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 4 == 0).alias("hidden"))
    return r.flattened(held, F.col("o_orderstatus") == "F").select("o_orderkey", "drawn")


# ---- images, vectors and content


@query("image_objects", f"WITH {BOXES}, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS id FROM x) SELECT page, k, CAST(id AS INT) AS id FROM i WHERE r - l > 4 AND b - t > 4")
def image_objects(spark, sf_dir):
    """Ids count images that are too small, too."""
    return r.objects(boxes(spark, sf_dir), ["page"], ["k"]).select("page", "k", "id")


@query("vector_objects", f"WITH {BOXES}, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS id FROM x) SELECT page, k, CAST(id AS INT) AS id FROM i WHERE stream <> 1 AND (r - l >= 3 OR b - t >= 3) AND NOT (r - l > 200 * 0.95 AND b - t > 300 * 0.95)")
def vector_objects(spark, sf_dir):
    """One stream in three only clips."""
    paths = boxes(spark, sf_dir).withColumn("clip_only", F.col("stream") == 1)
    return r.vectors(paths, ["page"], ["k"], F.lit(200.0), F.lit(300.0)).select("page", "k", "id")


@query(
    "shown_images",
    f"""WITH {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY page, stream, l, t, r, b ORDER BY k) AS once FROM x WHERE r - l >= 24 AND b - t >= 24), p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS place FROM s WHERE once = 1)
SELECT page, k FROM p WHERE place <= 12 AND k % 10 <> 0 AND NOT (greatest(0, least(r, 300) - greatest(l, 0)) * greatest(0, least(b, 500) - greatest(t, 0)) / 150000 > 0.9 AND k % 2 = 0)""",
)
def shown_images(spark, sf_dir):
    """P5, U9, O7."""
    images = boxes(spark, sf_dir).withColumns({"bytes": F.col("k") % 10, "has_text": F.col("k") % 2 == 0})
    return r.shown_images(images, ["page"], ["k"], F.lit(300.0), F.lit(500.0)).select("page", "k")


@query(
    "captioned_images",
    """WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'image' WHEN turn % 7 = 5 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN turn % 2 = 0 THEN 'Table 1 ' ELSE 'Figure 2 ' END || text AS text, turn * 30.0 AS y0, turn * 30.0 + (turn * 7 + conv_id) % 40 AS y1 FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, text)),
c AS (SELECT *, kind = 'paragraph' AND length(text) <= 400 AND regexp_matches(text, '(?i)^ *((figure|table)([^a-z]|$)|fig[.])') AS cap FROM b),
d AS (SELECT *, lead(cap) OVER w AS nc, lag(cap) OVER w AS pc, lead(y0) OVER w - y1 AS ng, y0 - lag(y1) OVER w AS pg, lead(text) OVER w AS nt, lag(text) OVER w AS pt, lead(kind, 2) OVER w = 'table' AND starts_with(lower(lead(text) OVER w), 'table') AS tt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, kind = 'image' AND coalesce(nc AND ng >= -2 AND ng <= 36, false) AND NOT coalesce(tt, false) AS ahead FROM d),
f AS (SELECT *, coalesce(lag(ahead, 2) OVER (PARTITION BY conv_id ORDER BY turn), false) AS gone FROM e)
SELECT conv_id, turn, CASE WHEN ahead THEN nt WHEN coalesce(pc AND pg >= -2 AND pg <= 36, false) AND NOT gone THEN pt END AS caption FROM f WHERE kind = 'image'""",
)
def captioned_images(spark, sf_dir):
    """Turns as blocks of pages, every third an image."""
    once = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text"))
    turn = F.col("turn")
    kind = F.when(turn % 3 == 1, "image").when(turn % 7 == 5, "table").otherwise("paragraph")
    text = F.concat(F.when(turn % 2 == 0, "Table 1 ").otherwise("Figure 2 "), "text")
    blocks = table(spark, sf_dir, "conversations").withColumn("n", once).where("n = 1").select("conv_id", "turn", kind.alias("kind"), text.alias("text"), (turn * 30.0).alias("y0"), (turn * 30.0 + (turn * 7 + F.col("conv_id")) % 40).alias("y1"))
    caption = (F.col("kind") == "paragraph") & (F.length("text") <= 400) & F.col("text").rlike(t.CAPTION)
    return r.captioned(blocks, ["conv_id"], "turn", caption, F.lit(12.0))


@query("edited_images", f"WITH {BOXES} SELECT k, CASE WHEN s_suppkey % 3 = 1 THEN l + 5 ELSE l END AS l, CASE WHEN s_suppkey % 3 = 2 THEN 9 ELSE stream END AS stream FROM x LEFT JOIN supplier ON k = s_suppkey * 2 WHERE coalesce(s_suppkey % 3 <> 0, true)")
def edited_images(spark, sf_dir):
    """Images deleted, moved and replaced."""
    held = boxes(spark, sf_dir)
    s = F.col("s_suppkey")
    action = F.when(s % 3 == 0, "delete").when(s % 3 == 1, "move").otherwise("replace")
    edits = table(spark, sf_dir, "supplier").select((s * 2).alias("k"), action.alias("action"))
    edits = edits.join(held.select("k", "l", "t", "r", "b"), "k").select("k", "action", (F.col("l") + 5).alias("l"), "t", "r", "b", F.lit(9).alias("stream"))
    return r.edited_images(held, edits, ["k"]).select("k", "l", "stream")


@query("rewritten_operators", "WITH o AS (SELECT user_id AS unit, event_id AS ordinal, event_type AS body FROM events), p AS (SELECT *, CASE WHEN ordinal % 5 = 0 THEN [] WHEN ordinal % 5 = 1 THEN ['new'] ELSE [body] END AS kept, CASE WHEN ordinal % 10 IN (1, 5) THEN ['q'] ELSE [] END AS before, CASE WHEN ordinal % 10 = 5 THEN ['Q', 'EMC'] ELSE [] END AS after FROM o), c AS (SELECT unit, ordinal, list_concat(list_concat(before, kept), after) AS parts FROM p) SELECT unit, ordinal, CAST(i - 1 AS INT) AS part, parts[i] AS body FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)")
def rewritten_operators(spark, sf_dir):
    """A plan over the events of each user as content operators."""
    n = F.col("ordinal")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("body"))
    plan = ops.where((n % 5).isin(0, 1)).select(
        "unit", "ordinal", F.when(n % 5 == 0, "drop").otherwise("put").alias("action"), F.lit("new").alias("body"),
        F.when((n % 10).isin(1, 5), F.array(F.lit("q"))).alias("before"), F.when(n % 10 == 5, F.array(F.lit("Q"), F.lit("EMC"))).alias("after"),
    )
    return r.rewritten(ops, plan, "unit", "ordinal", "body")


@query("content_added", f"WITH {BOXES}, o AS (SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY k) AS z FROM x WHERE stream <> 2), l AS (SELECT page, max(z) AS top FROM o GROUP BY page) SELECT page, k, CAST(z AS INT) AS z FROM o UNION ALL SELECT page, k, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY page ORDER BY k) AS INT) FROM x LEFT JOIN l USING (page) WHERE stream = 2")
def content_added(spark, sf_dir):
    """Content of one stream taken off its pages and added on top."""
    held = boxes(spark, sf_dir)
    own = held.where("stream <> 2").select("page", "k", F.row_number().over(Window.partitionBy("page").orderBy("k")).alias("z"))
    return r.appended(own, held.where("stream = 2").select("page", "k"), ["page"], "k", "z")


@query("struck_glyphs", "WITH g AS (SELECT p_partkey AS k, p_partkey % 31 AS page, p_size * 6.0 AS l, p_size * 6.0 + 5 AS r, CAST(p_partkey % 50 * 14 AS DOUBLE) AS baseline, 10.0 AS size FROM part), s AS (SELECT s_suppkey % 31 AS page, s_suppkey % 40 * 7.0 AS l, s_suppkey % 40 * 7.0 + 60 AS r, s_suppkey % 50 * 14.0 - s_suppkey % 3 * 4.0 AS t, s_suppkey % 50 * 14.0 - s_suppkey % 3 * 4.0 + s_suppkey % 2 * 1.0 + 0.5 AS b FROM supplier) SELECT g.page, k, bool_or((s.t + s.b) / 2 BETWEEN baseline - size * 0.05 AND baseline + size * 0.22) AS underline, bool_or((s.t + s.b) / 2 < baseline - size * 0.15 AND (s.t + s.b) / 2 > baseline - size * 0.6) AS strike FROM g JOIN s ON g.page = s.page AND (g.l + g.r) / 2 BETWEEN s.l AND s.r AND s.b - s.t <= 1.5 AND ((s.t + s.b) / 2 BETWEEN baseline - size * 0.05 AND baseline + size * 0.22 OR ((s.t + s.b) / 2 < baseline - size * 0.15 AND (s.t + s.b) / 2 > baseline - size * 0.6)) GROUP BY g.page, k")
def struck_glyphs(spark, sf_dir):
    """Strokes under and through glyphs."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    left = F.col("p_size") * 6.0
    glyphs = table(spark, sf_dir, "part").select(k.alias("k"), (k % 31).alias("page"), left.alias("l"), (left + 5).alias("r"), (k % 50 * 14).cast("double").alias("baseline"), F.lit(10.0).alias("size"))
    x, top = s % 40 * 7.0, s % 50 * 14.0 - s % 3 * 4.0
    strokes = table(spark, sf_dir, "supplier").select((s % 31).alias("page"), x.alias("l"), (x + 60).alias("r"), top.alias("t"), (top + s % 2 * 1.0 + 0.5).alias("b"))
    return r.struck(glyphs, strokes, ["page"], "k")


# ---- texts


@query("highlight_ranges", "SELECT conv_id, turn, i - 1 AS hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1) AS BIGINT) AS start FROM (SELECT conv_id, turn, string_split(lower(text), 'the') AS parts, unnest(range(1, len(string_split(lower(text), 'the')))) AS i FROM conversations)")
def highlight_ranges(spark, sf_dir):
    """Where the hits of a query stand."""
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(reading.whole_hits(F.col("text"), "the")).alias("hit", "at"))
    return hits.select("conv_id", "turn", F.col("hit").cast("long").alias("hit"), F.col("at.start").cast("long").alias("start"))


@query(
    "reading_chunks",
    r"""WITH s AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM (SELECT conv_id, turn, text || ' ' || text || ' ' || text AS text FROM conversations)),
f AS (SELECT conv_id, turn, text, list_reduce(list_prepend([''], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN length(a[len(a)]) + length(x[1]) > 400 AND a[len(a)] <> '' THEN list_append(a, x[1] || ' ') ELSE list_append(a[1:len(a) - 1], a[len(a)] || x[1] || ' ') END) AS c FROM s WHERE len(l) > 0)
SELECT conv_id, turn, CAST(i - 1 AS INT) AS n, c[i] AS chunk FROM (SELECT conv_id, turn, text, c, unnest(range(1, len(c) + 1)) AS i FROM f)""",
)
def reading_chunks(spark, sf_dir):
    """each turn said three times, packed for reading."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", "text", "text").alias("text"))
    return said.select("conv_id", "turn", F.posexplode(reading.packed_sentences(F.col("text"))).alias("n", "chunk"))


@query("encodable_text", r"SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text || chr(9) || chr(7) || '€ café', chr(9), '    '), '[\x00-\x09\x0B-\x1F]', '', 'g'), '[^\x{20}-\x{7E}\x{A0}-\x{FF}\n]', '?', 'g') AS text FROM conversations")
def encodable_text(spark, sf_dir):
    """turns with a tab, a control and a sign that a Latin font lacks."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reading.encodable(F.concat("text", F.lit("\t\x07€ café"))).alias("text"))


@query(
    "wrapped_lines",
    """WITH w AS (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS l FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, list_reduce(list_prepend([''], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN a[len(a)] = '' AND length(x[1]) > 6 THEN list_concat(a[1:len(a) - 1], list_transform(range(0, (length(x[1]) + 5) // 6), lambda i: substr(x[1], CAST(i * 6 + 1 AS BIGINT), 6)))
WHEN a[len(a)] = '' THEN list_append(a[1:len(a) - 1], x[1]) WHEN length(a[len(a)]) + 1 + length(x[1]) <= 6 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS c FROM w)
SELECT conv_id, turn, CAST(i - 1 AS INT) AS n, c[i] AS line FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM f)""",
)
def wrapped_lines(spark, sf_dir):
    """turns wrapped at six signs; a longer word is cut where it begins the text."""
    said = table(spark, sf_dir, "conversations").where("text is not null")
    return said.select("conv_id", "turn", F.posexplode(reading.wrapped(F.replace("text", F.lit("\n"), F.lit(" ")), 6)).alias("n", "line"))


LINEAR = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query("contrasts", f"WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS rgb FROM part), d AS (SELECT p_partkey, rgb // 65536 AS r, rgb // 256 % 256 AS g, rgb % 256 AS b FROM c) SELECT p_partkey, CAST(round(0.2126 * {LINEAR.format('r')} + 0.7152 * {LINEAR.format('g')} + 0.0722 * {LINEAR.format('b')}, 6) AS DOUBLE) AS luminance FROM d")
def contrasts(spark, sf_dir):
    """relative luminance of colours; tests cover the move towards contrast."""
    rgb = (F.col("p_partkey") * 7919) % 16777216
    return table(spark, sf_dir, "part").select("p_partkey", F.round(reading.luminance(rgb), 6).alias("luminance"))


@query("numeric_headers", r"WITH c AS (SELECT o_custkey, unnest([CAST(o_orderkey AS VARCHAR), '1,234.5', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-7' END]) AS cell FROM orders) SELECT o_custkey, count(*) FILTER (cell <> '') * 2 >= count(*) AND count(*) FILTER (regexp_matches(cell, '^-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$')) = 0 AS header, count(*) FILTER (regexp_matches(cell, '^-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$')) AS numbers FROM c GROUP BY o_custkey")
def numeric_headers(spark, sf_dir):
    """A row is a header if half of it is filled and no cell is a number."""
    cells = F.array(F.col("o_orderkey").cast("string"), F.lit("1,234.5"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("-7"))
    held = table(spark, sf_dir, "orders").select("o_custkey", F.explode(cells).alias("cell"))
    numbers = F.count_if(is_numeric_text(F.col("cell")))
    return held.groupBy("o_custkey").agg(((F.count_if(F.col("cell") != "") * 2 >= F.count("*")) & (numbers == 0)).alias("header"), numbers.alias("numbers"))


@query("font_classes", "WITH f AS (SELECT p_partkey, ['Times New ', 'Courier ', 'Arial ', 'Open Sans Serif ', 'Consolas', 'Georgia-'][p_partkey % 6 + 1] || p_name AS font FROM part) SELECT p_partkey, CASE WHEN regexp_matches(lower(font), 'courier|mono|consol|typewriter') THEN 'mono' WHEN regexp_matches(lower(font), 'times|serif|roman|georgia|garamond|palatino|cambria|book') AND NOT regexp_matches(lower(font), 'sans') THEN 'serif' ELSE 'sans' END AS family FROM f")
def font_classes(spark, sf_dir):
    """F24."""
    font = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Times New ", "Courier ", "Arial ", "Open Sans Serif ", "Consolas", "Georgia-"))), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", t.font_class(font).alias("family"))


@query("spoken_sentences")
def spoken_sentences(spark, sf_dir):
    """F8: every turn's sentences with their places, at most 280 signs each; held by a test against a loop."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(reading.spoken_pieces(F.col("text"))).alias("n", "piece"))
    return said.select("conv_id", "turn", "n", "piece.start", "piece.end", "piece.text")


# ---- small filters, counts and forms


@query("upright_text", "SELECT p_partkey % 97 AS page, p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_size, p_retailprice, p_partkey) - 1 AS INT) AS place FROM part WHERE p_partkey % 8 <> 0 AND abs(p_partkey % 11 - 5) < 3")
def upright_text(spark, sf_dir):
    """P6, O4."""
    k = F.col("p_partkey")
    ops = table(spark, sf_dir, "part").select((k % 97).alias("page"), k.alias("id"), F.col("p_size").alias("baseline"), F.col("p_retailprice").alias("l"), (k % 8 == 0).alias("invisible"), (k % 11 - 5).alias("angle"))
    return r.upright(ops, ["page"]).select("page", F.col("id").alias("p_partkey"), "place")


@query("layer_words", "SELECT conv_id, count(*) FILTER (trim(CASE WHEN turn % 4 = 0 THEN ' ' ELSE text END) <> '' AND turn % 3 > 0) AS words FROM conversations GROUP BY conv_id")
def layer_words(spark, sf_dir):
    """K13, D18, A24."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 4 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"), F.lit(0).alias("l"), (F.col("turn") % 3).alias("r"))
    return r.layer_words(words, ["conv_id"])


@query("line_leadings", "WITH x AS (SELECT o_custkey, o_orderkey AS id, CAST(o_orderkey % 700 AS DOUBLE) AS baseline, CAST(o_orderkey % 9 + 8 AS DOUBLE) AS size, CAST(o_orderkey % 50 AS DOUBLE) AS width, CAST(o_orderkey % 45 AS DOUBLE) AS w FROM orders), g AS (SELECT o_custkey, count(*) AS n, min(baseline) AS lo, max(baseline) AS hi, arg_min(size, struct_pack(b := baseline, i := id)) AS size, sum(width) FILTER (w > 0) AS old, sum(w) FILTER (w > 0) AS new FROM x GROUP BY 1) SELECT o_custkey, CAST(CASE WHEN n < 2 THEN size * 1.2 ELSE (hi - lo) / (n - 1) END AS DOUBLE) AS leading, CAST(CASE WHEN old > 0 AND new > 0 THEN greatest(0.8::DOUBLE, least(1.1::DOUBLE, old / new)) ELSE 1 END AS DOUBLE) AS ratio FROM g")
def line_leadings(spark, sf_dir):
    """F53."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select("o_custkey", k.alias("id"), *(c.cast("double").alias(n) for n, c in (("baseline", k % 700), ("size", k % 9 + 8), ("width", k % 50), ("new_width", k % 45))))
    return r.leadings(lines, ["o_custkey"])


@query("decoded_spans", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS text, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE 10.0::DOUBLE END AS size, p_partkey % 5 = 0 AS bold, 4278190080 AS color FROM part")
def decoded_spans(spark, sf_dir):
    """spans whose JSON leaves fields out by turns."""
    k = F.col("p_partkey")
    fields = F.struct(F.when(k % 2 == 0, F.col("p_name")).alias("text"), F.when(k % 3 == 0, F.col("p_size")).alias("size"), F.when(k % 5 == 0, F.lit(True)).alias("bold"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(r.decoded_spans(F.to_json(F.array(fields)))))


@query("same_blocks", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0)), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 1)) SELECT a.conv_id, a.turn AS left, b.turn AS right FROM a JOIN b USING (conv_id, n)".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def same_blocks(spark, sf_dir):
    """Two analyses of each conversation, one of even turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return r.same_blocks(turns.where("turn % 2 = 0"), turns.where("turn % 3 <> 1"), ["conv_id"], "turn")


@query("largest_parts", "SELECT page, k, CAST(n AS INT) AS rank FROM (SELECT p_partkey % 97 AS page, p_partkey AS k, row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n <= 3")
def largest_parts(spark, sf_dir):
    """The three largest of each page."""
    k = F.col("p_partkey")
    return r.largest(table(spark, sf_dir, "part").select((k % 97).alias("page"), k.alias("k"), "p_size"), ["page"], "p_size", "k", 3).select("page", "k", "rank")


@query("touched_units", "WITH RECURSIVE u AS (SELECT p_partkey AS unit FROM part WHERE p_partkey % 37 = 0 UNION SELECT unit // 3 FROM u WHERE unit // 3 > 0) SELECT unit FROM u")
def touched_units(spark, sf_dir):
    """A unit stands in the one of a third of its number."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"))
    parents = keys.withColumn("parent", F.floor(F.col("unit") / 3)).where("parent > 0")
    return h.with_ancestors(keys.where("unit % 37 = 0"), parents, "unit", "parent")


@query("stretched_planes", "WITH x AS (SELECT vec_id, [CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT) FOR v IN embedding] AS p FROM embeddings), y AS (SELECT vec_id, p, list_min(p) AS lo, list_max(p) AS hi FROM x) SELECT vec_id, CAST(list_sum([CASE WHEN hi - lo >= 16 THEN CAST(floor(greatest(0.0, least(255.0, (v - lo) * (255.0::DOUBLE / (hi - lo)))) + 0.5) AS INT) ELSE v END FOR v IN p]) AS BIGINT) AS total FROM y")
def stretched_planes(spark, sf_dir):
    """planes through the lookup table that stretches them."""
    plane = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128))).cast("int"))
    held = table(spark, sf_dir, "embeddings").select("vec_id", plane.alias("p"))
    shown = r.looked_up(F.col("p"), r.stretched(F.array_min("p"), F.array_max("p")))
    return held.select("vec_id", F.aggregate(shown, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("span_edits", "WITH x AS (SELECT p_partkey, [p_name, p_brand, p_type] AS parts, p_name || p_brand || p_type AS whole, p_partkey % 25 AS n FROM part) SELECT p_partkey, substr(whole, n + 1) AS rest, right(whole, 9) AS tail FROM x")
def span_edits(spark, sf_dir):
    """spans without their first signs, and their last ones."""
    parts = F.array("p_name", "p_brand", "p_type")
    rest = r.without_first(parts, (F.col("p_partkey") % 25).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rest, "").alias("rest"), r.tail_text(parts, 9).alias("tail"))


@query("quads", "WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 23 AS DOUBLE) AS d FROM part), c AS (SELECT *, [0.0, s, d, 0.0]::DOUBLE[] AS xs, [0.0, 0.0, d, s]::DOUBLE[] AS ys FROM q), t AS (SELECT *, [(xs[i % 4 + 1] - xs[i]) * (ys[(i + 1) % 4 + 1] - ys[i % 4 + 1]) - (ys[i % 4 + 1] - ys[i]) * (xs[(i + 1) % 4 + 1] - xs[i % 4 + 1]) FOR i IN [1, 2, 3, 4]] AS z FROM c) SELECT p_partkey, CAST(abs(list_sum([xs[i] * ys[i % 4 + 1] - xs[i % 4 + 1] * ys[i] FOR i IN [1, 2, 3, 4]])) / 2 AS DOUBLE) AS area, round(list_sum([sqrt(pow(xs[i % 4 + 1] - xs[i], 2) + pow(ys[i % 4 + 1] - ys[i], 2)) FOR i IN [1, 2, 3, 4]]), 6) AS around, list_min(z) > 0 OR list_max(z) < 0 AS convex FROM t")
def quads(spark, sf_dir):
    """area, length around and convexity of four corners."""
    s, d, o = F.col("p_size").cast("double"), (F.col("p_partkey") % 23).cast("double"), F.lit(0.0)
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((o, o), (s, o), (d, d), (o, s))))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select("p_partkey", g.shoelace(corners).alias("area"), F.round(g.perimeter(corners), 6).alias("around"), g.is_convex(corners).alias("convex"))


@query(
    "image_kinds",
    """WITH x AS (SELECT p_partkey, left(['89504E470D0A1A0A00', 'FFD8FFE000', '474946383961', '52494646000000005745425056', '00112233', '49492A0008'][p_partkey % 6 + 1] || hex(encode(p_name)), 2 * (p_size % 20)) AS b FROM part),
h AS (SELECT *, left(b, 24) AS h FROM x)
SELECT p_partkey, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '47494638') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' WHEN starts_with(h, '49492A00') THEN 'tiff' WHEN starts_with(h, '4D4D002A') THEN 'tiff' WHEN starts_with(h, '52494646') AND length(h) = 24 AND ends_with(h, '57454250') THEN 'webp' ELSE 'unknown' END AS kind FROM h""",
)
def image_kinds(spark, sf_dir):
    """kinds by first bytes: six heads before parts' names, cut off after as many bytes as the size says."""
    heads = ("89504E470D0A1A0A00", "FFD8FFE000", "474946383961", "52494646000000005745425056", "00112233", "49492A0008")
    head = F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("p_partkey") % 6 + 1).cast("int"))
    data = F.substring(F.concat(F.unhex(head), F.encode("p_name", "UTF-8")), F.lit(1), (F.col("p_size") % 20).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", b.image_kind(data).alias("kind"))


@query("stored_signatures", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events WHERE event_type = 'purchase'")
def stored_signatures(spark, sf_dir):
    """Each user's signatures, newest first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", place.alias("place"))


# ---- planes of scans: each vector as eight by eight pixels

PLANES = """x AS (SELECT vec_id, unnest(range(0, 64)) AS i, [CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT) FOR v IN embedding] AS p FROM embeddings WHERE len(embedding) = 64),
w AS (SELECT vec_id, i, p[i + 1] AS v, [p[CAST(greatest(0, least(7, i // 8 + d // 3 - 1)) * 8 + greatest(0, least(7, i % 8 + d % 3 - 1)) + 1 AS BIGINT)] FOR d IN range(0, 9)] AS n FROM x)"""


def planes(spark, sf_dir):
    plane = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128))).cast("int"))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), plane.alias("pixels"))


def _pixels(df, name):
    return df.select("vec_id", F.posexplode("pixels").alias("i", name)).withColumn("i", F.col("i").cast("long"))


@query("local_spread", f"WITH {PLANES} SELECT vec_id, i, round(list_avg(n), 3) AS mean, round(list_avg([a * a FOR a IN n]) - list_avg(n) * list_avg(n), 1) AS variance FROM w")
def local_spread(spark, sf_dir):
    """Mean and variance over nine pixels, the edge repeated."""
    held = planes(spark, sf_dir)
    mean, spread = (_pixels(scans.filtered(held, kernel, 1, key="vec_id"), name) for kernel, name in (("local_mean", "mean"), ("local_variance", "variance")))
    return mean.join(spread, ["vec_id", "i"]).select("vec_id", "i", F.round("mean", 3).alias("mean"), F.round("variance", 1).alias("variance"))


@query(
    "tiled_spread",
    """WITH x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL),
p AS (SELECT label, y, i AS x, CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 128))) AS INT) AS v FROM x, range(64) AS t(i)), h AS (SELECT label, max(y) AS top FROM p GROUP BY label),
n AS (SELECT p.label, p.y, p.x, greatest(0, least(top, p.y + dy)) AS ny, greatest(0, least(63, p.x + dx)) AS nx FROM p JOIN h USING (label), range(-2, 3) AS a(dy), range(-2, 3) AS b(dx))
SELECT n.label, CAST(n.y AS INT) AS y, CAST(n.x AS INT) AS x, round(sum(q.v) / 25.0, 3) AS mean, round(sum(q.v * q.v) / 25.0 - (sum(q.v) / 25.0) * (sum(q.v) / 25.0), 1) AS variance FROM n JOIN p q ON q.label = n.label AND q.y = n.ny AND q.x = n.nx GROUP BY n.label, n.y, n.x""",
)
def tiled_spread(spark, sf_dir):
    """Mean and variance over 25 pixels of planes that grow with the table: a label's vectors are the rows of one, held in tiles of 16 by 16."""
    vectors = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & F.col("label").isNotNull())
    rows = vectors.withColumn("y", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 128)))
    pixels = rows.select("label", "y", F.posexplode("embedding").alias("x", "e")).withColumn("v", value)
    parts = tiles.tiled(pixels, "label", "y", "x", "v", side=16)
    mean, spread = (tiles.pixels_of(tiles.tile_filtered(parts, 16, kernel, 2, key="label"), 16, "label", name) for kernel, name in (("local_mean", "mean"), ("local_variance", "variance")))
    return mean.join(spread, ["label", "y", "x"]).select("label", "y", "x", F.round("mean", 3).alias("mean"), F.round("variance", 1).alias("variance"))


@query("inked_pixels", f"WITH {PLANES}, m AS (SELECT vec_id, i, v, list_avg(n) AS m, sqrt(greatest(0, list_avg([a * a FOR a IN n]) - list_avg(n) * list_avg(n))) AS s FROM w), k AS (SELECT vec_id, i, v < m * (1 + 0.25 * (s / 128 - 1)) AS ink FROM m), g AS (SELECT a.vec_id, a.i, a.ink, count(*) FILTER (b.ink) AS others FROM k a JOIN k b ON a.vec_id = b.vec_id AND abs(a.i % 8 - b.i % 8) <= 1 AND abs(a.i // 8 - b.i // 8) <= 1 AND a.i <> b.i GROUP BY 1, 2, 3) SELECT vec_id, count(*) AS pixels FROM g WHERE ink AND (others > 0 OR i % 8 IN (0, 7) OR i // 8 IN (0, 7)) GROUP BY vec_id")
def inked_pixels(spark, sf_dir):
    """Black pixels of planes in black and white, without specks."""
    black = _pixels(scans.filtered(planes(spark, sf_dir), "black_white", 1, key="vec_id"), "v").where("v = 0")
    return black.groupBy("vec_id").agg(F.count("*").alias("pixels"))


@query("turned_planes", f"WITH x AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64) SELECT vec_id, i, CAST(greatest(0, least(255, floor((CAST(e[CAST((7 - i % 8) * 8 + i // 8 + 1 AS BIGINT)] AS DOUBLE) + 1) * 128))) AS DOUBLE) AS v FROM x, (SELECT unnest(range(0, 64)) AS i)")
def turned_planes(spark, sf_dir):
    """planes turned clockwise by a quarter."""
    return _pixels(scans.filtered(planes(spark, sf_dir), "turned", 1, key="vec_id"), "v")


# ---- what is searched or edited on a page: each turn in lines of 40 signs, five points wide and ten high


@query(
    "marked_rects",
    """WITH h AS (SELECT conv_id, turn, i - 1 AS hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1) AS BIGINT) AS start
FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts))) AS i FROM (SELECT conv_id, turn, string_split(lower(text), 'the') AS parts FROM conversations))),
c AS (SELECT conv_id, turn, hit, (start + k) // 40 AS line, (start + k) % 40 AS col FROM h, (SELECT unnest(range(0, 3)) AS k))
SELECT conv_id, turn, hit, CAST(min(col) * 5 - 1 AS DOUBLE) AS l, CAST(line * 12 - 1 AS DOUBLE) AS t, CAST(max(col) * 5 + 6 AS DOUBLE) AS r, CAST(line * 12 + 11 AS DOUBLE) AS b FROM c GROUP BY conv_id, turn, hit, line""",
)
def marked_rects(spark, sf_dir):
    """Rectangles to redact around the hits of a query, one a line."""
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(reading.whole_hits(F.col("text"), "the")).alias("hit", "at"))
    at = F.sequence(F.col("at.start"), F.col("at.end") - 1)
    place = lambda p: F.struct((p % 40 * 5.0).alias("l"), (F.floor(p / 40) * 12.0).alias("t"), (p % 40 * 5.0 + 5).alias("r"), (F.floor(p / 40) * 12.0 + 10).alias("b"))
    boxes = hits.select("conv_id", "turn", F.col("hit").cast("long").alias("hit"), F.explode(g.line_rects(F.transform(at, place))).alias("box"))
    return boxes.select("conv_id", "turn", "hit", "box.*")


@query(
    "paragraph_texts",
    r"""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, rtrim(text, ' ') AS x, length(text) * 5.0::DOUBLE AS r FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN n > 1 THEN ltrim(x, ' ') ELSE x END AS own, lead(x) OVER (PARTITION BY conv_id ORDER BY n) AS rest, r < max(r) OVER (PARTITION BY conv_id) - 40 AS short FROM s)
SELECT conv_id, string_agg(CASE WHEN rest IS NULL THEN own WHEN short THEN own || chr(10) WHEN x LIKE '%-' AND regexp_matches(rest, '^\p{Ll}') THEN own[:-2] ELSE own || ' ' END, '' ORDER BY n) AS text FROM p GROUP BY conv_id""",
)
def paragraph_texts(spark, sf_dir):
    """turns as the lines of a block, joined for editing."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    lines = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", n.alias("n"), "text", (F.length("text") * 5.0).alias("r"), F.lit(10.0).alias("size"))
    return glyphs.paragraph_texts(lines, ["conv_id"], ["n"])


# ---- colour images: 21 pixels of each vector, seven by three

COLOURS = """x AS (SELECT vec_id, unnest(range(0, 21)) AS i, [CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT) FOR v IN embedding] AS p FROM embeddings WHERE len(embedding) >= 63),
c AS (SELECT vec_id, i, p[3 * i + 1] AS r, p[3 * i + 2] AS g, p[3 * i + 3] AS b FROM x)"""


def colour_images(spark, sf_dir):
    plane = F.slice(F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128))).cast("int")), 1, 63)
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 63).select("vec_id", F.lit(7).alias("width"), F.lit(3).alias("height"), plane.alias("pixels"))


@query(
    "gray_scans",
    f"""WITH {COLOURS}, l AS (SELECT vec_id, i, (r * 77 + g * 150 + b * 29 + 128) // 256 AS v FROM c),
o AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS n FROM l),
e AS (SELECT vec_id, min(v) FILTER (n >= 0.01 * 21) AS lo, min(v) FILTER (n >= 0.99 * 21) AS hi FROM o GROUP BY vec_id)
SELECT vec_id, CAST(i AS BIGINT) AS i, CASE WHEN hi - lo >= 16 THEN CAST(floor(greatest(0.0, least(255.0, (v - lo) * (255.0::DOUBLE / (hi - lo)))) + 0.5) AS INT) ELSE CAST(v AS INT) END AS v FROM l JOIN e USING (vec_id)""",
)
def gray_scans(spark, sf_dir):
    """colour images in stretched greys."""
    shown = scans.colour_filtered(colour_images(spark, sf_dir), "grayscale", key="vec_id")
    return _pixels(shown, "v").where("i % 3 = 0").select("vec_id", (F.col("i") / 3).cast("long").alias("i"), "v")


@query(
    "brighter_scans",
    f"""WITH {COLOURS}, s AS (SELECT vec_id, 3 * i + k AS i, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM c, (SELECT unnest([0, 1, 2]) AS k))
SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(floor(greatest(0.0, least(255.0, (v - 127.5::DOUBLE) * 1.5::DOUBLE + 127.5::DOUBLE + 27.5::DOUBLE)) + 0.5) AS INT) AS v FROM s""",
)
def brighter_scans(spark, sf_dir):
    """colour images with more brightness and contrast."""
    return _pixels(scans.colour_filtered(colour_images(spark, sf_dir), "original", 0.25, 0.25, key="vec_id"), "v")


@query("page_corners", "SELECT s_suppkey, 4::BIGINT AS near FROM supplier")
def page_corners(spark, sf_dir):
    """how many corners are found within two pixels of where a page of 64 by 48 was drawn, light on dark or dark on light."""
    k = F.col("s_suppkey")
    left, top, right, below = (c.cast("int") for c in (8 + k % 9, 6 + k % 7, 56 - k % 8, 42 - k % 5))
    dark, bright, turned = (40 + k % 50).cast("int"), (190 + k % 60).cast("int"), k % 3 == 0
    desk, page = F.when(turned, bright).otherwise(dark), F.when(turned, dark).otherwise(bright)
    bare = F.array_repeat(desk, 64 * 3)
    line = F.concat(F.array_repeat(desk, left * 3), F.array_repeat(page, (right - left) * 3), F.array_repeat(desk, (64 - right) * 3))
    pixels = F.flatten(F.concat(F.array_repeat(bare, top), F.array_repeat(line, below - top), F.array_repeat(bare, 48 - below)))
    keys = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    found = scans.page_corners(keys.select("s_suppkey", F.lit(64).alias("width"), F.lit(48).alias("height"), pixels.alias("pixels")), "s_suppkey")
    told = F.array(*(F.array(x, y) for x, y in ((left, top), (right, top), (right, below), (left, below))))
    off = F.zip_with("corners", told, lambda c, d: (F.abs(c[0] - d[0]) < 2) & (F.abs(c[1] - d[1]) < 2))
    return found.select("s_suppkey", F.coalesce(F.size(F.filter(off, lambda x: x)), F.lit(0)).cast("long").alias("near"))


# ---- glyphs and text operators: each turn as a line of signs five points wide

SAID = "s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, text FROM conversations WHERE text IS NOT NULL)"


def said(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", n.alias("n"), "text")


@query("glyph_lines", rf"WITH {SAID} SELECT conv_id, CAST(n * 20 AS DOUBLE) AS baseline, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM s WHERE regexp_matches(text, '\S')")
def glyph_lines(spark, sf_dir):
    """The signs of every turn put together again; blanks in a row are one."""
    signs = said(spark, sf_dir).select("conv_id", "n", F.posexplode(F.filter(F.split("text", ""), lambda x: x != "")).alias("i", "sign"))
    base, left = (F.col("n") * 20).cast("double"), F.col("i") * 5.0
    drawn = signs.select("conv_id", "n", "i", "sign", base.alias("baseline"), left.alias("l"), (left + 5).alias("r"), (base - 8).alias("t"), (base + 2).alias("b"), F.lit(0.0).alias("angle"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("Sans").alias("font"), F.lit(0).cast("long").alias("color"), F.lit(False).alias("underline"), F.lit(False).alias("strike"), F.lit(None).cast("string").alias("link"))
    found = glyphs.lines(drawn, ["conv_id"], ["n", "i"])
    return found.select("conv_id", "baseline", F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("text"))


@query("operator_blocks", rf"WITH {SAID}, p AS (SELECT conv_id, n, sum(CASE WHEN n % 3 = 0 THEN 40 ELSE 12 END) OVER (PARTITION BY conv_id ORDER BY n) AS y, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS opens, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM s WHERE regexp_matches(text, '\S')), q AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR opens = 1 THEN 1 ELSE 0 END AS first FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY n)) SELECT conv_id, CAST(sum(first) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS INT) AS block_no, CAST(y AS DOUBLE) AS baseline, text FROM q")
def operator_blocks(spark, sf_dir):
    """The words of every turn as operators, every third turn set further down."""
    held = said(spark, sf_dir).where(F.col("text").rlike(r"\S"))
    down = F.sum(F.when(F.col("n") % 3 == 0, 40).otherwise(12)).over(Window.partitionBy("conv_id").orderBy("n"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    placed = held.withColumn("baseline", down.cast("double")).select("conv_id", "n", "baseline", F.posexplode(words).alias("i", "text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 5.0
    ops = placed.withColumn("l", before).select("conv_id", F.struct("n", "i").alias("id"), "l", (F.col("baseline") - 8).alias("t"), (F.col("l") + F.length("text") * 5.0).alias("r"), (F.col("baseline") + 2).alias("b"), "baseline", F.lit(10.0).alias("size"), "text", F.lit(0.0).alias("angle"), F.lit(False).alias("invisible"))
    return glyphs.text_blocks(ops, ["conv_id"]).select("conv_id", "block_no", "baseline", "text")
