"""Queries over aggregates, windows, joins, sets, sorts and number functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import binary as b
from folioflow.functions import geometry as g
from folioflow.functions import numbers as n
from folioflow.functions import text as t
from folioflow.operators import aggregates as a
from folioflow.operators import joins as j
from folioflow.operators import windows as w
from folioflow.plans.registry import query
from folioflow.plans.text_queries import LINES
from folioflow.session import table

# ---- windows


@query(
    "reading_progress",
    rf"""WITH {LINES}, k AS (SELECT doc_id, line_no, CAST(len(regexp_extract_all(line, '\S+')) AS BIGINT) AS words FROM lines WHERE regexp_matches(line, '\S')),
p AS (SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(words) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM k)
SELECT doc_id, CAST(line_no AS INT) AS line_no, before, CAST(ceil((total - before) / 230.0) AS BIGINT) AS minutes, CASE WHEN ceil((total - before) / 230.0) < 60 THEN CAST(floor(before / CAST(total AS DOUBLE) * 100) AS BIGINT) || '% · about ' || CAST(ceil((total - before) / 230.0) AS BIGINT) || ' min left' ELSE CAST(floor(before / CAST(total AS DOUBLE) * 100) AS BIGINT) || '% · about ' || (CAST(ceil((total - before) / 230.0) AS BIGINT) // 60) || ' h ' || (CAST(ceil((total - before) / 230.0) AS BIGINT) % 60) || ' min left' END AS label FROM p""",
)
def reading_progress(spark, sf_dir):
    """Words before each line, minutes left at 230 words a minute."""
    lines = w.document_lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike(r"\S")).select("doc_id", "line_no", t.word_count(F.col("line")).alias("words"))
    total = F.sum("words").over(Window.partitionBy("doc_id"))
    done = lines.select("doc_id", "line_no", w.running("words", ["doc_id"], ["line_no"], inclusive=False).alias("before"), total.alias("total"))
    minutes = F.ceil((F.col("total") - F.col("before")) / 230.0)
    return done.select("doc_id", "line_no", "before", minutes.alias("minutes"), n.progress_label(F.col("before") / F.col("total"), minutes).alias("label"))


@query(
    "section_of_turn",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, count(*) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM conversations""",
)
def section_of_turn(spark, sf_dir):
    """The latest user turn stands for the latest heading."""
    turns = table(spark, sf_dir, "conversations")
    order = ["turn", "role", "text"]
    return turns.select("conv_id", "turn", w.last_known(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], order).alias("section"), F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long").alias("position"))


@query(
    "section_end",
    """WITH b AS (SELECT l_orderkey, l_linenumber AS i, l_linenumber % 3 + 1 AS level FROM lineitem)
SELECT x.l_orderkey, x.i, coalesce(min(y.i), 1 + any_value(m.last)) AS section_end FROM b x JOIN (SELECT l_orderkey, max(i) AS last FROM b GROUP BY 1) m USING (l_orderkey) LEFT JOIN b y ON y.l_orderkey = x.l_orderkey AND y.i > x.i AND y.level <= x.level GROUP BY x.l_orderkey, x.i""",
)
def section_end(spark, sf_dir):
    """The next heading of the same level or a higher one, else the end."""
    heads = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), (F.col("l_linenumber") % 3 + 1).alias("level")).distinct()
    last = F.max("i").over(Window.partitionBy("l_orderkey"))
    return heads.select("l_orderkey", "i", F.coalesce(w.next_at_most(heads, ["l_orderkey"], "i", "level", 3), last + 1).alias("section_end"))


@query("page_starts", "WITH p AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN event_id // 50 END AS page FROM events), q AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM p) SELECT event_id, page FROM q WHERE page IS NOT NULL AND (previous IS NULL OR page <> previous)")
def page_starts(spark, sf_dir):
    """Page differs from the last one known."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 50)).alias("page"))
    q = events.withColumn("previous", w.last_known(F.col("page"), ["user_id"], ["event_id"], before=True))
    return q.where("page is not null and (previous is null or page <> previous)").select("event_id", "page")


@query(
    "interval_bands",
    """WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS low, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) % 7 AS high FROM lineitem),
y AS (SELECT *, max(high) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
z AS (SELECT *, sum(CASE WHEN reach IS NULL OR low - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY low, high RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM y)
SELECT l_suppkey, CAST(band AS INT) AS band, CAST(min(low) AS INT) AS low, CAST(max(high) AS INT) AS high, count(*) AS n FROM z GROUP BY l_suppkey, band""",
)
def interval_bands(spark, sf_dir):
    """Gaps and islands on the running maximum of interval ends."""
    low = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", low.alias("low"), (low + F.col("l_quantity").cast("int") % 7).alias("high"))
    banded = w.bands(x, "low", "high", F.lit(3), ["l_suppkey"])
    return banded.groupBy("l_suppkey", "band").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))


@query("page_labels", "WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 4 AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) SELECT o_orderkey, 'Page ' || n || ' of ' || (total + 4) AS label FROM x")
def page_labels(spark, sf_dir):
    """Numbers from 5 on over each customer's orders."""
    by = Window.partitionBy("o_custkey")
    number, total = F.row_number().over(by.orderBy("o_orderkey")) + 4, F.count("*").over(by) + 4
    label = F.replace(F.replace(F.lit("Page {n} of {N}"), F.lit("{n}"), F.col("n").cast("string")), F.lit("{N}"), F.col("total").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("n"), total.alias("total")).select("o_orderkey", label.alias("label"))


@query(
    "cache_eviction",
    "WITH x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM documents) SELECT source, doc_id FROM x WHERE n > 30 OR total > 60000",
)
def cache_eviction(spark, sf_dir):
    """A cache of 30 entries and 60,000 bytes for each source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return w.evicted(docs, ["source"], [F.desc("doc_id")], "doc_id", "n_chars", 30, 60_000).select("source", "doc_id")


@query("debounced", "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) > 400000")
def debounced(spark, sf_dir):
    """The last event before a pause of over 400 ms."""
    follow = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", follow.alias("next"))
    return e.where(F.col("next").isNull() | (F.unix_micros(F.col("next").cast("timestamp_ltz")) - F.unix_micros(F.col("ts").cast("timestamp_ltz")) > 400_000)).select("event_id", "user_id")


@query("rank_filtered", "SELECT vec_id, i, CAST(min(x) OVER r AS DOUBLE) AS low, CAST(max(x) OVER r AS DOUBLE) AS high FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) WINDOW r AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rank_filtered(spark, sf_dir):
    """Moving minimum and maximum over two neighbours."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    x = x.select("vec_id", F.col("p").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    return x.select("vec_id", "i", w.moving("min", "x", 2, ["vec_id"], ["i"]).alias("low"), w.moving("max", "x", 2, ["vec_id"], ["i"]).alias("high"))


@query("box_blurred", "WITH x AS (SELECT vec_id, [CAST(floor((CAST(v AS DOUBLE) + 1) * 128) AS DOUBLE) FOR v IN embedding] AS p FROM embeddings) SELECT vec_id, i, round(list_sum([p[greatest(1, least(len(p), i + 1 + d))] FOR d IN [-2, -1, 0, 1, 2]]) / 5, 6) AS mean FROM (SELECT vec_id, p, unnest(range(0, len(p))) AS i FROM x)")
def box_blurred(spark, sf_dir):
    """Moving mean over a plane of 0 to 255 with clamped edges."""
    plane = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 128).cast("double"))
    x = table(spark, sf_dir, "embeddings").select("vec_id", plane.alias("p"))
    return x.select("vec_id", F.posexplode(w.box_mean(F.col("p"), 2)).alias("i", "mean")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query("merged_turns", "WITH x AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) THEN 0 ELSE 1 END AS s FROM conversations), y AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM x) SELECT conv_id, CAST(island AS INT) AS island, any_value(role) AS role, string_agg(text, ' ' ORDER BY turn, text) AS text FROM y GROUP BY conv_id, island")
def merged_turns(spark, sf_dir):
    """Neighbours of one style become one span."""
    turns = table(spark, sf_dir, "conversations")
    same = F.col("role") == F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    x = w.islands(turns, ~F.coalesce(same, F.lit(False)), ["conv_id"], ["turn", "text"])
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return x.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


@query("list_numbers", "WITH x AS (SELECT *, l_returnflag = 'R' AS ordered FROM lineitem), y AS (SELECT *, CASE WHEN ordered = lag(ordered) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) THEN 0 ELSE 1 END AS s FROM x), z AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM y) SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS number FROM z")
def list_numbers(spark, sf_dir):
    """W12, flat lists: numbers restart where the kind changes."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, (F.col("l_returnflag") == "R").alias("ordered"))
    same = F.col("ordered") == F.lag("ordered").over(Window.partitionBy("l_orderkey").orderBy(*order))
    return w.ranked(w.islands(x, ~F.coalesce(same, F.lit(False)), ["l_orderkey"], order), ["l_orderkey", "island"], [F.col(c) for c in order], "number").select("l_orderkey", "l_linenumber", "number")


# ---- aggregates


@query("weighted_mode_size", "WITH s AS (SELECT l_suppkey, l_quantity, sum(l_linenumber) AS weight FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_quantity, CAST(weight AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_quantity) AS r FROM s) WHERE r = 1")
def weighted_mode_size(spark, sf_dir):
    """A1."""
    return a.weighted_mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", F.col("l_linenumber"))


@query("line_style", "WITH s AS (SELECT l_orderkey, l_returnflag, sum(greatest(1, CAST(l_quantity AS BIGINT))) AS weight, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, f, l_returnflag) AS r FROM s) SELECT m.l_orderkey, m.l_returnflag, v.bold FROM m JOIN (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 2 > sum(CAST(l_quantity AS BIGINT)) AS bold FROM lineitem GROUP BY 1) v USING (l_orderkey) WHERE r = 1")
def line_style(spark, sf_dir):
    """A2, A3: dominant style, ties to the first seen, and weighted majority."""
    x = table(spark, sf_dir, "lineitem")
    size = F.col("l_quantity").cast("long")
    mode = a.weighted_mode(x, ["l_orderkey"], "l_returnflag", F.greatest(F.lit(1), size), first_seen="l_linenumber").drop("weight")
    return mode.join(x.groupBy("l_orderkey").agg(a.majority(F.col("l_linestatus") == "O", size).alias("bold")), "l_orderkey")


@query(
    "margin_text_repeats",
    rf"""WITH {LINES}, e AS (SELECT doc_id, min(line_no) AS lo, max(line_no) AS hi FROM lines GROUP BY 1), m AS (SELECT DISTINCT d.source, l.doc_id, regexp_replace(regexp_replace(lower(regexp_replace(l.line, '^\s+|\s+$', '', 'g')), '[0-9]', '#', 'g'), '\s+', ' ', 'g') AS text FROM lines l JOIN e USING (doc_id) JOIN documents d USING (doc_id) WHERE l.line_no IN (lo, hi)),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM m GROUP BY 1) SELECT source, text, count(DISTINCT doc_id) AS n FROM m JOIN p USING (source) GROUP BY source, text HAVING count(DISTINCT doc_id) >= greatest(2, ceil(any_value(pages) * 0.02))""",
)
def margin_text_repeats(spark, sf_dir):
    """First and last lines that repeat over a source's documents."""
    ends = F.array(*(F.substring_index("text", "\n", n) for n in (1, -1)))
    margins = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.explode(ends).alias("line"))
    margins = margins.select("source", "doc_id", t.margin_text(F.col("line")).alias("text")).distinct()
    return a.repeated_margins(margins, ["source"], "doc_id", "text", share=0.02)


@query("size_levels", "WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(round(o_totalprice / 1000))), 'DESC') AS d FROM orders GROUP BY 1), f AS (SELECT o_custkey, list_reduce([[x] FOR x IN d], lambda k, x: CASE WHEN k[-1] - x[1] > 40 THEN list_concat(k, x) ELSE k END) AS levels FROM s) SELECT o_orderkey, CAST(least(6, list_position([abs(v - round(o_totalprice / 1000)) FOR v IN levels], list_min([abs(v - round(o_totalprice / 1000)) FOR v IN levels]))) AS INT) AS level, CAST(len(levels) AS INT) AS levels FROM orders JOIN f USING (o_custkey)")
def size_levels(spark, sf_dir):
    """Clusters of sizes and the nearest cluster of each order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("size"))
    levels = orders.groupBy("o_custkey").agg(F.collect_set("size").alias("s")).select("o_custkey", a.size_clusters(F.col("s"), 40.0).alias("levels"))
    return orders.join(levels, "o_custkey").select("o_orderkey", a.nearest_level(F.col("size"), F.col("levels")).cast("int").alias("level"), F.size("levels").alias("levels"))


@query("line_pitch", "SELECT l_suppkey, list_sort(list(l_quantity))[CAST(floor((count(*) - 1) * 0.35::DOUBLE) AS BIGINT) + 1] AS p35, median(l_extendedprice) AS middle, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey")
def line_pitch(spark, sf_dir):
    """Floor-index percentile (the product with 0.35 in double precision), median and upper median, from counts by value."""
    lines = table(spark, sf_dir, "lineitem")
    half = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    pitch = a.placed_values(lines, ["l_suppkey"], "l_quantity", {"p35": a.at_share(0.35), "upper_median": half["high"]})
    middle = a.placed_values(lines, ["l_suppkey"], "l_extendedprice", half)
    return pitch.join(middle, "l_suppkey").select("l_suppkey", "p35", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("middle"), "upper_median")


BYTES = "SELECT vec_id, label, unnest([CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT) FOR v IN embedding]) AS v FROM embeddings"


def _bytes(spark, sf_dir):
    plane = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(plane).alias("v"))


@query("histogram256", f"SELECT label, v, count(*) AS n FROM ({BYTES}) GROUP BY label, v")
def histogram256(spark, sf_dir):
    """A19."""
    return a.histogram(_bytes(spark, sf_dir), ["label"], F.col("v"))


@query("histogram_percentiles", f"WITH h AS (SELECT label, v, count(*) AS n FROM ({BYTES}) GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(n) OVER (PARTITION BY label) AS t FROM h) SELECT label, min(v) AS v FROM c WHERE c >= t * 0.9 GROUP BY label")
def histogram_percentiles(spark, sf_dir):
    """A20."""
    return a.histogram_percentile(a.histogram(_bytes(spark, sf_dir), ["label"], F.col("v")), ["label"], 0.9)


@query(
    "otsu_threshold",
    f"""WITH h AS (SELECT label, v, count(*) AS n FROM ({BYTES}) GROUP BY 1, 2), c AS (SELECT label, v, sum(n) OVER u AS w, sum(n * v) OVER u AS s, sum(n) OVER (PARTITION BY label) AS tw, sum(n * v) OVER (PARTITION BY label) AS ts FROM h WINDOW u AS (PARTITION BY label ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT label, v, CASE WHEN tw > w THEN round(CAST(w AS DOUBLE) * (tw - w) * pow(CAST(s AS DOUBLE) / w - CAST(ts - s AS DOUBLE) / (tw - w), 2), 3) ELSE -1 END AS b FROM c) SELECT label, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY b DESC, v) AS r FROM d) WHERE r = 1""",
)
def otsu_threshold(spark, sf_dir):
    """A21."""
    return a.otsu(a.histogram(_bytes(spark, sf_dir), ["label"], F.col("v")), ["label"])


@query("content_bounds", f"SELECT vec_id, CAST(min(x) AS BIGINT) AS left_x, CAST(max(x) AS BIGINT) AS right_x, CAST(min(y) AS BIGINT) AS top_y, CAST(max(y) AS BIGINT) AS bottom_y FROM (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT) AS v FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)) WHERE v > 140 GROUP BY vec_id")
def content_bounds(spark, sf_dir):
    """Bounds of the bright pixels of an 8 by 8 plane."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    x = x.where(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 128))) > 140)
    col, row = (F.col("i") % 8).cast("long"), F.floor(F.col("i") / 8)
    return x.groupBy("vec_id").agg(F.min(col).alias("left_x"), F.max(col).alias("right_x"), F.min(row).alias("top_y"), F.max(row).alias("bottom_y"))


@query("max_placement", "SELECT o_orderkey, m.largest, o_totalprice > m.largest AS shrink FROM orders JOIN (SELECT l_orderkey, max(greatest(l_quantity, l_extendedprice)) AS largest FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey")
def max_placement(spark, sf_dir):
    """A10, J16."""
    largest = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.greatest("l_quantity", "l_extendedprice")).alias("largest"))
    return table(spark, sf_dir, "orders").join(largest, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "largest", (F.col("o_totalprice") > F.col("largest")).alias("shrink"))


@query("document_titles", "SELECT conv_id, arg_min(text, struct_pack(a := role <> 'user', t := turn, x := text)) AS title, count(*) FILTER (role = 'user') AS headings FROM conversations GROUP BY conv_id")
def document_titles(spark, sf_dir):
    """The first top heading, else the first heading."""
    order = F.struct((F.col("role") != "user").alias("a"), F.col("turn"), F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", order).alias("title"), F.count_if(F.col("role") == "user").alias("headings"))


@query("header_rows", "SELECT l_orderkey, count(*) FILTER (l_linenumber = 1 AND l_returnflag <> 'N') * 2 >= count(*) FILTER (l_linenumber = 1) AND bool_and(l_linenumber > 1 OR l_quantity > 10) AS header, count(*) >= 2 AND count(*) FILTER (l_discount > 0) >= 0.6 * count(*) AS accepted FROM lineitem GROUP BY l_orderkey")
def header_rows(spark, sf_dir):
    """Header inference and table acceptance as conditional counts."""
    first = F.col("l_linenumber") == 1
    header = (F.count_if(first & (F.col("l_returnflag") != "N")) * 2 >= F.count_if(first)) & F.bool_and(~first | (F.col("l_quantity") > 10))
    accepted = (F.count("*") >= 2) & (F.count_if(F.col("l_discount") > 0) >= F.count("*") * 0.6)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(header.alias("header"), accepted.alias("accepted"))


@query("column_widths", rf"WITH {LINES} SELECT doc_id, CAST(least(90, greatest(8, max(length(line)))) + 2 AS INT) AS width FROM lines GROUP BY doc_id")
def column_widths(spark, sf_dir):
    """A26."""
    return w.document_lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg((F.least(F.lit(90), F.greatest(F.lit(8), F.max(F.length("line")))) + 2).alias("width"))


# ---- joins


GLYPHS = "glyphs AS (SELECT p_partkey AS id, p_partkey % 5 AS page, p_size * 10.0 AS l, p_retailprice AS t, p_size * 10.0 + 12 AS r, p_retailprice + 14 AS b FROM part), areas AS (SELECT s_suppkey AS id, s_suppkey % 5 AS page, (s_suppkey % 50) * 10.0 + 3 AS l, abs(s_acctbal) AS t, (s_suppkey % 50) * 10.0 + 90 AS r, abs(s_acctbal) + 60 AS b FROM supplier)"


def _glyphs(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    x, k, y = F.col("p_size") * 10.0, (F.col("s_suppkey") % 50) * 10.0, F.abs("s_acctbal")
    glyphs = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("page"), x.alias("l"), F.col("p_retailprice").alias("t"), (x + 12).alias("r"), (F.col("p_retailprice") + 14).alias("b"))
    areas = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("page"), (k + 3).alias("l"), y.alias("t"), (k + 90).alias("r"), (y + 60).alias("b"))
    return glyphs, areas


TAKEN = "((g.l + g.r) / 2 BETWEEN a.l AND a.r AND (g.t + g.b) / 2 BETWEEN a.t AND a.b) OR (greatest(0, least(g.r, a.r) - greatest(g.l, a.l)) * greatest(0, least(g.b, a.b) - greatest(g.t, a.t)) > 0.2 * (g.r - g.l) * (g.b - g.t))"


@query("redacted_glyphs", f"WITH {GLYPHS} SELECT id FROM glyphs g WHERE EXISTS (SELECT 1 FROM areas a WHERE a.page = g.page AND ({TAKEN}))")
def redacted_glyphs(spark, sf_dir):
    """Centre inside or a fifth covered, each glyph once; tiles make it an equi join."""
    return j.redacted(*_glyphs(spark, sf_dir), ["page"], ["id"])


@query("kept_glyphs", f"WITH {GLYPHS} SELECT id, CAST(page AS BIGINT) AS page FROM glyphs g WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE a.page = g.page AND g.l < a.r AND a.l < g.r AND g.t < a.b AND a.t < g.b)")
def kept_glyphs(spark, sf_dir):
    """Anti join on any intersection."""
    glyphs, areas = _glyphs(spark, sf_dir)
    return glyphs.join(j.touched(glyphs, areas, ["page"], ["id"]), "id", "left_anti").select("id", F.col("page").cast("long").alias("page"))


@query("touched_images", f"WITH {GLYPHS} SELECT g.id, bool_or(g.l >= a.l AND g.r <= a.r AND g.t >= a.t AND g.b <= a.b) AS covered FROM glyphs g JOIN areas a ON a.page = g.page AND g.l < a.r AND a.l < g.r AND g.t < a.b AND a.t < g.b GROUP BY g.id")
def touched_images(spark, sf_dir):
    """J2, J3, F42."""
    return j.touched(*_glyphs(spark, sf_dir), ["page"], ["id"])


@query("nearest_line", "WITH l AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS other, user_id, value AS y FROM events WHERE event_type <> 'click'), x AS (SELECT l.user_id, event_id, other, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - y), other) AS n FROM l JOIN r ON l.user_id = r.user_id AND abs(value - y) <= 0.6) SELECT user_id, event_id, other FROM x WHERE n = 1")
def nearest_line(spark, sf_dir):
    """Nearest match within 0.6, by bands."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return j.nearest_within(e.where("event_type = 'click'"), e.where("event_type <> 'click'").withColumnRenamed("event_id", "other"), ["user_id"], "value", 0.6, "event_id", "other")


@query("form_filled", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' AND s.v IS NOT NULL THEN s.v ELSE c_name END AS c_name FROM customer LEFT JOIN (SELECT s_suppkey AS c_custkey, s_name AS v FROM supplier) s USING (c_custkey)")
def form_filled(spark, sf_dir):
    """Values onto fields that exist and may be written."""
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return j.updated(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey", "c_name", F.col("c_mktsegment") != "BUILDING").select("c_custkey", "c_name")


@query("cascade_deleted", "WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%'), n AS (SELECT l_orderkey AS id, l_linenumber, l_partkey AS parent FROM lineitem) SELECT id, l_linenumber FROM n WHERE id NOT IN (SELECT id FROM d) AND parent NOT IN (SELECT id FROM d)")
def cascade_deleted(spark, sf_dir):
    """Rows of listed keys go, and their children."""
    keys = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("id"))
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").alias("parent"))
    return j.without(notes, keys, ["id"], child_of="parent").select("id", "l_linenumber")


SPLIT_RANGES = "SELECT r.first, r.last, o_orderkey FROM (SELECT unnest(range(low, high + 1, 15)) AS first, unnest(range(low, high + 1, 15)) + 19 AS last FROM (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders)) r JOIN orders ON o_orderkey BETWEEN r.first AND r.last"


@query("split_ranges", SPLIT_RANGES)
@query("split_ranges_all", SPLIT_RANGES)
def split_ranges(spark, sf_dir):
    """Overlapping ranges from the least to the largest key, so that every row is in one or two."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    ends = orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).where("low is not null")
    # a row is in the range that begins at or before it and, while that is within 19, in the one before; no range is spelt out
    held = orders.join(F.broadcast(ends), F.lit(True)).withColumn("last_first", F.col("o_orderkey") - F.pmod(F.col("o_orderkey") - F.col("low"), F.lit(15)))
    starts = F.filter(F.array("last_first", F.col("last_first") - 15), lambda first: (first >= F.col("low")) & (first + 19 >= F.col("o_orderkey")))
    return held.select(F.explode(starts).alias("first"), "o_orderkey").select("first", (F.col("first") + 19).alias("last"), "o_orderkey")


@query("organised_pages", "WITH s AS (SELECT c_custkey AS out, i AS pos, CASE WHEN i % 3 <> 2 THEN c_custkey END AS file, i % 2 + 1 AS index FROM customer, (SELECT unnest(range(0, 6)) AS i)), p AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS index, o_orderkey FROM orders) SELECT out, CAST(pos AS BIGINT) AS position, o_orderkey FROM s LEFT JOIN p ON s.file = p.file AND s.index = p.index")
def organised_pages(spark, sf_dir):
    """Order lists as documents, with repeats and blanks."""
    spots = F.sequence(F.lit(0), F.lit(5))
    spec = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("out"), F.explode(spots).alias("pos"))
    spec = spec.withColumn("file", F.when(F.col("pos") % 3 != 2, F.col("out"))).withColumn("index", F.col("pos") % 2 + 1)
    pages = w.ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey"), ["file"], [F.col("o_orderkey")], "index")
    return j.organised(spec, pages).select("out", F.col("position").cast("long").alias("position"), "o_orderkey")


@query(
    "turned_pages",
    """WITH s AS (SELECT c_custkey AS out, i AS pos, CASE WHEN i % 4 <> 3 THEN c_custkey END AS file, i % 3 + 1 AS index, i * 90 - 180 AS turn FROM customer, (SELECT unnest(range(0, 7)) AS i)),
p AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS index, o_orderkey, o_orderkey % 4 * 90 AS own FROM orders)
SELECT out, CAST(pos AS BIGINT) AS position, o_orderkey, CAST((coalesce(own, 0) + turn + 720) % 360 AS BIGINT) AS turn FROM s LEFT JOIN p USING (file, index)""",
)
def turned_pages(spark, sf_dir):
    """Order lists as documents whose pages are turned, from their own turn each time."""
    spec = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("out"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pos"))
    spec = spec.withColumns({"file": F.when(F.col("pos") % 4 != 3, F.col("out")), "index": F.col("pos") % 3 + 1, "turn": F.col("pos") * 90 - 180})
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", (F.col("o_orderkey") % 4 * 90).alias("turn"))
    pages = w.ranked(own, ["file"], [F.col("o_orderkey")], "index")
    return j.organised(spec, pages).select("out", F.col("position").cast("long").alias("position"), "o_orderkey", F.col("turn").cast("long").alias("turn"))


@query("column_of_cell", "SELECT l_orderkey, l_linenumber, CAST(coalesce((SELECT min(k) FROM (SELECT unnest(range(0, 4)) AS k) c WHERE l_quantity >= k * 15 - 0.5 AND l_quantity <= k * 15 + 10.5), 0) AS INT) AS col FROM lineitem")
def column_of_cell(spark, sf_dir):
    """The first column interval that holds a cell, with slack, else 0."""
    q = F.col("l_quantity")
    hit = F.coalesce(*(F.when((q >= k * 15 - 0.5) & (q <= k * 15 + 10.5), k) for k in range(4)), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hit.alias("col"))


# ---- sets, sorts, limits


@query("import_dedupe", "SELECT doc_id, sha1(text) AS key, min(doc_id) OVER (PARTITION BY sha1(text)) AS kept FROM documents WHERE text IS NOT NULL")
def import_dedupe(spark, sf_dir):
    """The first import of equal content."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", b.content_key(F.col("text")).alias("key"))
    return docs.join(docs.groupBy("key").agg(F.min("doc_id").alias("kept")), "key")


@query("library_search", "WITH u AS (SELECT p_name AS name, 1 AS source, p_partkey AS id FROM part UNION ALL SELECT c_name, 2, c_custkey FROM customer UNION ALL SELECT s_name, 3, s_suppkey FROM supplier) SELECT name, source, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, id) AS r FROM u WHERE contains(lower(name), '1')) WHERE r = 1")
def library_search(spark, sf_dir):
    """Ordered distinct union of three listings."""
    parts = [(("part", "p_name", "p_partkey"), 1), (("customer", "c_name", "c_custkey"), 2), (("supplier", "s_name", "s_suppkey"), 3)]
    found = None
    for (name, label, key), rank in parts:
        rows = table(spark, sf_dir, name).select(F.col(label).alias("name"), F.lit(rank).alias("source"), F.col(key).alias("id"))
        found = rows if found is None else found.unionByName(rows)
    return w.ranked(found.where(F.contains(F.lower("name"), F.lit("1"))), ["name"], [F.col("source"), F.col("id")]).where("n = 1").drop("n")


@query("moved_paths", "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT page_id, CASE WHEN path = f OR starts_with(path, f || '/') THEN 'moved' || substr(path, length(f) + 1) ELSE path END AS path, regexp_extract(path, '([^/]*)$', 1) AS file FROM p, (SELECT min(regexp_extract(path, '^([^/]*)', 1)) AS f FROM p) x")
def moved_paths(spark, sf_dir):
    """A prefix rewritten; the old prefix is a scalar subquery."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    old = p.agg(F.coalesce(F.min(F.regexp_extract("path", "^([^/]*)", 1)), F.lit("")).alias("old"))
    held = p.select("page_id", "path", old.scalar().alias("old"))
    under = (F.col("path") == F.col("old")) | F.startswith("path", F.concat("old", F.lit("/")))
    new = F.when(under, F.concat(F.lit("moved"), F.expr("substring(path, length(old) + 1)"))).otherwise(F.col("path"))
    return held.select("page_id", new.alias("path"), b.file_of(F.col("path")).alias("file"))


@query("page_ranges", "WITH x AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS a, o_custkey % 9 + 1 AS b, o_orderkey % 10 + 1 AS c FROM orders) SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(least(a, b), greatest(a, b) + 1), [c]))), ',') AS pages FROM x")
def page_ranges(spark, sf_dir):
    """``a-b, c`` spelt out, sorted and distinct; reversed ranges count."""
    a_, b_, c_ = F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 10 + 1
    written = F.concat(a_.cast("string"), F.lit("-"), b_.cast("string"), F.lit(", "), c_.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parsed_ranges(written), ",").alias("pages"))


def parsed_ranges(c):
    """Page numbers of a range text, sorted and distinct; null where a part is no range."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    last = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("int"), first(p))
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(F.least(first(p), last(p)), F.greatest(first(p), last(p)))))
    return F.when(F.forall(parts, lambda p: p.rlike(r"^\d+\s*(-\s*\d+)?$")), F.array_sort(F.array_distinct(numbers)))


@query("recent_tools", "WITH u AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS n FROM u) WHERE n <= 3")
def recent_tools(spark, sf_dir):
    """O3, O2: the latest distinct tools of each user."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return w.ranked(last, ["user_id"], [F.desc("last"), F.col("event_type")]).where("n <= 3").select("user_id", "event_type", "n")


@query("undo_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def undo_history(spark, sf_dir):
    """The last 20 of each user."""
    return w.ranked(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).where("n <= 20").select("user_id", "event_id")


@query("file_listing", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE 'STANDARD%' THEN 0 ELSE 1 END, CASE WHEN p_type LIKE 'STANDARD%' THEN 0 ELSE p_size END DESC, lower(p_name), p_partkey) AS INT) AS position FROM part")
def file_listing(spark, sf_dir):
    """O1: folders first by name, then files by size, within each parent."""
    folder = F.col("p_type").startswith("STANDARD")
    order = [F.when(folder, 0).otherwise(1), F.when(folder, 0).otherwise(F.col("p_size")).desc(), F.lower("p_name"), F.col("p_partkey")]
    return w.ranked(table(spark, sf_dir, "part"), ["p_brand"], order, "position").select("p_partkey", "position")


# ---- numbers, geometry, binary


NUMBER_FORMS = """WITH RECURSIVE l AS (SELECT DISTINCT p_partkey AS k, p_partkey AS v, '' AS letters FROM part UNION ALL SELECT k, (v - 1) // 26, chr(CAST(65 + (v - 1) % 26 AS INT)) || letters FROM l WHERE v > 0),
s AS (SELECT p_partkey AS k, p_partkey % 4200 AS m, p_partkey * 977 AS bytes, p_partkey % 40000 + 61.5 AS serial, CASE WHEN p_partkey > 0 THEN letters ELSE CAST(p_partkey AS VARCHAR) END AS letters FROM part JOIN l ON p_partkey = k AND v <= 0),
u AS (SELECT *, CASE WHEN bytes < 1048576 THEN 1024.0 WHEN bytes < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END AS unit FROM s),
f AS (SELECT *, CAST(bytes AS DOUBLE) / CAST(unit AS DOUBLE) AS share, CASE unit WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END AS sign FROM u)
SELECT k, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN share >= 100 THEN printf('%.0f', round(share)) || sign ELSE printf('%.1f', round(share, 1)) || sign END AS size,
CASE WHEN m > 0 AND m < 4000 THEN repeat('M', CAST(m // 1000 AS INT)) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][m // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][m // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][m % 10 + 1] ELSE CAST(m AS VARCHAR) END AS roman,
letters, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(letters, ''), lambda c: CAST(ascii(c) - 64 AS BIGINT))), lambda a, c: a * 26 + c) - 1 AS BIGINT) AS back,
CASE WHEN serial >= 0 THEN TIMESTAMP '1899-12-30' + to_milliseconds(CAST((serial + CASE WHEN serial < 61 THEN 1 ELSE 0 END) * 86400000 AS BIGINT)) END AS day FROM f"""


@query("number_forms", NUMBER_FORMS)
@query("number_forms_all", NUMBER_FORMS)
def number_forms(spark, sf_dir):
    """F30, F34, F35, F37 for every key, of any number of letters; keys that are not positive stay digits."""
    k = F.col("p_partkey")
    letters = n.column_letters(k)
    return table(spark, sf_dir, "part").select(k.alias("k"), n.byte_label(k * 977).alias("size"), n.roman(k % 4200).alias("roman"), letters.alias("letters"), n.column_index(letters).alias("back"), n.serial_date((k % 40000 + 61 + 0.5).cast("double")).cast("timestamp_ntz").alias("day"))


@query("relative_dates", "SELECT o_orderkey, CASE WHEN d = 1 THEN 'Yesterday' WHEN d < 7 AND d <> 0 THEN dayname(o_orderdate) WHEN d = 0 THEN 'Today, ' || strftime(o_orderdate, '%-I:%M %p') WHEN year(o_orderdate) = 1997 THEN strftime(o_orderdate, '%b %-d') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS label FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-15') AS d FROM orders)")
def relative_dates(spark, sf_dir):
    """F29 with a fixed now."""
    return table(spark, sf_dir, "orders").select("o_orderkey", n.relative_date(F.col("o_orderdate"), F.lit("1997-06-15").cast("date")).alias("label"))


@query("geometry_forms", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_retailprice WHEN 2 THEN 612.0 - p_size ELSE 792.0 - p_retailprice END AS x, CASE p_partkey % 4 WHEN 0 THEN 792.0 - p_retailprice WHEN 1 THEN p_size * 1.0 WHEN 2 THEN p_retailprice ELSE 612.0 - p_size END AS y, upper(lpad(to_hex((p_partkey * 7919) % 16777216), 6, '0')) AS rgb, CAST(((p_partkey % 256) * 77 + (p_size % 256) * 150 + 29 * 5) // 256 AS INT) AS luma, round(p_retailprice * 2) / 2 AS half, CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS flags FROM part")
def geometry_forms(spark, sf_dir):
    """F39, F43, F45, F46, F56."""
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    x, y = g.turned(size, price, F.lit(612.0), F.lit(792.0), (k % 4) * 90)
    luma = g.luma((k % 256).cast("int"), F.col("p_size") % 256, F.lit(5))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), g.hex_rgb((k * 7919) % 16777216).alias("rgb"), luma.alias("luma"), n.half(price).alias("half"), b.style_flags(k % 2 == 1, F.col("p_size") > 25).alias("flags"))


@query("table_rows", "SELECT o_custkey, string_agg(o_orderkey || chr(9) || o_orderstatus || chr(9) || regexp_replace(o_orderpriority, '[\\t\\r\\n]+', ' ', 'g'), chr(10) ORDER BY o_orderkey) AS tsv, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS md FROM orders GROUP BY o_custkey")
def table_rows(spark, sf_dir):
    """rows as tab-separated text and as Markdown, in order."""
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.regexp_replace("o_orderpriority", r"[\t\r\n]+", " "))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("cells"))))
    tsv = F.array_join(F.transform(rows, lambda r: F.array_join(r["cells"], "\t")), "\n")
    md = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.slice(r["cells"], 1, 2), " | "), F.lit(" |"))), "\n")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(tsv.alias("tsv"), md.alias("md"))
