"""Queries over document edits, with their oracle SQL; the shapes of a page are drawn from the line items of an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import edits as e
from folioflow.plans.registry import query
from folioflow.session import table

SHAPES = """s AS (SELECT l_orderkey AS page, l_linenumber AS item, CAST(l_partkey % 500 AS DOUBLE) AS l, CAST(l_suppkey % 90 AS DOUBLE) AS t,
CAST(l_partkey % 500 + CAST(l_quantity AS INT) * 3 AS DOUBLE) AS r, CAST(l_suppkey % 90 + l_linenumber * 9 AS DOUBLE) AS b FROM lineitem)"""


def shapes(spark, sf_dir):
    left, top = F.col("l_partkey") % 500, F.col("l_suppkey") % 90
    right, bottom = left + F.col("l_quantity").cast("int") * 3, top + F.col("l_linenumber") * 9
    sides = (c.cast("double").alias(n) for n, c in (("l", left), ("t", top), ("r", right), ("b", bottom)))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item"), *sides)


@query(
    "cropped_pages",
    f"""WITH {SHAPES}, c AS (SELECT page, item, greatest(0.0, least(l, 480.0)) AS l, greatest(0.0, least(t, 100.0)) AS t, greatest(0.0, least(r, 480.0)) AS r, greatest(0.0, least(b, 100.0)) AS b FROM s)
SELECT *, (r - l >= 10 AND b - t >= 10) AS usable FROM c""",
)
def cropped_pages(spark, sf_dir):
    """D3: crop boxes on pages of 480 by 100 points."""
    sized = shapes(spark, sf_dir).withColumns({"width": F.lit(480.0), "height": F.lit(100.0)})
    return e.cropped(sized, "width", "height").drop("width", "height")


@query(
    "compressed_images",
    """WITH i AS (SELECT p_partkey, p_size, p_size * 16 AS width, p_size * 12 AS height, CASE WHEN p_size % 9 = 0 THEN 1 ELSE 8 END AS bits, p_size % 7 = 0 AS stencil, CAST(p_size * p_size * 100 AS BIGINT) AS bytes, CAST(p_size * (p_partkey % 60) * 100 AS BIGINT) AS new_bytes FROM part),
u AS (SELECT *, NOT stencil AND bits > 1 AND width * height >= 4096 AND CAST(new_bytes AS DOUBLE) < CAST(bytes AS DOUBLE) * CAST(0.95 AS DOUBLE) AS used FROM i)
SELECT used, round(avg(CASE WHEN width > 0 THEN least(1.0, p_size * 8.0 / 72.0 * 150.0 / greatest(width, height)) ELSE 1.0 END), 6) AS scale, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS before, CAST(sum(CASE WHEN used THEN new_bytes ELSE bytes END) AS BIGINT) AS after FROM u GROUP BY used""",
)
def compressed_images(spark, sf_dir):
    """The report of a compression at 150 points an inch."""
    side = F.col("p_size")
    made = table(spark, sf_dir, "part").select(
        (side * 16).alias("width"), (side * 12).alias("height"), F.when(side % 9 == 0, 1).otherwise(8).alias("bits"), (side % 7 == 0).alias("stencil"),
        (side * side * 100).cast("long").alias("bytes"), (side * (F.col("p_partkey") % 60) * 100).cast("long").alias("new_bytes"), (side * 8.0).alias("placed"),
    )
    done = e.compressed(made, "placed", 150.0)
    return done.groupBy("used").agg(F.round(F.avg("scale"), 6).alias("scale"), F.count("*").alias("images"), F.sum("bytes").alias("before"), F.sum("after").alias("after"))


@query("remapped_points", f"WITH {SHAPES} SELECT page, item, CASE WHEN r > l THEN 10.0::DOUBLE + (l + item - l) / (r - l) * 90.0::DOUBLE ELSE 10.0::DOUBLE END AS x FROM s")
def remapped_points(spark, sf_dir):
    """Points of annotations whose sides move to 10..100."""
    x = e.remapped(F.col("l") + F.col("item"), F.col("l"), F.col("r"), F.lit(10.0), F.lit(100.0))
    return shapes(spark, sf_dir).select("page", "item", x.alias("x"))


@query(
    "transformed_vectors",
    f"""WITH {SHAPES} SELECT page, item, least(-t, -b) + 500 AS l, least(2 * l, 2 * r) - 3 AS t, greatest(-t, -b) + 500 AS r, greatest(2 * l, 2 * r) - 3 AS b FROM s""",
)
def transformed_vectors(spark, sf_dir):
    """Vectors turned by a quarter, stretched and moved."""
    return e.transformed(shapes(spark, sf_dir), (0.0, 2.0, -1.0, 0.0, 500.0, -3.0))


@query(
    "right_limits",
    f"""WITH {SHAPES} SELECT x.page, x.item, coalesce(min(y.l), CAST(650 AS DOUBLE)) AS "limit" FROM s x LEFT JOIN s y ON x.page = y.page AND y.l >= x.r AND y.t < x.b AND y.b > x.t GROUP BY x.page, x.item""",
)
def right_limits(spark, sf_dir):
    """How far each edited block may grow to the right."""
    return e.right_limits(shapes(spark, sf_dir), ["page"], "item", 650.0)


@query(
    "first_links",
    f"""WITH {SHAPES}, k AS (SELECT *, item AS ord, 'link ' || item AS link FROM s WHERE item % 2 = 0)
SELECT s.page, s.item, min_by(k.link, k.ord) AS link FROM s JOIN k ON s.page = k.page AND (s.l + s.r) / 2 >= k.l AND (s.l + s.r) / 2 <= k.r AND (s.t + s.b) / 2 >= k.t AND (s.t + s.b) / 2 <= k.b GROUP BY s.page, s.item""",
)
def first_links(spark, sf_dir):
    """Every other shape of a page is a link; the first that holds an item's middle wins."""
    items = shapes(spark, sf_dir)
    links = items.where("item % 2 = 0").withColumn("ord", F.col("item")).withColumn("link", F.concat(F.lit("link "), F.col("item").cast("string")))
    return e.first_link(items, links, ["page"], "item")


@query(
    "kept_content",
    """WITH o AS (SELECT user_id, event_id, event_id % 5 = 0 AS opens, event_id % 5 = 3 AS closes, event_id % 10 = 0 AS ours FROM events),
d AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM o),
m AS (SELECT a.user_id, a.event_id, coalesce(min(z.event_id), 4611686018427387904) AS last FROM d a LEFT JOIN d z ON a.user_id = z.user_id AND z.event_id > a.event_id AND z.closes AND z.depth = a.depth - 1 WHERE a.opens AND a.ours GROUP BY a.user_id, a.event_id)
SELECT d.user_id, d.event_id FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = d.user_id AND d.event_id BETWEEN m.event_id AND m.last)""",
)
def kept_content(spark, sf_dir):
    """A user's events as content operators; every fifth opens a mark, every tenth one of ours, some close one."""
    n = F.col("event_id")
    kept = e.without_artifacts(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", n % 5 == 0, n % 5 == 3, n % 10 == 0)
    return kept.select("user_id", "event_id")


@query("metadata_overlaid", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN nullif(trim(CASE WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name || ' ' END), '') ELSE c_name END AS title FROM customer")
def metadata_overlaid(spark, sf_dir):
    """Titles replaced, cleared by a blank, or left as nothing was supplied."""
    third = F.col("c_custkey") % 3
    new = F.when(third == 1, F.lit(" ")).otherwise(F.concat("c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", e.overlaid(F.col("c_name"), new, third != 0).alias("title"))


@query(
    "fitted_edges",
    """WITH m AS (SELECT l_suppkey, sum(l_linenumber) AS w, sum(CAST(l_linenumber * CAST(l_quantity AS INT) AS DOUBLE)) AS wx, sum(CAST(l_linenumber * (l_partkey % 97) AS DOUBLE)) AS wy,
sum(CAST(l_linenumber * CAST(l_quantity AS INT) * CAST(l_quantity AS INT) AS DOUBLE)) AS xx, sum(CAST(l_linenumber * CAST(l_quantity AS INT) * (l_partkey % 97) AS DOUBLE)) AS xy, sum(CAST(l_linenumber * (l_partkey % 97) * (l_partkey % 97) AS DOUBLE)) AS yy FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST(round(wx / w, 6) AS DOUBLE) AS cx, CAST(round(wy / w, 6) AS DOUBLE) AS cy, CAST(round(atan2(2 * (xy / w - wx / w * wy / w), xx / w - wx / w * wx / w - yy / w + wy / w * wy / w) / 2, 6) AS DOUBLE) AS angle FROM m""",
)
def fitted_edges(spark, sf_dir):
    """A weighted line through each supplier's points."""
    points = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").cast("double").alias("x"), (F.col("l_partkey") % 97).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("n"))
    fitted = e.fitted_lines(points, ["l_suppkey"], "x", "y", F.col("n"))
    return fitted.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "angle")))


@query(
    "continued_turns",
    r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations WHERE text IS NOT NULL),
q AS (SELECT *, CASE WHEN prev IS NOT NULL AND NOT regexp_matches(prev, '[.!?]\s*$') AND (regexp_matches(text, '^\s*[a-z]') OR regexp_matches(prev, '-$')) THEN 0 ELSE 1 END AS starts FROM p)
SELECT conv_id, turn, CAST(sum(starts) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS paragraph FROM q""",
)
def continued_turns(spark, sf_dir):
    """Turns that go on where the one before has no end."""
    said = table(spark, sf_dir, "conversations").where("text is not null")
    runs = e.continued(said, ["conv_id"], ["turn", "text"], "text", F.col("text").rlike(r"[.!?]\s*\z"), F.col("text").rlike(r"^\s*[a-z]"))
    return runs.select("conv_id", "turn", "paragraph")


@query(
    "indent_levels",
    "WITH x AS (SELECT DISTINCT l_orderkey, CAST(l_partkey % 40 AS DOUBLE) AS v FROM lineitem), "
    "a AS (SELECT l_orderkey, list_sort(list(v)) AS up FROM x GROUP BY l_orderkey) "
    "SELECT l_orderkey, CAST(len(list_reduce(list_transform(up, lambda v: [v]), lambda k, v: CASE WHEN v[1] - k[len(k)] > 6 THEN list_concat(k, v) ELSE k END)) AS INT) AS levels FROM a",
)
def indent_levels(spark, sf_dir):
    """How many list levels the left edges of an order's items make at a body size of 10."""
    lefts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 40).cast("double")).alias("lefts"))
    return lefts.select("l_orderkey", F.size(e.indent_levels(F.col("lefts"), F.lit(10.0))).alias("levels"))


@query(
    "watermarks",
    """WITH p AS (SELECT p_partkey, 200.0 + p_size * 10 AS w, 300.0 + p_size * 7 AS h, length(p_name) * 9.0 AS tw, 10.0 + p_size AS th FROM part), s AS (SELECT *, greatest(tw * 1.3, 120.0)::DOUBLE AS sx, greatest(th * 4.0, 120.0)::DOUBLE AS sy FROM p),
r AS (SELECT *, unnest(range(0, CAST(ceil((h + sy / 2) / sy) AS BIGINT))) AS r FROM s), t AS (SELECT *, CASE WHEN r % 2 = 0 THEN sx / 2 ELSE 0 END AS x0 FROM r), c AS (SELECT *, unnest(range(0, CAST(ceil((w + sx - x0) / sx) AS BIGINT))) AS c FROM t),
a AS (SELECT p_partkey, 'tile' AS position, CAST(x0 + c * sx AS DOUBLE) AS x, CAST(sy / 2 + r * sy AS DOUBLE) AS y, tw, th FROM c UNION ALL SELECT p_partkey, 'top', w / 2, h - greatest(th, 30) - 20, tw, th FROM p UNION ALL SELECT p_partkey, 'bottom', w / 2, greatest(th, 30) + 20, tw, th FROM p UNION ALL SELECT p_partkey, 'center', w / 2, h / 2, tw, th FROM p)
SELECT p_partkey, position, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(y AS DOUBLE), 6) AS y, round(CAST(-tw / 2 AS DOUBLE), 6) AS dx, round(CAST(-th * 0.35 AS DOUBLE), 6) AS dy FROM a""",
)
def watermarks(spark, sf_dir):
    """The marks of every part's page in each of the four positions."""
    size = F.col("p_size")
    pages = table(spark, sf_dir, "part").select("p_partkey", (200.0 + size * 10).alias("w"), (300.0 + size * 7).alias("h"), (F.length("p_name") * 9.0).alias("tw"), (10.0 + size).alias("th"))
    found = None
    for position in e.POSITIONS:
        marks = e.watermarked(pages, ["p_partkey"], "w", "h", "tw", "th", position).select("p_partkey", F.lit(position).alias("position"), *(F.round(c, 6).alias(c) for c in ("x", "y", "dx", "dy")))
        found = marks if found is None else found.unionByName(marks)
    return found
