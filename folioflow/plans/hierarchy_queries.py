"""Queries over chains of rows, with recursive SQL; events of a user stand for units, styles, list items and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import hierarchies as h
from folioflow.plans.registry import query
from folioflow.session import table

#: Each event stands in the one before it; of every third user the first one in the last, which makes a ring.
CHAIN = """c AS (SELECT *, lag(event_id) OVER w AS before, CASE WHEN user_id % 3 = 0 THEN last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS ring
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT *, coalesce(before, ring) AS parent FROM c)"""


def _chained(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last("event_id").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, sf_dir, "events").withColumn("parent", F.coalesce(F.lag("event_id").over(by), F.when(F.col("user_id") % 3 == 0, last)))


@query("nested_units", f"WITH RECURSIVE {CHAIN}, u AS (SELECT event_id FROM e WHERE event_type = 'error' AND event_id % 10 = 0 UNION SELECT e.parent FROM u JOIN e USING (event_id) WHERE e.parent IS NOT NULL) SELECT event_id FROM u")
def nested_units(spark, sf_dir):
    """Some units and all they stand in, through chains as long as a user has events, and rings."""
    units = _chained(spark, sf_dir).select("event_id", "event_type", "parent")
    return h.with_ancestors(units.where("event_type = 'error' AND event_id % 10 = 0"), units, "event_id", "parent")


@query(
    "inherited_styles",
    f"""WITH {CHAIN}, p AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS size, CASE WHEN event_id % 11 = 0 THEN event_type = 'click' END AS bold FROM e)
SELECT user_id, event_id, coalesce(last_value(size IGNORE NULLS) OVER up, CASE WHEN user_id % 3 = 0 THEN last_value(size IGNORE NULLS) OVER whole END) AS size,
  coalesce(last_value(bold IGNORE NULLS) OVER up, CASE WHEN user_id % 3 = 0 THEN last_value(bold IGNORE NULLS) OVER whole END) AS bold
FROM p WINDOW up AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), whole AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def inherited_styles(spark, sf_dir):
    """Each style's size and weight from the nearest that it is based on and that has one."""
    styles = _chained(spark, sf_dir).withColumns({"size": F.when(F.col("event_type") == "purchase", F.col("value")), "bold": F.when(F.col("event_id") % 11 == 0, F.col("event_type") == "click")})
    return h.inherited(styles, ["user_id"], "event_id", "parent", ["size", "bold"])


@query(
    "nested_numbers",
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'error' AS listed, event_id % 3 AS level, value > 250 AS ordered FROM events),
r AS (SELECT *, sum(CAST(NOT listed OR level < 0 AS INT)) OVER o AS r0, sum(CAST(NOT listed OR level < 1 AS INT)) OVER o AS r1, sum(CAST(NOT listed OR level < 2 AS INT)) OVER o AS r2 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY n)),
s AS (SELECT *, [r0, r1, r2][level + 1] AS run FROM r WHERE listed),
k AS (SELECT *, sum(CAST(ordered IS DISTINCT FROM was AS INT)) OVER (PARTITION BY user_id, level, run ORDER BY n) AS kind FROM (SELECT *, lag(ordered) OVER (PARTITION BY user_id, level, run ORDER BY n) AS was FROM s))
SELECT user_id, event_id, CAST(number AS INT) AS number FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, level, run, kind ORDER BY n) AS number FROM k UNION ALL SELECT user_id, event_id, NULL FROM e WHERE NOT listed)""",
)
def nested_numbers(spark, sf_dir):
    """Numbers in three levels of lists, which errors end."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    items = table(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place"), (F.col("event_type") != "error").alias("listed"), (F.col("event_id") % 3).alias("level"), (F.col("value") > 250).alias("ordered"))
    numbers = h.nested_numbers(items, ["user_id"], "place", "listed", "level", "ordered")
    return items.join(numbers, ["user_id", "place"]).select("user_id", "event_id", "number")


@query(
    "replayed_edits",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 7 < 4 THEN 'edit' WHEN event_id % 7 < 6 THEN 'undo' ELSE 'redo' END AS kind FROM events),
s(user_id, event_id, n, applied, shown, u, r) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, false, -1::BIGINT, []::BIGINT[], []::BIGINT[] FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.n, kind = 'edit' OR (kind = 'undo' AND len(u) > 0) OR (kind = 'redo' AND len(r) > 0),
    CASE WHEN kind = 'edit' THEN e.event_id WHEN kind = 'undo' AND len(u) > 0 THEN u[len(u)] WHEN kind = 'redo' AND len(r) > 0 THEN r[len(r)] ELSE shown END,
    CASE WHEN kind = 'edit' THEN list_append(u, shown)[greatest(1, len(u) - 18):] WHEN kind = 'undo' THEN u[:greatest(len(u) - 1, 0)] WHEN kind = 'redo' AND len(r) > 0 THEN list_append(u, shown) ELSE u END,
    CASE WHEN kind = 'edit' THEN [] WHEN kind = 'undo' AND len(u) > 0 THEN list_append(r, shown) WHEN kind = 'redo' THEN r[:greatest(len(r) - 1, 0)] ELSE r END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, applied, nullif(shown, -1) AS shown, CAST(len(u) AS INT) AS undos, CAST(len(r) AS INT) AS redos FROM s WHERE n > 0""",
)
def replayed_edits(spark, sf_dir):
    """Edits, undo and redo of each user's document."""
    kind = F.when(F.col("event_id") % 7 < 4, "edit").when(F.col("event_id") % 7 < 6, "undo").otherwise("redo")
    return h.replayed(table(spark, sf_dir, "events").withColumn("kind", kind), ["user_id"], ["ts", "event_id"], "event_id", "kind")


@query(
    "unique_file_names",
    r"""WITH RECURSIVE n AS (SELECT p_partkey // 50 AS folder, p_partkey, split_part(p_type, ' ', 1) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' (2).v1.pdf' WHEN 2 THEN ' (2) (2).v1.pdf' ELSE '.v1.pdf' END AS name FROM part),
there AS (SELECT p_partkey // 50 AS folder, list(DISTINCT split_part(p_type, ' ', 1) || ' (3).v1.pdf') AS taken FROM part WHERE p_size < 5 GROUP BY 1),
o AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.+)[.][^.]*$', 1) ELSE name END AS stem, row_number() OVER (PARTITION BY folder ORDER BY p_partkey) AS i FROM n),
s(folder, i, p_partkey, unique_name, taken) AS (SELECT o.folder, 0::BIGINT, 0::BIGINT, '', coalesce(there.taken, []) FROM o LEFT JOIN there USING (folder) WHERE i = 1 UNION ALL
  SELECT folder, i, p_partkey, got, list_append(taken, got) FROM (SELECT o.folder, o.i, o.p_partkey, s.taken, list_filter(list_prepend(o.name, list_transform(range(2, len(s.taken) + 3), lambda k: o.stem || ' (' || k || ')' || substr(o.name, length(o.stem) + 1))), lambda c: NOT list_contains(s.taken, c))[1] AS got
    FROM s JOIN o ON o.folder = s.folder AND o.i = s.i + 1))
SELECT folder, p_partkey, unique_name FROM s WHERE i > 0""",
)
def unique_file_names(spark, sf_dir):
    """Names that are free in their folder, where some stand already and some look like numbered ones."""
    folder, word = F.floor(F.col("p_partkey") / 50).alias("folder"), F.split_part("p_type", F.lit(" "), F.lit(1))
    ending = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, " (2).v1.pdf").when(F.col("p_partkey") % 5 == 2, " (2) (2).v1.pdf").otherwise(".v1.pdf")
    part = table(spark, sf_dir, "part")
    there = part.where("p_size < 5").select(folder, F.concat(word, F.lit(" (3).v1.pdf")).alias("name"))
    return h.free_names(part.select(folder, "p_partkey", F.concat(word, ending).alias("name")), ["folder"], "name", "p_partkey", there)


@query(
    "imported_files",
    r"""WITH RECURSIVE f AS (SELECT doc_id // 40 AS folder, doc_id, 'doc' || doc_id % 7 || '.txt' AS name, sha1(text) AS key FROM documents WHERE text IS NOT NULL),
old AS (SELECT key, min('old/' || doc_id) AS path FROM f WHERE doc_id % 13 = 0 GROUP BY key), there AS (SELECT folder, 'doc' || doc_id % 7 || ' (' || (2 + doc_id % 2) || ').txt' AS name, min(key) AS key FROM f WHERE doc_id % 9 < 2 GROUP BY 1, 2),
first AS (SELECT key, min(doc_id) AS doc_id FROM f GROUP BY key), n AS (SELECT f.*, old.path AS was FROM f JOIN first USING (key, doc_id) LEFT JOIN old USING (key)),
same AS (SELECT n.key, arg_min(t.name, t.name) AS name FROM n JOIN there t ON t.folder = n.folder AND t.key = n.key AND (t.name = n.name OR t.name IN (left(n.name, 4) || ' (2).txt', left(n.name, 4) || ' (3).txt')) WHERE was IS NULL GROUP BY n.key),
o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS i FROM n WHERE was IS NULL AND key NOT IN (SELECT key FROM same)),
s(folder, i, doc_id, got, taken) AS (SELECT folder, 0::BIGINT, 0::BIGINT, '', coalesce((SELECT list(name) FROM there t WHERE t.folder = o.folder), []) FROM o WHERE i = 1 UNION ALL
  SELECT folder, i, doc_id, got, list_append(taken, got) FROM (SELECT o.folder, o.i, o.doc_id, s.taken, list_filter(list_prepend(o.name, list_transform(range(2, len(s.taken) + 3), lambda k: left(o.name, 4) || ' (' || k || ').txt')), lambda c: NOT list_contains(s.taken, c))[1] AS got FROM s JOIN o ON o.folder = s.folder AND o.i = s.i + 1)),
r AS (SELECT n.key, n.doc_id, coalesce(was, n.folder || '/' || coalesce(same.name, s.got)) AS path, CASE WHEN was IS NOT NULL THEN 'indexed' WHEN same.name IS NOT NULL THEN 'identical' ELSE 'copied' END AS how FROM n LEFT JOIN same USING (key) LEFT JOIN s ON s.doc_id = n.doc_id AND s.i > 0)
SELECT f.doc_id, f.key, r.path, CASE WHEN f.doc_id = r.doc_id THEN how ELSE 'indexed' END AS how FROM f JOIN r USING (key)""",
)
def imported_files(spark, sf_dir):
    """Texts imported as files of folders that hold some already, with an index of earlier imports."""
    doc = F.col("doc_id")
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.floor(doc / 40).alias("folder"), "doc_id", F.concat(F.lit("doc"), (doc % 7).cast("string"), F.lit(".txt")).alias("name"), F.sha1(F.col("text").cast("binary")).alias("key"))
    index = files.where("doc_id % 13 = 0").select("key", F.concat(F.lit("old/"), doc.cast("string")).alias("path"))
    there = F.concat(F.lit("doc"), (doc % 7).cast("string"), F.lit(" ("), (doc % 2 + 2).cast("string"), F.lit(").txt"))
    existing = files.where("doc_id % 9 < 2").groupBy("folder", there.alias("name")).agg(F.min("key").alias("key"))
    return h.imported(files, existing, index, "folder", "name", "key", "doc_id")
