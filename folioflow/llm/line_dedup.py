"""Removal of later copies of repeated line runs, by a suffix array over line ids.

DataFrame functions only. The sequence of a document is its non-blank lines.
Suffixes are ranked by distributed prefix doubling: a rank at depth 2k is the place
of the pair (rank at depth k here, rank at depth k from k lines on) in the sorted
distinct pairs. A suffix whose prefix stands alone is settled and leaves, as no
repeat can start there. Suffixes that share a prefix of L lines are one interval of
the suffix array whose longest common prefixes reach L; the interval is named by the
two overlapping ranks at the largest power of two within L.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import Workspace, fresh, join_counted

#: Blanks that part words or make up blank lines.
_BLANKS = " \t\r\f\v\u00a0"


def _lines(docs: DataFrame) -> DataFrame:
    """(d, i, at, w, h1, h2): row key, number among the non-blank lines, line number, words, line id of 128 bits."""
    cut = F.split("t", "\n", -1)
    numbered = F.filter(F.transform(cut, lambda x, n: F.struct(n.alias("at"), F.trim(x, F.lit(_BLANKS)).alias("x"))), lambda r: r["x"] != "")
    rows = docs.where("t is not null and t <> ''").select("d", F.posexplode(numbered).alias("i", "r"))
    line = F.col("r.x")
    one_blank = F.translate(line, _BLANKS, " " * len(_BLANKS))
    words = F.length(one_blank) - F.length(F.replace(one_blank, F.lit(" "), F.lit(""))) + 1
    return rows.select("d", "i", F.col("r.at").alias("at"), words.alias("w"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _ranked(keys: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """Distinct keys with numbers that rise in the order of ``columns``: range partitions, then places in them."""
    return keys.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(rank, F.monotonically_increasing_id())


def repeated_runs(docs: DataFrame, work: Workspace, min_words: int) -> DataFrame:
    """(d, low, high): the stretches of lines to delete, for documents (d, t)."""
    lines = work.keep(_lines(docs), "lines")
    often = work.keep(_ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), ["h1", "h2"], "r"), "ids")
    found = join_counted(lines, often, ["h1", "h2"]).select("d", "i", "at", "w", "r")
    # only stretches of repeated lines with enough words in all can hold a run
    by_doc = Window.partitionBy("d").orderBy("i")
    islands = found.distinct().withColumn("island", F.col("i") - F.row_number().over(by_doc))
    by_island = Window.partitionBy("d", "island")
    enough = islands.withColumn("all", F.sum("w").over(by_island)).where(F.col("all") >= min_words)
    upto = F.sum("w").over(by_island.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    active = work.keep(enough.withColumn("to", upto).withColumn("from", F.col("to") - F.col("w")).select("d", "i", "at", "island", "from", "to", "r"), "active")
    work.drop("lines", "ids")

    # the shortest stretch with enough words from each line on, and up to each line: together they cover every longer run
    ahead = by_island.orderBy("from").rangeBetween(0, min_words - 1)
    behind = by_island.orderBy("to").rangeBetween(-(min_words - 1), 0)
    here = active.select(
        "d",
        "i",
        "at",
        F.struct(F.max("i").over(ahead).alias("last"), F.max("at").over(ahead).alias("high"), (F.max("to").over(ahead) - F.col("from")).alias("words")).alias("fore"),
        F.struct(F.min("i").over(behind).alias("first"), F.min("at").over(behind).alias("low"), (F.col("to") - F.min("from").over(behind)).alias("words")).alias("aft"),
    )
    fore = here.where(F.col("fore.words") >= min_words).select("d", F.col("i").alias("s"), F.col("fore.last").alias("e"), F.col("at").alias("low"), F.col("fore.high").alias("high"))
    aft = here.where(F.col("aft.words") >= min_words).select("d", F.col("aft.first").alias("s"), F.col("i").alias("e"), F.col("aft.low").alias("low"), F.col("at").alias("high"))
    level = sum((F.when(F.col("e") - F.col("s") + 1 >= (1 << k), 1).otherwise(0) for k in range(1, min_words.bit_length())), F.lit(0))
    stretches = work.keep(fore.union(aft).distinct().withColumn("k", level), "stretches")
    deepest = stretches.agg(F.max("k")).first()[0]
    if deepest is None:
        work.drop("active")
        return stretches.select("d", "low", "high").limit(0)

    ranks, copies = active.select("d", "i", "r"), None
    for k in range(deepest + 1):
        if k:
            ranks = _doubled(ranks, 1 << (k - 1), work, k)
            work.drop(f"ranks-{k - 1}", f"pairs-{k - 1}")
        part = work.keep(_later_copies(stretches.where(F.col("k") == k), ranks, 1 << k, work, k), f"copies-{k}")
        work.drop(f"placed-{k}", f"firsts-{k}")
        copies = part if copies is None else copies.union(part)
    work.drop(f"ranks-{deepest}", f"pairs-{deepest}", "active", "stretches")
    # neighbouring and overlapping stretches become one
    order = Window.partitionBy("d").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = copies.distinct().withColumn("new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    return marked.withColumn("g", F.sum("new").over(order)).groupBy("d", "g").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("g")


def _doubled(ranks: DataFrame, step: int, work: Workspace, k: int) -> DataFrame:
    """Ranks at twice the depth, for the suffixes whose longer prefix is shared."""
    further = F.first("r").over(Window.partitionBy("d").orderBy("i").rangeBetween(step, step))
    pairs = work.keep(ranks.withColumn("r2", further).where("r2 is not null"), f"pairs-{k}")
    shared = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    shared = work.keep(_ranked(shared, ["r", "r2"], "rank"), f"shared-{k}")
    found = work.keep(join_counted(pairs, shared, ["r", "r2"]).select("d", "i", F.col("rank").alias("r")), f"ranks-{k}")
    work.drop(f"shared-{k}")
    return found


def _later_copies(stretches: DataFrame, ranks: DataFrame, depth: int, work: Workspace, k: int) -> DataFrame:
    """(d, s, e, low, high) of the stretches that repeat an earlier one without overlapping it."""
    head, tail = ranks.select("d", F.col("i").alias("s"), F.col("r").alias("head")), ranks.select("d", F.col("i").alias("t"), F.col("r").alias("tail"))
    placed = stretches.withColumn("t", F.col("e") - depth + 1).join(head, ["d", "s"]).join(tail, ["d", "t"]).withColumn("size", F.col("e") - F.col("s") + 1)
    interval = ["size", "head", "tail"]
    placed = work.keep(placed, f"placed-{k}")
    first = work.keep(placed.groupBy(interval).agg(F.min(F.struct("d", "s")).alias("first"), F.count("*").alias("n")).where("n > 1"), f"firsts-{k}")
    later: Column = (F.col("first.d") != F.col("d")) | (F.col("first.s") + F.col("size") <= F.col("s"))
    return join_counted(placed, first, interval).where(later).select("d", "s", "e", "low", "high")


def without_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted, and columns lines and lines_removed.

    A run is a stretch of lines, blank ones apart, of at least ``min_words`` words
    that stands more than once in the corpus; the copy with the least (id, text
    hash, line) stays, also where copies in one document overlap it, and the lines
    of the others go, with blank lines between deleted ones. Lines count as equal without
    blanks at their ends; words are parted by single blanks. All other lines stay as
    they are. A run that is longer than any it contains needs no search of its own:
    it is covered by its shortest parts of ``min_words`` words.

    Null texts stay null with 0 lines; empty ones have one. A null id is the least.
    Rows that repeat both id and text are one document and get the same result.
    Other columns pass through, but lines and lines_removed are replaced; ``cut_texts``
    leaves even those. An empty table gives an empty result.
    """
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    counted = docs.drop("lines", "lines_removed").withColumn("lines", F.coalesce(breaks + 1, F.lit(0)).cast("int"))
    cut, runs = cut_texts(counted, min_words, id_col, text_col)
    removed = F.aggregate(runs, F.lit(0), lambda s, r: s + r["high"] - r["low"] + 1)
    return cut.withColumn("lines_removed", F.coalesce(removed, F.lit(0))).drop(runs)


def cut_texts(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the texts of ``without_repeats`` and every other column as it was, and one more: the deleted (low, high) line runs, else null.

    The name of that column is returned; it is none that ``docs`` has.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    runs = repeated_runs(docs.select(key.alias("d"), F.col(text_col).alias("t")), work, min_words)
    own, other, row, held = fresh(docs, "line_id", "line_h", "line_row", "line_runs")
    gone = work.keep(runs.groupBy("d").agg(F.collect_list(F.struct("low", "high")).alias(held)).select(F.col("d.id").alias(own), F.col("d.h").alias(other), held), "runs")
    marked = docs.withColumn(row, F.xxhash64(text_col))
    joined = marked.join(gone.hint("shuffle_hash"), (F.col(row) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(own)), "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, n: ~F.exists(held, lambda r: n.between(r["low"], r["high"])))
    text = F.when(F.col(held).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), held), held
