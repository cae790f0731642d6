"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Workspace, join_counted


def _towards(pairs: DataFrame, small: bool, work: Workspace, name: str) -> DataFrame:
    """Each vertex u of (u, v) rows sends its neighbours, smaller or larger than it, to its least one."""
    sent = pairs.where("v < u" if small else "v > u")
    if small:
        least = work.keep(sent.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        linked = join_counted(sent, least, ["u"]).select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
    else:
        least = work.keep(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), name)
        linked = join_counted(sent, least, ["u"]).select(F.col("v").alias("x"), "m")
    return linked.where("x <> m").distinct()


def components(edges: DataFrame, work: Workspace, name: str, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots, the least vertices of their components.

    Only minima per vertex and semi-sorted links move: a star with very many leaves
    is pre-aggregated, and its centre, as a hot key, is broadcast to its leaves. Each
    round is written tables; rounds grow with the logarithm of the longest path.
    """
    links = work.keep(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")).where("x <> m").distinct(), f"{name}-0")
    mark = None
    for n in range(1, most_rounds):
        both = links.select(F.col("x").alias("u"), F.col("m").alias("v")).union(links.select(F.col("m").alias("u"), F.col("x").alias("v")))
        wide = work.keep(_towards(both, False, work, f"{name}-{n}-least"), f"{name}-{n}-wide")
        links = work.keep(_towards(wide.select(F.col("x").alias("u"), F.col("m").alias("v")), True, work, f"{name}-{n}-low"), f"{name}-{n}")
        work.drop(f"{name}-{n - 1}", f"{name}-{n}-least", f"{name}-{n}-wide", f"{name}-{n}-low")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)"))).first()
        if seen == mark:
            return links.select(F.col("x").alias("v"), F.col("m").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")
