"""URL filter: host and path rules, and character language models for what no rule decides.

DataFrame functions only.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Workspace, fresh, join_counted

#: (verdict, host, path)
Rule = tuple[str, str, str]

#: Rules that one expression may hold; more are joined.
MOST_RULES = 200
_START, _END = "\u0002", "\u0003"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both are empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)), F.lit(None).cast("string"))
    return rule, verdict


def decided_by_join(told: DataFrame, rules: Sequence[Rule], rule: str, verdict: str) -> DataFrame:
    """``told`` with the columns that ``decided`` gives, for rules of any number.

    Each distinct host and path asks for its host and all its parents, and for the
    beginnings of its path of the lengths that rules of that host have, so rules are
    met by equality however many there are.
    """
    spark = told.sparkSession
    known = spark.createDataFrame([(h, p, v) for v, h, p in rules], "h string, p string, v string")
    asked = told.select("host", "path").distinct()
    parts = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = known.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))
    begun = asked.withColumn("h", F.explode(parents)).join(lengths, "h").withColumn("n", F.explode("lengths")).where(F.length("path") >= F.col("n"))
    hits = begun.withColumn("p", F.expr("substring(path, 1, n)")).join(known, ["h", "p"])
    full = F.concat("h", "p")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct(full.alias("rule"), F.col("v").alias("verdict")), F.struct(-F.length(full), full)).alias("hit"))
    joined = told.join(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "hit"), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.select(*told.columns, F.col("hit.rule").alias(rule), F.col("hit.verdict").alias(verdict))


def grams(urls: DataFrame, order: int) -> DataFrame:
    """Every character of each url with the ``order`` before it, a start mark standing in at the front."""
    padded = F.concat(F.lit(_START * order), F.lower("url"), F.lit(_END))
    cut = urls.withColumn("p", padded).select("*", F.explode(F.sequence(F.lit(1), F.length("p") - order)).alias("i"))
    return cut.withColumn("gram", F.expr(f"substring(p, i, {order + 1})")).drop("p", "i")


def log_ratios(counted: DataFrame, order: int, work: Workspace) -> DataFrame:
    """(gram, lr): log of accepted over rejected probability of a gram's last character after the others.

    ``counted`` has gram, a and r: how often each gram of ``order`` + 1 characters
    stands in accepted and rejected urls. Each model interpolates all orders by
    Witten-Bell: a context seen n times with t different followers leaves t / (n + t)
    of its weight to the context one shorter, so an unseen one counts for nothing.
    """
    total = counted.agg(F.sum("a"), F.sum("r")).first()
    lower = counted.groupBy(F.substring("gram", -1, 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    kinds = lower.agg(F.count_if(F.col("a") > 0), F.count_if(F.col("r") > 0)).first()
    uniform = F.lit(1 / 4096)

    def share(n: Column, t: Column, count: Column, below: Column) -> Column:
        return F.when(n + t > 0, (count + t * below) / (n + t)).otherwise(below)

    p = lower.select("gram", *(share(F.lit(int(total[k] or 0)), F.lit(int(kinds[k] or 0)), F.col(c), uniform).alias(f"p{c}") for k, c in enumerate("ar")))
    for n in range(2, order + 2):
        own = counted.groupBy(F.substring("gram", -n, n).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if n <= order else counted
        own = own.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        context = own.groupBy("context").agg(*(x for c in "ar" for x in (F.sum(c).alias(f"n{c}"), F.count_if(F.col(c) > 0).alias(f"t{c}"))))
        below = p.select(F.col("gram").alias("tail"), F.col("pa").alias("ba"), F.col("pr").alias("br"))
        joined = own.withColumn("tail", F.expr("substring(gram, 2)")).join(context, "context").join(below, "tail")
        p = work.keep(joined.select("gram", *(share(F.col(f"n{c}"), F.col(f"t{c}"), F.col(c), F.col(f"b{c}")).alias(f"p{c}") for c in "ar")), f"order-{n}")
    return p.select("gram", (F.log("pa") - F.log("pr")).alias("lr"))


def judged(pages: DataFrame, rules: Sequence[Rule], order: int = 4, lost: float = 0.01, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest that fits gives the verdict (of equals the first by host and path). What no rule decides is judged by two
    character models of order 0 to ``order``: one of urls that a rule blocks, one of
    all others, each url as often as it stands. score is the mean over its characters
    of the log-ratio between them, added up in whole 2 ** -32nds, so that the order of
    rows doesn't matter. One url in five, by a hash, is left out of the models. A url
    is blocked below a threshold that is 0 at most and that at most the share ``lost``
    of the left-out urls that no rule blocks fall under (in steps of a thousandth).
    Without blocked urls or without left-out ones nothing else is blocked.

    Urls are scored once however often they stand. Grams that very many urls share, and
    scores of urls that very many rows have, are broadcast, a bounded number. Null urls have no host, path, rule or score and
    are allowed; so are empty ones unless the models say otherwise. Columns of these
    names are replaced, others pass through; an empty table gives an empty result.
    """
    work = Workspace(pages.sparkSession, "url-filter")
    own = pages.drop("host", "path", "rule", "verdict", "score")
    by_rule, other = fresh(own, "rule_verdict", "scored_url")
    host, path = host_and_path(url_col)
    told = own.withColumn("host", host).withColumn("path", path)
    if len(rules) > MOST_RULES:
        told = decided_by_join(told, rules, "rule", by_rule)
    else:
        rule, verdict = decided(rules)
        told = told.withColumn("rule", rule).withColumn(by_rule, verdict)
    blocked = F.coalesce(F.col(by_rule) == "block", F.lit(False)).cast("long")
    urls = told.where(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.sum(1 - blocked).alias("a"), F.sum(blocked).alias("r"))
    urls = work.keep(urls.withColumn("held_out", F.pmod(F.xxhash64("url", F.lit("calibration")), F.lit(5)) == 0), "urls")
    spread = grams(urls, order)
    learnt = [F.sum(F.when(F.col("held_out"), 0).otherwise(F.col(c))).alias(c) for c in "ar"]
    counted = work.keep(spread.groupBy("gram").agg(*learnt, F.count("*").alias("n")), "grams")
    ratios = log_ratios(counted.select("gram", "a", "r"), order, work).withColumn("lr", F.round(F.col("lr") * (1 << 32)).cast("long"))
    ratios = work.keep(ratios.join(counted.select("gram", "n"), "gram"), "ratios")
    # sums of whole numbers are the same in any order
    scores = join_counted(spread, ratios, ["gram"]).groupBy("url").agg((F.sum("lr") / F.count("*") / float(1 << 32)).alias("score"), F.first("a").alias("a"), F.first("r").alias("r"), F.first("held_out").alias("held_out"))
    scores = work.keep(scores, "scores")
    # at most a few ten thousand steps, as a mean log-ratio is within what the smallest count allows
    steps = scores.where("a > 0 and held_out").groupBy(F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))) * 1000).alias("step")).agg(F.sum("a").alias("n")).orderBy("step").collect()
    threshold = _threshold([(r["step"] / 1000, r["n"]) for r in steps], lost)
    if not steps or not scores.where("not held_out").agg(F.max("r")).first()[0]:
        threshold = -math.inf
    counted_urls = scores.select(F.col("url").alias(other), "score", (F.col("a") + F.col("r")).alias("n"))
    out = join_counted(told.where(F.col(url_col).isNotNull()).withColumn(other, F.col(url_col)), counted_urls, [other]).drop(other)
    out = out.unionByName(told.where(F.col(url_col).isNull()).withColumn("score", F.lit(None).cast("double")))
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select(*own.columns, "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score")


def _threshold(steps: list[tuple[float, int]], lost: float) -> float:
    """The largest step at or under 0 below which at most ``lost`` of the urls lie."""
    room, under, best = lost * sum(n for _, n in steps), 0, -math.inf
    for step, n in steps:
        if step > 0 or under > room:
            break
        best, under = step, under + n
    else:
        return min(0.0, best)
    return min(0.0, step) if under <= room else best
