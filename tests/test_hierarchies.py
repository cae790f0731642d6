"""Chains, rings, nested numbers, replays and names against plain versions."""

import random

from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import aggregates, edits
from folioflow.operators import hierarchies as h


def test_ancestors_of_a_long_chain_a_ring_and_several_parents(spark):
    parents = [(n, n - 1) for n in range(1, 1001)] + [(2000 + n, 2000 + (n + 1) % 7) for n in range(7)] + [(3000, 3001), (3000, 3002), (3001, 3003), (3002, 3003), (4000, 4000), (5000, None)]
    table = spark.createDataFrame(parents, "unit int, parent int")
    up = lambda *units: sorted(r["unit"] for r in h.with_ancestors(spark.createDataFrame([(u,) for u in units], "unit int"), table, "unit", "parent").collect())
    assert up(1000) == list(range(1001))
    assert up(2003) == list(range(2000, 2007)) and up(3000) == [3000, 3001, 3002, 3003] and up(4000, 5000, 77777, None) == [4000, 5000, 77777]
    assert up() == []


def test_styles_inherit_through_chains_rings_and_lost_parents(spark):
    rows = [("a", n, n - 1 if n else None, n if n in (0, 700) else None, None) for n in range(1000)]
    rows += [("b", n, (n + 1) % 5, 30 if n == 2 else None, "x" if n == 4 else None) for n in range(5)]
    rows += [("c", 1, 99, None, "own"), ("c", 2, 1, 5, None), (None, 1, 2, None, None), (None, 2, None, 8, None), ("d", 1, 1, None, "self")]
    got = {(r["doc"], r["style"]): (r["size"], r["font"]) for r in h.inherited(spark.createDataFrame(rows, "doc string, style int, based int, size int, font string"), ["doc"], "style", "based", ["size", "font"]).collect()}
    assert len(got) == len(rows)
    assert all(got["a", n] == (700 if n >= 700 else 0, None) for n in range(1000))
    assert all(got["b", n] == (30, "x") for n in range(5))
    assert got["c", 1] == (None, "own") and got["c", 2] == (5, "own") and got[None, 1] == (8, None) and got["d", 1] == (None, "self")
    assert h.inherited(spark.createDataFrame([], "doc string, style int, based int, size int"), ["doc"], "style", "based", ["size"]).count() == 0


def test_nested_numbers(spark):
    items = [("o", 0), ("o", 1), ("o", 1), ("o", 0), ("o", 1), ("u", 1), ("o", 1), None, ("o", 2), ("o", 0), ("o", 2), ("u", 0), ("o", 3), ("o", 2), ("o", -4)]
    want = [1, 1, 2, 2, 1, 1, 1, None, 1, 1, 1, 1, 1, 1, 1]
    rows = [("d", n, x is not None, x[1] if x else None, x[0] == "o" if x else None) for n, x in enumerate(items)] + [("e", 0, True, 0, True), ("e", 1, True, 0, True)]
    df = spark.createDataFrame(rows, "doc string, n int, listed boolean, level int, ordered boolean").orderBy(F.rand(1))
    got = {(r["doc"], r["n"]): r["number"] for r in h.nested_numbers(df, ["doc"], "n", "listed", "level", "ordered").collect()}
    assert [got["d", n] for n in range(len(items))] == want and [got["e", 0], got["e", 1]] == [1, 2]


def test_replays_keep_the_last_edits_and_an_edit_ends_redos(spark):
    r = random.Random(4)
    kinds = [r.choice(["edit", "edit", "undo", "redo", "view"]) for _ in range(400)] + ["edit"] * 30 + ["undo"] * 25 + ["redo"] * 3 + ["edit", "redo", "undo", "redo"]
    rows = [("d", n, k) for n, k in enumerate(kinds)]
    got = {x["n"]: (x["applied"], x["shown"], x["undos"], x["redos"]) for x in h.replayed(spark.createDataFrame(rows, "doc string, n int, kind string").orderBy(F.rand(1)), ["doc"], ["n"], "n", "kind").collect()}
    shown, undo, redo, want = None, [], [], {}
    for n, k in enumerate(kinds):
        done = False
        if k == "edit":
            undo, redo, shown, done = [*undo, shown][-20:], [], n, True
        elif k == "undo" and undo:
            redo.append(shown)
            shown, done = undo.pop(), True
        elif k == "redo" and redo:
            undo.append(shown)
            shown, done = redo.pop(), True
        want[n] = (done, shown, len(undo), len(redo))
    assert got == want and want[429][2] == 20 and want[454][2:] == (0, 20) and want[458][3] == 0


def test_names_are_free(spark):
    names = ["a.pdf", "a.pdf", "a (2).pdf", "a.pdf", "b", "b", "a (2).pdf", ".hidden", ".hidden", "x.tar.gz", "x.tar.gz", None]
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(names)] + [("g", 0, "a.pdf")], "folder string, n int, name string").orderBy(F.rand(1))
    there = spark.createDataFrame([("f", "b (2)"), ("f", "a (3).pdf"), ("g", "b")], "folder string, name string")
    got = {(r["folder"], r["n"]): r["unique_name"] for r in h.free_names(df, ["folder"], "name", "n", there).collect()}
    assert [got["f", n] for n in range(11)] == ["a.pdf", "a (2).pdf", "a (2) (2).pdf", "a (4).pdf", "b", "b (3)", "a (2) (3).pdf", ".hidden", ".hidden (2)", "x.tar.gz", "x.tar (2).gz"]
    assert got["g", 0] == "a.pdf" and ("f", 11) not in got
    many = h.free_names(spark.range(3000).select(F.lit(1).alias("f"), "id", F.lit("scan.pdf").alias("name")), ["f"], "name", "id")
    assert {r["unique_name"] for r in many.collect()} == {"scan.pdf", *(f"scan ({n}).pdf" for n in range(2, 3001))}


def test_old_caps_are_passed(spark):
    n = (1 << 20) + 50
    held = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.when(x == n, 1e9).otherwise(x * 1e-7)).alias("x"))
    levels = held.select(edits.indent_levels(F.col("x"), F.lit(10.0)).alias("up"), aggregates.size_clusters(F.col("x")).alias("down")).first()
    assert levels["up"][-1] == 1e9 and levels["down"][0] == 1e9 and len(levels["down"]) == 2
    label = spark.range(1).select(text.humanised(F.repeat(F.lit("a"), F.lit(n))).alias("label")).first()["label"]
    assert len(label) == n and label.startswith("Aa")


def test_imports_reuse_what_is_there(spark):
    incoming = [("f", 1, "a.pdf", "A"), ("f", 2, "a.pdf", "B"), ("f", 3, "other.pdf", "A"), ("f", 4, "a.pdf", "C"), ("f", 5, "a.pdf", "D"), ("g", 6, "x", "E"), ("g", 7, "x", "F"), ("g", 8, "x", "E"), ("f", 9, "a.pdf", "G")]
    existing = [("f", "a (2).pdf", "C"), ("f", "a (5).pdf", "C"), ("f", "b.pdf", "D"), ("g", "x", "E"), ("f", "a (25).pdf", "G")]
    files = spark.createDataFrame(incoming * 3, "folder string, n int, name string, key string").dropDuplicates(["n"])
    got = h.imported(files, spark.createDataFrame(existing, "folder string, name string, key string"), spark.createDataFrame([("B", "/old/b"), ("Z", "/old/z")], "key string, path string"), "folder", "name", "key", "n")
    assert {r["n"]: (r["path"], r["how"]) for r in got.collect()} == {
        1: ("f/a.pdf", "copied"), 2: ("/old/b", "indexed"), 3: ("f/a.pdf", "indexed"), 4: ("f/a (2).pdf", "identical"), 5: ("f/a (3).pdf", "copied"), 6: ("g/x", "identical"), 7: ("g/x (2)", "copied"), 8: ("g/x", "indexed"), 9: ("f/a (4).pdf", "copied"),
    }


def test_hot_keys_join_as_others_do(spark):
    from folioflow.operators import joins

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    hot, cold = (joins.join_hot(rows, keyed, "k", least=n) for n in (1000, 10**9))
    assert hot.count() == cold.count() == 20_000 and hot.exceptAll(cold).count() == 0
