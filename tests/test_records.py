"""Record operators where SQL doesn't reach: loops in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import reading
from folioflow.operators import records as r


def _texts():
    random.seed(3)
    words = ["ab", "c.", "why?", "“so.”", "long" * 40, "\n", "x!", "Ünder", "-", "  ", "a_b"]
    return ["", "  ", "One. Two!\nthree", "a" * 700, "b " * 400, *(" ".join(random.choice(words) for _ in range(random.randint(1, 60))) for _ in range(40))]


def _spoken(text, most):
    out = []
    for m in re.finditer(r'[^.!?\n]+(?:[.!?]+["”’)]?|\n|$)', text):
        at, end = m.span()
        while at < end:
            to = end
            if end - at > most:
                to = text.rfind(" ", at, at + most + 1)
                to = at + most if to <= at else to
            piece = re.sub(r"\s+", " ", text[at:to]).strip()
            if re.search("[A-Za-z0-9_]", piece):
                out.append((at, to, piece))
            at = to
    return out


@pytest.mark.parametrize("most", [280, 13])
def test_spoken_pieces_are_those_of_a_loop(spark, most):
    texts = _texts()
    got = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", reading.spoken_pieces(F.col("text"), most).alias("p")).collect()
    for row in got:
        assert [(p["start"], p["end"], p["text"]) for p in row["p"]] == _spoken(texts[row["i"]], most), texts[row["i"]]


def _wrapped(text, width):
    out = []
    for para in text.split("\n"):
        if not para:
            out.append("")
            continue
        line = ""
        for word in para.split(" "):
            if line and len(line) + 1 + len(word) <= width:
                line += " " + word
                continue
            if line:
                out.append(line)
                line = word
                continue
            while len(word) > width:
                out.append(word[:width])
                word = word[width:]
            line = word
        out.append(line)
    return out


def test_lines_wrap_as_in_a_loop(spark):
    texts = _texts()
    for row in spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", reading.wrapped(F.col("text"), 9).alias("l")).collect():
        assert row["l"] == _wrapped(texts[row["i"]], 9)


def test_colours_move_until_they_can_be_read(spark):
    rows = [(0x777777, 0x777777), (0x000000, 0xFFFFFF), (0x0000FF, 0x000000), (0xFFFF00, 0xFFFFFF)]
    out = spark.createDataFrame(rows, "c long, g long").select("c", "g", reading.readable(F.col("c"), F.col("g")).alias("x"), reading.contrast(reading.luminance(F.col("c")), reading.luminance(F.col("g"))).alias("was")).collect()
    found = spark.createDataFrame([(o["x"], o["g"]) for o in out], "c long, g long").select(reading.contrast(reading.luminance(F.col("c")), reading.luminance(F.col("g"))).alias("k")).collect()
    assert all(f["k"] >= 3 for f in found) and [o["x"] for o in out if o["was"] >= 3] == [o["c"] for o in out if o["was"] >= 3]


def test_unknown_annotation_kinds_are_errors(spark):
    own = spark.createDataFrame([(1, 0, "note")], "page int, index int, type string")
    new = spark.createDataFrame([(1, 5, "bubble")], "page int, n int, type string")
    with pytest.raises(Exception, match="no such kind"):
        r.added(own, new, ["page"], "n").collect()


def test_custom_ranges(spark):
    told = ["1-3, 5, 2", "4-2", "0", "11", "a-b", " ", "2-2"]
    got = spark.createDataFrame([(x,) for x in told], "t string").select(r.custom_ranges(F.col("t"), F.lit(10).cast("long")).alias("r")).collect()
    assert [x["r"] and [tuple(y) for y in x["r"]] for x in got] == [[(1, 3), (5, 5), (2, 2)], None, None, None, None, None, [(2, 2)]]
