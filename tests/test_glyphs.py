"""Lines of glyphs and blocks of text operators on pages laid out by hand."""

from folioflow.operators import glyphs as x


def signs(text, l, baseline, size=10.0, **style):  # noqa: E741
    base = {"t": baseline - 8, "b": baseline + 2, "baseline": baseline, "size": size, "bold": False, "italic": False, "font": "F", "color": 0, "underline": False, "strike": False, "link": None}
    return [{**base, **style, "sign": c, "l": l + 5 * n, "r": l + 5 * n + 5} for n, c in enumerate(text)]


def told(glyphs):
    return [[s["text"] for s in x._spans(run)] for run in x._lines(glyphs)]


def test_lines_part_at_baselines_and_steps_back():
    page = signs("one two", 0, 20) + signs("up", 36, 17) + signs("next", 0, 20) + signs("low", 0, 40)
    assert told(page) == [["one twoup"], ["next"], ["low"]]


def test_spans_part_by_style_and_wide_gaps():
    page = signs("cell", 0, 20) + signs("other", 60, 20) + signs("bold", 85, 20, bold=True) + signs("x", 107, 20, bold=True)
    assert told(page) == [["cell", "other", "bold x"]]
    worn = signs("a", 0, 20, underline=True) + signs(" ", 5, 20) + signs("b", 10, 20, underline=True)
    assert told(worn) == [["a b"]]
    assert told(signs("   ", 0, 20)) == [[]]


def op(text, l, baseline, size=10.0):  # noqa: E741
    return {"text": text, "l": l, "r": l + 5.0 * len(text), "t": baseline - 8, "b": baseline + 2, "baseline": baseline, "size": size}


def test_operators_join_the_last_line_that_takes_them():
    got = x._op_lines([op("left", 0, 20), op("far", 200, 20), op("more", 23, 20.5), op("big", 45, 20, 20.0)])
    assert [g["text"] for g in got] == ["left more", "far", "big"]


def test_blocks(spark):
    rows = [(1, n, o["l"], o["t"], o["r"], o["b"], o["baseline"], o["size"], o["text"], 0.0, False) for n, o in enumerate([op("first line", 0, 20), op("second", 0, 32), op("beside", 100, 21), op("below it", 100, 33), op("apart", 0, 80), op(" ", 0, 92)])]
    rows = [(*r[:2], *map(float, r[2:8]), *r[8:]) for r in rows]
    rows.append((1, 9, 0.0, 0.0, 9.0, 9.0, 44.0, 10.0, "hidden", 0.0, True))
    ops = spark.createDataFrame(rows, "page int, id int, l double, t double, r double, b double, baseline double, size double, text string, angle double, invisible boolean")
    got = {r["text"]: (r["block_no"], r["line_no"]) for r in x.text_blocks(ops, ["page"]).collect()}
    assert got == {"first line": (0, 0), "beside": (1, 0), "second": (0, 1), "below it": (1, 1), "apart": (2, 0)}
    assert x.text_blocks(ops.limit(0), ["page"]).count() == 0


def test_pages_stream_through_the_folds(spark):
    seen = []

    def drawn():
        for n in range(50):
            seen.append(n)
            yield from signs("row", 0, 20 * n)

    lines = x._lines(drawn())
    assert "".join(g["sign"] for g in next(lines)) == "row" and len(seen) == 2
    seen.clear()

    def ops():
        for n in range(50):
            seen.append(n)
            yield op("word", 0, 20 * n)

    assert next(x._op_blocks(x._op_lines(ops())))["text"] == "word" and len(seen) == 2
    plan = x.lines(spark.createDataFrame([{"page": 1, "angle": 0.0, "n": 0, **signs("a", 0.0, 20.0)[0]}], "page int, n int, l double, t double, r double, b double, sign string, baseline double, angle double, size double, bold boolean, italic boolean, font string, color long, underline boolean, strike boolean, link string"), ["page"], ["n"])
    assert "collect_list" not in plan._jdf.queryExecution().toString() and [r["baseline"] for r in plan.collect()] == [20.0]
