"""What pages tell of their document is what the joins over its lines tell; lines of small pages are formed once a text."""

import random

from pyspark.sql import functions as F

from folioflow.operators import layout as x
from folioflow.operators import page_lines
from folioflow.plans import document_queries as q

FIELDS = "doc_id long, page int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean"


def test_pages_tell_the_statistics_of_lines(spark):
    r, rows = random.Random(3), []
    for doc in range(12):
        for page in range(r.randint(1, 4)):
            for line in range(r.randint(1, 14)):
                y, x0 = r.choice([12.0, 14.0, 7.3]) * line, r.choice([0.0, 20.0, 300.0])
                for span in range(r.choice([1, 1, 1, 2, 3])):
                    size, text = r.choice([10.0, 10.0, 10.0, 10.4, 14.0, 20.0]), r.choice(["some words", "12", " ", "Title", "a-b ", "word " * 60])
                    rows.append((doc, page, line, span, text, x0, y, x0 + 100.0, y + size, size, False, False))
                    x0 += r.choice([100.0, 101.0, 120.0])
    spans = spark.createDataFrame(rows, FIELDS)
    pages = spans.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(160.0)})
    body = page_lines.body_sizes(spans)
    gone = page_lines.margin_lines(page_lines.lines_of(spans), pages, body).where("margin")
    names = FIELDS.replace(",", "").split()[4::2]
    shown = lambda df: {r["doc_id"]: [r[c] for c in ("body", "pitch", "headings", "text_left", "text_right")] for r in df.collect()}
    for given, left_out in ((None, None), (pages, gone)):
        held = x._pages(spans, names, "doc_id", None, given, left_out)
        assert shown(page_lines.page_statistics(held, body)) == shown(x.document_sizes(spans, pages=given))


def test_a_page_of_images_alone_keeps_them_beside_pages_with_sizes(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, "text", 0.0, 0.0, 50.0, 10.0, 10.0, False, False)], FIELDS)
    images = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, image_no long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(3)], "doc_id long, page int, width double, height double")
    got = x.analysed(spans, images=images, pages=pages).orderBy("page").collect()
    assert [(r["page"], r["kind"], r["image_no"]) for r in got] == [(0, "paragraph", None), (1, "image", 7)]


def test_lines_of_small_pages_are_formed_once(spark, tmp_path):
    spark.createDataFrame([(1, " one  two\nthree four five six seven eight nine "), (2, " \n"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shown = q._small_pages(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["line_no"], r["text"]) for r in shown.collect()) == [(1, 0, "one two three four five six seven eight"), (1, 1, "nine")]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
