"""Readers and writers hold a bounded number of texts at once."""

from folioflow.session import BATCH_ROWS
from folioflow.sinks import markdown
from folioflow.sources import plain_text


def test_a_writer_gets_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text")
        out = markdown.rendered(plain_text.as_blocks(plain_text.read_blocks(docs)))
        assert spark.conf.get(key) == str(BATCH_ROWS)
        assert {r["doc_id"]: r["markdown"] for r in out.collect()} == {n: f"text {n}\n" for n in range(3000)}
        spark.conf.set(key, "7")
        plain_text.read_blocks(docs)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
