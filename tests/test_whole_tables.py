"""Queries that no filter or fixed range may cut short, held against their SQL on rows that such a cut would lose."""

import pytest

from folioflow.plans.all import ORACLES, QUERIES
from tests.parity import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_number_forms_of_every_part(spark, con, tmp_path):
    keys = [-5, 0, 1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 524288, 1_099_000, 1_099_001, 12_356_630, 12_356_631, 2_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["number_forms_all"](spark, str(tmp_path))
    assert {r["k"] for r in found.collect()} == set(keys)
    letters = {r["k"]: (r["letters"], r["back"]) for r in found.collect()}
    assert letters[18279] == ("AAAA", 18278) and letters[475255] == ("AAAAA", 475254) and letters[0][0] == "0"
    con.execute(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    try:
        compare(found, con, ORACLES["number_forms_all"])
    finally:
        con.execute("DROP VIEW temp.part")


def test_markdown_of_lines_with_ampersands(spark, con, tmp_path):
    lines = ["AT&T & you", "&amp; and &#38; and &#x26;", "&amp;&lt;&copy", "a&b;c&;", "# &x1; *b*", "12. & [x]", "plain", "", "&&nbsp;;"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["escaped_markdown_all"](spark, str(tmp_path))
    escaped = {r["line_no"]: r["escaped"] for r in found.collect()}
    assert len(escaped) == len(lines)
    assert escaped[0] == "AT&T & you" and escaped[1] == r"\&amp; and \&#38; and \&#x26;" and escaped[2] == r"\&amp;\&lt;&copy" and escaped[8] == r"&\&nbsp;;"
    con.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    try:
        compare(found, con, ORACLES["escaped_markdown_all"])
    finally:
        con.execute("DROP VIEW temp.documents")


def test_ranges_reach_every_order(spark, tmp_path):
    found = QUERIES["split_ranges_all"](spark, SF)
    keys = {r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    assert {r["o_orderkey"] for r in found.collect()} == keys
    spark.createDataFrame([], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["split_ranges_all"](spark, str(tmp_path)).count() == 0
