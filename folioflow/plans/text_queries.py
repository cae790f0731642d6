"""Queries over text functions and predicates (documents, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators.windows import document_lines
from folioflow.plans.registry import query
from folioflow.session import table

LINES = "lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("normalised_lines", rf"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_replace(regexp_replace(lower({TRIM.format('line')}), '[0-9]', '#', 'g'), '\s+', ' ', 'g') AS margin_form, regexp_replace(line, '\s+', ' ', 'g') AS collapsed FROM lines")
def normalised_lines(spark, sf_dir):
    """F1, F2."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", t.margin_text(F.col("line")).alias("margin_form"), t.collapse(F.col("line")).alias("collapsed"))


@query(
    "page_number_lines",
    rf"""WITH {LINES}, p AS (SELECT doc_id, line_no, unnest([line, CAST(line_no + 1 AS VARCHAR), '- ' || (line_no + 1) || ' -', 'Page ' || (line_no + 1) || ' of 20', (line_no + 1) || ' / 30', 'p. ' || (line_no + 1), ['iv', 'XII', 'Mixed', 'I am'][line_no % 4 + 1]]) AS line FROM lines),
q AS (SELECT doc_id, line_no, line, regexp_replace({TRIM.format('line')}, '\s+', ' ', 'g') AS t FROM p),
r AS (SELECT *, regexp_replace(t, '^[\s\-–—|]+|[\s\-–—|]+$', '', 'g') AS core FROM q)
SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM r WHERE t <> '' AND (regexp_matches(t, '^[\s\-–—|]*\d{{1,4}}[\s\-–—|]*$') OR regexp_matches(t, '(?i)^(page|p\.|pg\.?)\s*\d{{1,4}}(\s*(of|/)\s*\d{{1,4}})?$') OR regexp_matches(t, '(?i)^\d{{1,4}}\s*(of|/)\s*\d{{1,4}}$')
OR (core <> '' AND length(core) <= 7 AND (core = lower(core) OR core = upper(core)) AND regexp_matches(lower(core), '^m{{0,4}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$')))""",
)
def page_number_lines(spark, sf_dir):
    """P2, over each line and six forms made from its number."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    n = (F.col("line_no") + 1).cast("string")
    word = F.element_at(F.array(*(F.lit(x) for x in ("iv", "XII", "Mixed", "I am"))), F.col("line_no") % 4 + 1)
    forms = F.array("line", n, F.concat(F.lit("- "), n, F.lit(" -")), F.concat(F.lit("Page "), n, F.lit(" of 20")), F.concat(n, F.lit(" / 30")), F.concat(F.lit("p. "), n), word)
    return lines.select("doc_id", "line_no", F.explode(forms).alias("line")).where(t.is_page_number(F.col("line")))


@query("sentence_ends", rf"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_matches(regexp_replace(line, '\s+$', ''), '[.!?:;…][\"''”’)\]]*$') AS ends_sentence, regexp_matches(line, '^[\s\"“‘(\[]*\p{{Ll}}') AS starts_lower FROM lines")
def sentence_ends(spark, sf_dir):
    """P13."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", t.ends_sentence(F.col("line")).alias("ends_sentence"), t.starts_lower(F.col("line")).alias("starts_lower"))


@query(
    "list_markers",
    rf"""WITH {LINES}, p AS (SELECT doc_id, line_no, unnest([line, '• ' || line, '- ' || line, (line_no % 50) || '. ' || line, '(b) ' || line, 'iv) ' || line]) AS line FROM lines),
m AS (SELECT *, coalesce(nullif(regexp_extract(line, '^\s*([•◦▪▫‣●○■□►▸▹➢➤✓✔·])\s*\S', 1), ''), nullif(regexp_extract(line, '^\s*([\-–—*])\s+\S', 1), ''), nullif(regexp_extract(line, '^\s*((?:\d{{1,3}}|[a-zA-Z]|[ivxlcdm]{{2,6}}|[IVXLCDM]{{2,6}})[.)]|\((?:\d{{1,3}}|[a-zA-Z]|[ivxlcdm]{{2,6}}|[IVXLCDM]{{2,6}})\))\s+\S', 1), '')) AS marker,
regexp_matches(line, '^\s*(\d+(\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+\S') AS numbered_heading, regexp_matches(line, '(?i)^\s*((figure|table)([^a-z]|$)|fig\.)') AS caption FROM p)
SELECT doc_id, CAST(line_no AS INT) AS line_no, marker, numbered_heading, caption, count(*) AS n FROM m GROUP BY ALL""",
)
def list_markers(spark, sf_dir):
    """F5, F6, over each line bare and behind five markers."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    line = F.col("line")
    forms = F.array(line, *(F.concat(m, line) for m in (F.lit("• "), F.lit("- "), F.concat((F.col("line_no") % 50).cast("string"), F.lit(". ")), F.lit("(b) "), F.lit("iv) "))))
    shown = lines.select("doc_id", "line_no", F.explode(forms).alias("line"))
    shown = shown.select("doc_id", "line_no", t.list_marker(line).alias("marker"), line.rlike(t.NUMBERED_HEADING).alias("numbered_heading"), line.rlike(t.CAPTION).alias("caption"))
    return shown.groupBy("doc_id", "line_no", "marker", "numbered_heading", "caption").agg(F.count("*").alias("n"))


@query(
    "dehyphenated",
    r"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, ' of ', '-' || chr(10)), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\x{AD}\n', '', 'g'), '(\p{L})[-‐]\n([\"“‘(\[]*\p{Ll})', '\1\2', 'g'), '(\p{L})[-‐]\n([\"“‘(\[]*\p{Ll})', '\1\2', 'g'), '(\p{L}[-‐])\n', '\1', 'g'), '\n', ' ', 'g') AS joined FROM l""",
)
def dehyphenated(spark, sf_dir):
    """`` of `` stands in for hyphenated line ends, which the texts lack. The SQL joins twice, as one pass takes the letter between two ends."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", t.joined_lines(F.replace("text", F.lit(" of "), F.lit("-\n"))).alias("joined"))


def _escaped(column: str, apostrophe: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", apostrophe)):
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query("escaped_html", f"SELECT page_id, {_escaped('html', '&#39;')} AS html_escaped, {_escaped('html', '&apos;')} AS xml_escaped FROM pages WHERE html IS NOT NULL")
def escaped_html(spark, sf_dir):
    """F11, F12, F13."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    return pages.select("page_id", t.html_escape(F.col("html")).alias("html_escaped"), t.xml_escape(F.col("html")).alias("xml_escaped"))


@query("html_text", f"SELECT doc_id, replace(replace({_escaped('replace(text, chr(13) || chr(10), chr(10))', '&#39;')}, chr(10), '<br>' || chr(10)), chr(9), '&emsp;') AS html FROM documents WHERE text IS NOT NULL")
def html_text(spark, sf_dir):
    """F13 with line breaks."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.html_text(F.col("text")).alias("html"))


ESCAPED_MARKDOWN = rf"""WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_replace(regexp_replace(line, '([\\`*_\[\]<>~|])', '\\\1', 'g'), '&((#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)', '\\&\1', 'g') AS escaped,
CASE WHEN regexp_matches(line, '^[#>=+\-|]') THEN '\' || line ELSE regexp_replace(line, '^(\d{{1,9}})([.)])', '\1\\\2') END AS line_start FROM lines"""


@query("escaped_markdown", ESCAPED_MARKDOWN)
@query("escaped_markdown_all", ESCAPED_MARKDOWN)
def escaped_markdown(spark, sf_dir):
    """F15 for every line, with the rule for entities."""
    lines = document_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", t.markdown_escape(F.col("line"), pipes=True).alias("escaped"), t.markdown_line_start(F.col("line")).alias("line_start"))


@query(
    "safe_links",
    rf"""WITH p AS (SELECT page_id, unnest([url, ' ' || url, 'javascript:alert(1)', 'mailto:a@b.c', '/relative', 'data:' || url, '']) AS link FROM pages), q AS (SELECT page_id, link, nullif({TRIM.format('link')}, '') AS l FROM p)
SELECT page_id, link, CASE WHEN lower(regexp_extract(l, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto', 'tel', 'ftp') THEN l END AS href FROM q""",
)
def safe_links(spark, sf_dir):
    """F14."""
    url = F.col("url")
    forms = F.array(url, F.concat(F.lit(" "), url), F.lit("javascript:alert(1)"), F.lit("mailto:a@b.c"), F.lit("/relative"), F.concat(F.lit("data:"), url), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("link")).withColumn("href", t.safe_href(F.col("link")))


@query(
    "search_hits",
    r"""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS hits, CAST(len(regexp_extract_all(text, '(?i)\bthe\b')) AS BIGINT) AS words FROM documents WHERE contains(lower(text), 'the')""",
)
def search_hits(spark, sf_dir):
    """P11, P12."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return docs.select("doc_id", t.substring_count(F.col("text"), "the").alias("hits"), t.whole_word_count(F.col("text"), "the").alias("words"))


@query("redacted_by_search", r"SELECT doc_id, regexp_replace(text, '[\w.]+@[\w.]+', '█', 'g') AS masked, CAST(len(regexp_extract_all(text, '[\w.]+@[\w.]+')) AS BIGINT) AS n FROM documents WHERE contains(text, '@')")
def redacted_by_search(spark, sf_dir):
    """Search matches masked and counted."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.regexp_replace("text", r"[\w.]+@[\w.]+", "█").alias("masked"), F.regexp_count("text", F.lit(r"[\w.]+@[\w.]+")).cast("long").alias("n"))


@query("sentence_split", r"""SELECT doc_id, count(*) AS sentences, CAST(max(length(s)) AS BIGINT) AS longest, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+[\"”’)]?|\n|$)')), '\s+', ' ', 'g'), '^ | $', '', 'g') AS s FROM documents) WHERE regexp_matches(s, '[A-Za-z0-9_]') GROUP BY doc_id""")
def sentence_split(spark, sf_dir):
    """F8, sentences without the length cap."""
    found = F.regexp_extract_all("text", F.lit(r'[^.!?\n]+(?:[.!?]+["”’)]?|\n|$)'), F.lit(0))
    # sums in the row, without a row a sentence
    sizes = F.transform(F.filter(F.transform(found, lambda s: F.regexp_replace(t.collapse(s), "^ | $", "")), lambda s: s.rlike("[A-Za-z0-9_]")), F.length)
    docs = table(spark, sf_dir, "documents").select("doc_id", sizes.alias("sizes")).where("size(sizes) > 0")
    docs = docs.select("doc_id", F.size("sizes").cast("long").alias("n"), F.array_max("sizes").cast("long").alias("most"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    return docs.groupBy("doc_id").agg(F.sum("n").alias("sentences"), F.max("most").alias("longest"), F.sum("all").alias("chars"))


@query("pages_with_text", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) > 20 AS has_text, regexp_matches(text, '\p{L}') AS has_letter FROM documents")
def pages_with_text(spark, sf_dir):
    """P15."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.length(F.regexp_replace("text", t.WS, "")) > 20).alias("has_text"), F.col("text").rlike(r"\p{L}").alias("has_letter"))


@query(
    "names_cleaned",
    r"""WITH n AS (SELECT p_partkey, unnest([p_name, p_brand || '/' || p_type || ':*?.pdf', 'form1.' || lower(p_brand) || '_' || 'zip-code', 'emailAddress', replace(p_type, ' ', '_'), ' ']) AS raw FROM part),
h AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS name FROM n),
w AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(name, '([^.]+)\.*$', 1), ''), name), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s]+', ' ', 'g'), '^ | $', '', 'g')) AS words FROM h)
SELECT p_partkey, raw, coalesce(nullif(regexp_replace(regexp_replace(raw, '[\\/:*?"<>|]', '_', 'g'), '^\s+|\s+$', '', 'g'), ''), 'Untitled') AS file_name,
substr(coalesce(nullif(regexp_replace(regexp_replace(raw, '[\[\]*?/\\:]', ' ', 'g'), '^\s+|\s+$', '', 'g'), ''), 'Sheet'), 1, 31) AS sheet_name,
CASE WHEN name = '' OR contains(name, ' ') OR words = '' THEN name ELSE upper(substr(words, 1, 1)) || substr(words, 2) END AS label FROM w""",
)
def names_cleaned(spark, sf_dir):
    """F18, F19, F21 without uniqueness."""
    part = table(spark, sf_dir, "part")
    forms = F.array("p_name", F.concat("p_brand", F.lit("/"), "p_type", F.lit(":*?.pdf")), F.concat(F.lit("form1."), F.lower("p_brand"), F.lit("_zip-code")), F.lit("emailAddress"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" "))
    raw = F.col("raw")
    return part.select("p_partkey", F.explode(forms).alias("raw")).select("p_partkey", "raw", t.file_name(raw).alias("file_name"), t.sheet_name(raw).alias("sheet_name"), t.humanised(raw).alias("label"))


@query("linked_text", r"SELECT page_id, CASE WHEN url = '' OR regexp_replace(x, '^\s+|\s+$', '', 'g') = url OR regexp_replace(x, '^\s+|\s+$', '', 'g') = regexp_replace(url, '^(mailto:|https?://)', '') THEN x ELSE x || ' (' || url || ')' END AS shown FROM (SELECT page_id, url, unnest([url, regexp_replace(url, '^https?://', ''), 'here']) AS x FROM pages)")
def linked_text(spark, sf_dir):
    """F23."""
    forms = F.array("url", F.regexp_replace("url", "^https?://", ""), F.lit("here"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(forms).alias("x")).select("page_id", t.linked_text(F.col("x"), F.col("url")).alias("shown"))
