"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, dimensions: int = 64) -> str:
    """Components as rows; a table of entries and one of assignments for each round."""
    width = dimensions // parts
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {_WHOLE} AS v, row_number() OVER () AS row FROM embeddings WHERE {_SOUND} AND len(embedding) = {dimensions})",
        f"comp AS MATERIALIZED (SELECT row, i // {width} AS p, i % {width} AS j, v[i + 1] AS x FROM kept, range({dimensions}) AS t(i))",
        f"first AS (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, j, x AS y FROM comp JOIN first USING (row))",
    ]
    for n in range(rounds + 1):
        steps.append(f"own{n} AS MATERIALIZED (SELECT row, p, best % 256 AS e, best // 256 AS d FROM (SELECT row, p, min(d * 256 + e) AS best FROM (SELECT row, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM comp JOIN book{n} USING (p, j) GROUP BY ALL) GROUP BY ALL))")
        if n < rounds:
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(m.y, b.y) AS y FROM book{n} b LEFT JOIN (SELECT p, e, j, {_FLOOR} AS y FROM comp JOIN own{n} USING (row, p) GROUP BY p, e, j) m USING (p, e, j))")
    steps += [
        f"coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM own{rounds} GROUP BY row)",
        f"spelt AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), spelt"


def centroids(k: int = 40, rounds: int = 5, dimensions: int = 64, seed: str = "2") -> str:
    """Components as rows; a table of centroids and one of assignments for each round, over all rows as they are."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS v, row_number() OVER () AS row FROM embeddings WHERE {_SOUND} AND len(embedding) = {dimensions})",
        f"comp AS MATERIALIZED (SELECT row, i AS j, v[i + 1] AS x FROM kept, range({dimensions}) AS t(i))",
        f"first AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM kept ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
        "mid0 AS MATERIALIZED (SELECT c, j, x AS y FROM comp JOIN first USING (row))",
    ]
    for n in range(rounds + 1):
        steps.append(f"own{n} AS MATERIALIZED (SELECT row, best % {k} AS c, best // {k} AS d FROM (SELECT row, min(d * {k} + c) AS best FROM (SELECT row, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM comp JOIN mid{n} USING (j) GROUP BY ALL) GROUP BY ALL))")
        if n < rounds:
            steps.append(f"mid{n + 1} AS MATERIALIZED (SELECT c, j, coalesce(m.y, b.y) AS y FROM mid{n} b LEFT JOIN (SELECT c, j, {_FLOOR} AS y FROM comp JOIN own{n} USING (row) GROUP BY c, j) m USING (c, j))")
    steps.append(f"spelt AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM mid{rounds} GROUP BY c)")
    inertia = "CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, {inertia}, centroid_sha256 FROM kept JOIN own{rounds} USING (row) JOIN spelt USING (c)"


def set_join(words: int = 4, percent: int = 85) -> str:
    """Distinct shingles as rows, sizes of intersections of documents that share one, then links followed until nothing is new."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS s FROM split WHERE w IS NOT NULL),
held AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN held x ON x.doc_id = a JOIN held y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT d.doc_id, coalesce(held.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN held USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def warc() -> str:
    """Digests as 160 bits in groups of five, written in base32; of equal payloads that of the largest page is the response."""
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 1), 4, '0')), '') AS bits FROM (SELECT DISTINCT h FROM p)),
e AS (SELECT h, payload_bytes, array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda b: CAST(substr(bits, 5 * g + b + 1, 1) AS INT) << (4 - b)))::INT, 1)), '') AS payload_digest FROM d),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t JOIN e USING (h)"""
