"""The operators on Spark: brute force, held-out accuracy and odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, language_id, line_dedup, near_dedup, neighbours, packing, quality, queries, token_count, url_filter, warc
from folioflow.session import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, extra string, lines string, score string, h string, n string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "e", "l", "s", "h", "n", "k") for i, t in rows], DOCS)


ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (None, None), (None, ""), (2, ""), (3, "123 !!"), (4, None), (None, "One, two three four five six"), (5, "x " * 3000)]


def test_odd_rows_pass_every_document_operator(spark):
    docs = frame(spark, ROWS)
    counted = token_count.token_counts(docs, PATH).collect()
    assert len(counted) == 9 and sum(r["n_tokens"] for r in counted) == 6 * 2 + 6 + 1 + 3000 + 3 + 1
    packed = packing.packed(docs, PATH).collect()
    assert sum(r["length"] for r in packed) == sum(r["n_tokens"] for r in counted) + 9
    found = near_dedup.classes(docs).collect()
    assert len(found) == 9 and len({r["class_id"] for r in found if r["doc_id"] == 1}) == 1
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == 4
    cut = line_dedup.without_repeats(docs, min_words=3)
    assert cut.count() == 9 and cut.columns == [*[c for c in docs.columns if c != "lines"], "lines", "lines_removed"]
    model = language_id.train(table(spark, SF, "documents"), most_rows=200, landmarks=32)
    told = language_id.predict(docs, model).collect()
    assert [r["lang_pred"] for r in told if r["text"] in (None, "", "123 !!")] == ["und"] * 5
    scored = quality.scored(docs, quality.fit(np.empty((0, 18)), np.empty(0))).collect()
    assert len(scored) == 9 and all(0 <= r["score"] <= 1 for r in scored)
    items = spark.createDataFrame([(7, "two three four"), (8, None), (9, "!!"), (None, "three four five six")], "item_id long, text string")
    hits = decontaminate.matches(docs, items).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in hits) == sorted([("1", "7"), ("1", "7"), ("None", "7"), ("1", "None"), ("1", "None"), ("None", "None")])
    assert decontaminate.clean_documents(docs, items).count() == 6


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert token_count.token_counts(docs, PATH).count() == 0
    assert packing.packed(docs, PATH).count() == 0
    assert near_dedup.classes(docs).count() == 0
    assert near_dedup.one_of_each(docs).count() == 0
    assert line_dedup.without_repeats(docs).count() == 0
    assert language_id.predict(docs, language_id.train(docs.withColumn("lang", F.lit("en")))).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0
    assert url_filter.judged(pages, queries.URL_RULES).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(vectors, vectors).count() == 0


def _family(seed, copies, edits):
    random.seed(seed)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(100)]
    out = []
    for _ in range(copies):
        words = base[:]
        for i in random.sample(range(100), random.randint(0, edits)):
            words[i] = f"x{random.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_near_copies_are_those_of_brute_force(spark, block_rows):
    texts = [t for s in range(6) for t in _family(s, 9, 4)] + ["lone text of its own here", "", "  "]
    x = [near_dedup.shingles(t, 5) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        return i if top[i] == i else root(top[i])

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or near_dedup.aligned(x[i], x[j], 0.8):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    found = near_dedup.classes(frame(spark, enumerate(texts)), block_rows=block_rows).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: root(i) for i in range(len(texts))}
    assert sum(r["keep"] for r in found) == len({root(i) for i in range(len(texts))})


def _without_repeats(docs, least):
    """Every stretch of every document, longest included, against every earlier one."""
    seqs = [(i, [(n, x.strip(" ")) for n, x in enumerate(t.split("\n")) if x.strip(" ")]) for i, t in sorted(docs)]
    first, gone = {}, {i: set() for i, _ in docs}
    for i, seq in seqs:
        for a in range(len(seq)):
            for b in range(a, len(seq)):
                stretch = tuple(x for _, x in seq[a : b + 1])
                if sum(len(x.split(" ")) for x in stretch) < least:
                    continue
                doc, at = first.setdefault(stretch, (i, a))
                if doc != i or at + len(stretch) <= a:
                    gone[i] |= {n for n, _ in seq[a : b + 1]}
        for (n, _), (m, _) in zip(seq, seq[1:]):  # blank lines between deleted ones
            if {n, m} <= gone[i]:
                gone[i] |= set(range(n, m))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in docs}


def test_line_runs_are_those_of_brute_force(spark):
    random.seed(11)
    pool = [" ".join(random.choice("ab") for _ in range(random.randint(1, 4))) for _ in range(9)]
    docs = [(i, "\n".join(random.choice([*pool, ""]) for _ in range(random.randint(1, 14)))) for i in range(40)]
    docs.append((40, "\n".join(["z z z"] * 12)))
    for least in (4, 7, 12):
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()}
        assert got == _without_repeats(docs, least)


def test_archives_hold_every_page(spark):
    rows = [(5, "http://a/", "same"), (9, "u\r\nv", "same"), (9, "u\r\nv", "same"), (9, "a", "same"), (7, None, "same"), (1, "x", ""), (2, "x", None), (3, "y", "é" * 100), (None, "z", "same"), (None, "z", "lone"), (3, "y", "z" * 9)]
    pages = spark.createDataFrame([(*r, "h", "r", 1) for r in rows], "page_id long, url string, html string, sha string, refers string, copy int")
    same, empty = warc.digest(b"same"), warc.digest(b"")
    page = lambda r: r.split(":")[2] if r else None
    for least in (0, 5):
        got = warc.read_archives(warc.write_archives(pages, min_bytes=least)).collect()
        assert len({r["record_id"] for r in got}) == len(rows)
        told = sorted((page(r["record_id"]).rstrip(">"), r["record_type"], page(r["refers_to"]), r["payload_bytes"], r["payload_digest"]) for r in got)
        want = [("3", "response", None, 200, warc.digest(("é" * 100).encode())), ("3", "response", None, 9, warc.digest(b"z" * 9)), ("None", "response", None, 4, warc.digest(b"lone"))]
        if least:
            want += [(i, "response", None, 4, same) for i in ("5", "9", "9", "9", "7", "None")] + [(i, "response", None, 0, empty) for i in "12"]
        else:
            want += [(i, "revisit", "9", 4, same) for i in ("5", "9", "9", "7", "None")] + [("9", "response", None, 4, same), ("2", "response", None, 0, empty), ("1", "revisit", "2", 0, empty)]
        assert sorted(map(str, told)) == sorted(map(str, want))
        responses = {r["record_id"]: r["payload_digest"] for r in got if r["record_type"] == "response"}
        assert all(responses[r["refers_to"]] == r["payload_digest"] for r in got if r["record_type"] == "revisit")


def test_nearest_neighbours_leave_out_unusable_vectors(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0] * 7), (303, [None] + [1.0] * 7), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(i, rows[1][1]) for i in range(400, 420)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks, groups in ((20_000, 4096), (16, 3)):
        got = neighbours.search(vectors, vectors.where("vec_id % 50 = 0 or vec_id in (1, 301)"), k=10, centroids=4, scanned=1.0, block_rows=blocks, block_queries=groups).collect()
        x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and (i < 300 or i >= 400)}
        for q in {i for i in x if i % 50 == 0 or i == 1}:
            want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
            mine = [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert [m[1] for m in mine] == [w[1] for w in want] and np.allclose([m[0] for m in mine], [w[0] for w in want], rtol=1e-12)
        assert not [r for r in got if r["query_id"] == 301]


def test_recall_on_the_table(spark):
    got = queries.op10_neighbours(spark, "/root/testdata/sf0.1").collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()}
    ids, x = np.array([*rows]), np.stack([*rows.values()])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert hits / total >= 0.9


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7x?y#z", "https://example.com/en/1", "ftp://x.org/es/", "nothing", None, "http://example.net/de/8#a", "http://xnet/de/8", "http://net/de/", "://", "http://Ünï.COM/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("x.org", "/es/", "org/es/", "block")
    assert got[3][:3] == ("", "", None) and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2] is None and got[7][2:] == ("net/de/", "allow")
    assert got[8][:3] == ("", "", None) and got[9][:3] == ("Ünï.com", "/en/", "com/en/")


def test_url_rules_are_those_of_the_contract():
    assert {h + p: v for v, h, p in queries.URL_RULES} == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    told = queries.op8_language_id(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    scored = queries.op3_quality(spark, sf).where("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_pipeline_keeps_clean_documents_once(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = kept.collect()
    assert len({r["text"] for r in left}) == len(left) and all(r["n_chars"] == len(r["text"]) for r in left)
    items = [decontaminate.plain(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert not [r for r in left if any(i in decontaminate.plain(r["text"]) for i in items)]
    assert len(left) > 0.7 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in left}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


@pytest.mark.parametrize("languages", [["de", "en"], ["de", "en", "fr"], ["de", "en", "es", "fr"]])
def test_pipeline_rejects_texts_in_no_learned_language(spark, languages):
    import corpus_pipeline

    foreign = ["Καλημέρα κόσμε, τι κάνεις σήμερα το πρωί", "Привет мир, как дела сегодня утром в городе", "今日はとても良い天気ですね 明日も晴れるでしょう", "xqz vkjw qqzx wvkx zzkq jxqv kwzz", "Hyvää huomenta kaikille, miten teillä menee tänään", "123 !!"]
    docs = table(spark, "/root/testdata/sf0.01", "documents").where(F.col("lang").isin(languages) & F.col("text").rlike("[a-z]{2}"))
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    kept = corpus_pipeline.language(spark, docs.unionByName(strange, allowMissingColumns=True), "/root/testdata/sf0.01")
    assert kept.where("doc_id < 0").count() == 0
    assert kept.count() >= 0.995 * docs.count()


def test_what_is_usual_and_least_familiar_is_counted_over_all_rows(spark):
    """More rows than a sample would take, one of them with signs that no other has."""
    texts = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {'uvwxyz'[i % 6]}" for i in range(8000)] + ["ñandú", "42", None]
    langs = [("xx", "yy")[i % 7 == 0] for i in range(len(texts))]
    docs = spark.createDataFrame([*((i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))), (-1, "aa", None)], "doc_id long, text string, lang string")
    found = language_id.usual(docs.repartition(5))
    shown, of = language_id.presence(texts[:-1]), np.array(langs[:-1])
    want = np.stack([np.log((shown[of == lang].sum(0) + 0.5) / ((of == lang).sum() + 1)) for lang in ("xx", "yy")], 1)
    assert found.languages == ["xx", "yy"] and np.allclose(found.shares, want, atol=1e-6)
    scores = found.familiarity(texts)
    scores = scores[np.isfinite(scores)]
    for lost in (0.0, 0.0005, 0.3):
        low, middle = np.quantile(scores, lost, method="lower"), np.median(scores)
        assert abs(language_id.least_familiarity(docs.repartition(5), found, lost) - (low - (middle - low) / 4)) < 2 / language_id.STEPS
    none = docs.where("text = '42'")
    assert language_id.usual(docs.limit(0)).languages == [] and language_id.least_familiarity(none, found, 0.1) < -1e300


def test_language_stage_learns_from_all_rows_whatever_their_ids(spark):
    """Rows without an id, and a language whose rows are all of one fold, were learnt from by none."""
    import zlib

    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents").where(F.col("lang").isin("de", "en") & F.col("text").rlike("[a-z]{2}"))
    nameless = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    assert corpus_pipeline.language(spark, nameless, SF).count() >= 0.995 * docs.count()
    words = ["Καλημέρα", "κόσμε", "σήμερα", "πρωί", "θάλασσα", "ουρανός", "βιβλίο"]
    fold = [i for i in range(10**6, 10**6 + 1000) if zlib.crc32(str(i).encode()) % 5 == 0][:40]
    greek = spark.createDataFrame([(i, " ".join(words[(n + k) % 7] for k in range(2 + n % 5)), "el") for n, i in enumerate(fold)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs.unionByName(greek, allowMissingColumns=True), SF)
    assert kept.where("lang = 'el'").count() == 40 and kept.count() >= 0.995 * docs.count()


def test_familiarity_by_all_other_rows(spark):
    """Each text as if the counts were made without it, also where it is the only one of its language."""
    words = ["rot", "rosa", "blau", "red", "rose", "blue", "42", "ñandú"]
    texts = [f"{words[i % 6]} {words[i % 5]}" for i in range(30)] + words[6:] + [""]
    langs = [("de", "en")[i % 6 > 2] for i in range(30)] + ["en", "es", "de"]
    docs = spark.createDataFrame([(None, t, lang) for t, lang in zip(texts, langs)], "doc_id long, text string, lang string")
    found, want = language_id.usual(docs), []
    for i in range(len(texts)):
        rest = [n for n in range(len(texts)) if n != i]
        shown, of = language_id.presence([texts[n] for n in rest]), np.array([langs[n] for n in rest])
        shares = np.stack([np.log((shown[of == lang].sum(0) + 0.5) / ((of == lang).sum() + 1)) for lang in sorted(set(of))], 1)
        own = language_id.presence([texts[i]])[0]
        want.append((own @ shares).max() / own.sum() if own.any() else -np.inf)
    got = found.familiarity(texts, langs)
    assert np.allclose(got, want, atol=1e-4) and np.isinf(got[[30, 32]]).all()
    scores = np.array(want)[np.isfinite(want)]
    low, middle = np.quantile(scores, 0.1, method="lower"), np.median(scores)
    assert abs(language_id.least_familiarity(docs.repartition(3), found, 0.1, learnt=True) - (low - (middle - low) / 4)) < 2 / language_id.STEPS
    lone = docs.where("lang = 'es'")
    assert np.isinf(language_id.usual(lone).familiarity(["ñandú"], ["es"])).all()
    assert language_id.least_familiarity(lone, language_id.usual(lone), 0.1, learnt=True) < -1e300
