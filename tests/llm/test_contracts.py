"""Contracts of the operators against plain Python versions, clashing columns, very long texts."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import decontaminate, language_id, line_dedup, near_dedup, packing, quality, token_count, url_filter
from folioflow.llm.shared import Workspace
from folioflow.session import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use or used for columns of their own, and names of their results.
CLASHING = ("_h", "_key", "_id", "_copies", "_verdict", "_url", "score", "lang_pred", "lines", "lines_removed", "row_key", "ROW_H", "kept_id", "kept_h", "kept_copies", "line_id", "line_h", "line_row", "Line_Runs", "id", "h", "t", "v", "d", "key", "class_id", "keep", "distance", "sig", "n")


def clashing(docs):
    return docs.select("*", *(F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(name) for name in CLASHING))


@pytest.mark.parametrize("n", range(4))
def test_stages_leave_columns_of_any_name(spark, n):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    stage = corpus_pipeline.STAGES[n][1]
    wide = stage(spark, clashing(docs), SF)
    assert wide.schema == clashing(docs).schema
    assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, stage(spark, docs, SF).collect()))
    assert all(r[name] == f"{name} {r['doc_id']}" for r in wide.collect() for name in CLASHING)


def test_pipeline_of_no_documents_and_of_repeated_ones(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    some = docs.where("doc_id % 4 = 1")
    for name, stage in corpus_pipeline.STAGES[:4]:
        once, twice = stage(spark, some, SF), stage(spark, some.union(some), SF)
        if name == "near_copies":
            assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
        elif name != "language":  # its model sees each text twice
            assert sorted(map(str, twice.collect())) == sorted(map(str, once.union(once).collect()))


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", 5, 6, 7), (2, None, 5, 6, 7)], "page_id long, url string, _verdict int, rule_verdict int, scored_url int")
    got = {r["page_id"]: r for r in url_filter.judged(pages, [("block", "com", "/en/")]).collect()}
    assert got[1]["verdict"] == "block" and got[2]["verdict"] == "allow" and all((r["_verdict"], r["rule_verdict"], r["scored_url"]) == (5, 6, 7) for r in got.values())


# ---- op7: models by hand


def _witten_bell(urls, order, alphabet=4096):
    """log2-free plain Witten-Bell: probability of a sign after a context, from (url, times)."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for url, times in urls:
        padded = "\x02" * order + url.lower() + "\x03"
        for i in range(order, len(padded)):
            for n in range(order + 1):
                seen[n][padded[i - n : i]][padded[i]] += times

    def p(context, sign):
        below = 1 / alphabet
        for n in range(order + 1):
            counts = seen[n][context[len(context) - n :]]
            total, kinds = sum(counts.values()), len(counts)
            if total + kinds:
                below = (counts[sign] + kinds * below) / (total + kinds)
        return below

    return p


def test_url_scores_and_threshold_are_those_of_plain_models(spark):
    random.seed(4)
    words = ["news", "shop", "en", "casino", "win", "blog", "x", "é"]
    urls = [f"http://{random.choice(words)}.{random.choice(['com', 'org'])}/{'bad' if random.random() < 0.3 else random.choice(words)}/{random.choice(words)}{random.randint(0, 30)}" for _ in range(400)]
    pages = spark.createDataFrame([*enumerate(urls), (-1, None), (-2, "")], "page_id long, url string")
    rules, order, lost = [("block", "com", "/bad/"), ("block", "org", "/bad/w")], 3, 0.1
    got = {r["page_id"]: r for r in url_filter.judged(pages, rules, order=order, lost=lost).collect()}
    fold = {r["url"]: r["f"] == 0 for r in pages.select("url", F.pmod(F.xxhash64("url", F.lit("calibration")), F.lit(5)).alias("f")).collect()}
    times = Counter([*urls, ""])

    def blocked(u):
        return "://" in u and (".com/bad/" in u or ".org/bad/w" in u)

    a, r = ([(u, n) for u, n in times.items() if blocked(u) is bad and not fold[u]] for bad in (False, True))
    pa, pr = _witten_bell(a, order), _witten_bell(r, order)

    def score(u):
        padded = "\x02" * order + u.lower() + "\x03"
        return sum(math.log(pa(padded[i - order : i], padded[i]) / pr(padded[i - order : i], padded[i])) for i in range(order, len(padded))) / (len(u) + 1)

    for row in got.values():
        if row["url"] is None:
            assert row["score"] is None and row["verdict"] == "allow"
        else:
            assert abs(row["score"] - score(row["url"])) < 1e-6
    held = sorted((row["score"], times[row["url"]]) for row in {row["url"]: row for row in got.values() if row["url"] is not None and fold[row["url"]] and not blocked(row["url"])}.values())
    by_model = [row for row in got.values() if row["url"] is not None and not blocked(row["url"])]
    cut = [row["score"] for row in by_model if row["verdict"] == "block"]
    kept = [row["score"] for row in by_model if row["verdict"] == "allow"]
    assert not cut or max(cut) < min(kept) and max(cut) < 0
    assert sum(n for s, n in held if cut and s <= max(cut)) <= lost * sum(n for _, n in held)


def test_rules_by_join_are_rules_by_expression(spark):
    random.seed(9)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "a", ""]
    paths = ["/", "/en/", "/en/7", "/d", "", "/en/77/x"]
    rules = [(random.choice(["allow", "block"]), h, p) for h in hosts if h for p in random.sample(paths, 3)]
    urls = [f"http://{s}{h}{p}{t}" for s in ("", "w.", "a.") for h in hosts for p in paths for t in ("", "7", "?q#z")]
    told = spark.createDataFrame([(u,) for u in [*urls, None, "none"]], "url string").withColumns(dict(zip(("host", "path"), url_filter.host_and_path("url"))))
    rule, verdict = url_filter.decided(rules)
    one = told.withColumn("r", rule).withColumn("w", verdict)
    assert sorted(map(str, one.collect())) == sorted(map(str, url_filter.decided_by_join(told, rules, "r", "w").collect()))


def test_tables_with_all_or_no_urls_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/en/{i % 3}") for i in range(30)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judged(pages, [("block", "com", "/en/")]).collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judged(pages, [("block", "org", "/en/")]).collect()} == {"allow"}


# ---- op3 and op8: models by hand


def _learnt_quality(rows=400):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(rows, len(quality.FEATURES)))
    return quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=30), rng.normal(size=(50, len(quality.FEATURES)))


def test_quality_scores_are_sums_of_table_entries():
    model, x = _learnt_quality()
    for row, score in zip(x, model.score(x)):
        total = model.intercept
        for j, value in enumerate(row):
            total += model.tables[j][sum(value >= e for e in model.edges[j])]
        for (j, k), grid in zip(model.pairs, model.grids):
            total += grid[sum(row[j] >= e for e in model.coarse[j]), sum(row[k] >= e for e in model.coarse[k])]
        assert abs(1 / (1 + math.exp(-total)) - score) < 1e-12


def test_quality_of_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(i, ("good words stand here " * (i % 7 + 1)) if i % 2 else "BUY!!! | $$$ " * (i % 5 + 1)) for i in range(200)] + [(None, "x"), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (3, 0), (None, 1), (500, 1), (5, 7), (9, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == 203 and all(0 <= r["score"] <= 1 for r in got)
    right = [(r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 200]
    assert sum(right) > 0.95 * len(right)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    constant = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, constant).collect()} == {0.5}


def test_kernel_ridge_of_all_landmarks_is_the_plain_one():
    """With every row a landmark the fit is kernel ridge in the space that the kernel spans."""
    texts = ["der hund läuft", "die katze schläft", "ein vogel fliegt", "the dog runs", "a cat sleeps", "the bird flies", "le chien court", "un chat dort"]
    langs = ["de"] * 3 + ["en"] * 3 + ["fr"] * 2
    bits = np.packbits(language_id.presence(texts).astype(bool), axis=1)
    model = language_id.fit(bits, langs, landmarks=len(texts))
    shown = language_id.presence(texts + ["the cat runs", "der vogel schläft"]).astype(float)
    unit = shown / np.sqrt(shown.sum(1, keepdims=True))
    kernel = unit @ unit[: len(texts)].T
    gram, n = kernel[: len(texts)], len(texts)
    weight = np.array([n / (3 * langs.count(x)) for x in langs])
    target = np.array([[1.0 if x == k else -1.0 for k in ("de", "en", "fr")] for x in langs])
    values = np.linalg.eigvalsh(gram)
    rank = int((values > 1e-6 * values.max()).sum())
    # centre in feature space, then solve (K W + lambda) a = y - mean
    mean = weight / weight.sum()
    goal = mean @ target
    centred = gram - mean @ gram
    centred = centred - (centred @ mean)[:, None]
    alpha = np.linalg.solve(centred * weight + 1e-2 * n / rank * np.eye(n), target - goal)
    test = kernel - mean @ gram
    test = test - (test @ mean)[:, None]
    want = (test * weight) @ alpha + goal
    got = (shown @ model.weights) / np.sqrt(shown.sum(1))[:, None] + model.bias
    assert np.allclose(got, want, atol=1e-3)
    assert model.scores(texts + ["the cat runs"])[0][-1] == "en"


def test_language_training_is_bounded_in_all(spark):
    many = spark.createDataFrame([(i, f"text of number {i}", f"l{i % 500:03d}") for i in range(3000)], "doc_id long, text string, lang string")
    model = language_id.train(many, most_rows=100)
    assert len(model.languages) == 100  # a row each
    assert len(language_id.train(many, most_rows=1600).languages) == 500  # all of them
    hot = spark.createDataFrame([(7, f"text of number {i}", "en") for i in range(400)] + [(8, "ein anderer Text", "de")], "doc_id long, text string, lang string")
    assert language_id.train(hot, most_rows=20).languages == ["de", "en"]
    one = language_id.train(spark.createDataFrame([(None, "a word", "xx"), (1, "a word", "xx"), (1, None, "xx"), (2, "b", None)], "doc_id long, text string, lang string"))
    assert one.languages == ["xx"] and one.scores(["anything"])[0] == ["xx"]


def test_quality_training_is_bounded_whatever_ids_repeat(spark):
    docs = spark.createDataFrame([(k % 3, f"some text {k} of many words " * 3) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append((len(x), len(y))) or fit(x, y)
    try:
        quality.train(docs, labels, most_rows=30)
    finally:
        quality.fit = fit
    assert seen == [(30, 30)]


def test_hot_payloads_urls_and_texts_keep_their_rows(spark):
    """A third of all rows share a payload, a url, a text and an id: the broadcast ways give what the others give."""
    from folioflow.llm import shared, warc

    pages = spark.createDataFrame([(k, f"http://h{k % 50}.com/p{k % 7}" if k % 3 else "http://hot.com/en/", "same" * 9 if k % 3 == 0 else f"body {k // 2}") for k in range(3000)] + [(None, None, "same" * 9)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(k if k % 3 else 1, "a hot text of quite some words that a third of the rows have" if k % 3 == 0 else f"text {k // 4} with number {k // 4} and {k // 4 * 7} in its few words") for k in range(1500)], "doc_id long, text string")

    def results():
        archives = Workspace(spark, "test").keep(warc.write_archives(pages), "archives")
        read = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_digest"]) for r in warc.read_archives(archives).collect())
        told = sorted((r["page_id"] or -1, r["url"] or "", r["verdict"], r["score"] or 0.0) for r in url_filter.judged(pages, [("block", "com", "/en/")]).collect())
        near = sorted(map(tuple, near_dedup.classes(docs).select("doc_id", "class_id", "keep").collect()))
        return read, told, near, sorted(map(tuple, near_dedup.one_of_each(docs).collect()))

    cold = results()
    parts = shared.join_counted.__defaults__
    try:
        shared.join_counted.__defaults__ = (1,)
        assert results() == cold
    finally:
        shared.join_counted.__defaults__ = parts
    assert len(cold[0]) == 3001 and len(cold[1]) == 3001 and len(cold[2]) == 1500


def test_language_of_the_longest_held_out_texts(spark):
    from folioflow.llm.queries import held_out, language_model

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = language_model(docs)
    longest = docs.where(held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).orderBy(F.desc(F.length("text"))).limit(100).collect()
    told, _ = model.scores([r["text"] for r in longest])
    assert sum(t == r["lang"] for t, r in zip(told, longest)) >= 97


# ---- op4: against a plain best fit and the library


def _plain_best_fit(lengths, tokens, docs, cost):
    """Longest first, each to the bin with the least weighted residual norm that holds it."""
    capacity = [tokens, docs, cost]
    need = [[n / tokens, 1 / docs, n * n / cost] for n in lengths]
    mean = [sum(d[j] for d in need) / len(need) for j in range(3)]
    weight = [m / sum(mean) for m in mean]
    bins, place = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for k, left in enumerate(bins):
            after = [a - b for a, b in zip(left, need[i])]
            if min(after) > -1e-9:
                norm = sum(w * a * a for w, a in zip(weight, after))
                if best is None or norm < best[0] - 1e-15:
                    best = norm, k
        if best is None:
            bins.append([1.0 - x for x in need[i]])
            place[i] = len(bins) - 1
        else:
            place[i] = best[1]
            bins[best[1]] = [a - b for a, b in zip(bins[best[1]], need[i])]
    return len(bins), place, capacity


@pytest.mark.parametrize(("docs", "cost"), [(1000, 1e4), (3, 1e4), (1000, 2600.0)])
def test_best_fit_fills_as_many_bins_as_the_plain_one(docs, cost):
    random.seed(5)
    lengths = [random.randint(1, 50) for _ in range(300)]
    mine, _ = packing.best_fit(np.array(lengths), 100, docs, cost)
    plain, _, _ = _plain_best_fit(lengths, 100, docs, cost)
    assert abs(len(set(mine.tolist())) - plain) <= 1  # equal norms may be taken in another order


def test_pieces_are_the_librarys_ids(spark):
    library = Tokenizer.from_file(PATH)
    random.seed(6)
    texts = [None, "", "short one", " ".join(random.choice(["alpha", "Beta", "été", "x1"]) for _ in range(900)), "<|endoftext|> inside", "Z" * 5000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "short one")], "doc_id long, text string")
    for most in (4096, 100):
        rows = packing.packed(docs, PATH, max_tokens=most, end_id=1, max_docs=7 if most == 100 else 4096).collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
        for i, text in [*enumerate(texts), (None, "short one")]:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            mine = sorted(by_doc[i], key=lambda r: r["piece"])
            assert [r["piece"] for r in mine] == list(range(-(-len(ids) // most)))
            for r in mine:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert r["start"] == r["piece"] * most and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        packed = defaultdict(list)
        for r in rows:
            packed[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in packed.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= most and (most != 100 or len(held) <= 7)


# ---- op9: ids of any type, several blocks


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_items_with_ids_of_any_type_in_several_blocks(spark, kind):
    docs = spark.createDataFrame([("a", "zero one two three four five"), (None, "seven eight nine ten"), ("c", None)], "doc_id string, text string")
    words = ["one two three", "eight nine ten", "absent text here", "two three four five", "", None]
    items = spark.createDataFrame([(n, w) for n, w in enumerate(words)] + [(None, "one two three")], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    want = sorted(map(str, [("a", "0"), ("a", "3"), ("a", "None"), ("None", "1")]))
    for chars in (1_000_000, 15):
        got = decontaminate.matches(docs, items, block_chars=chars)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
        assert sorted(str((str(r["doc_id"]), str(r["item_id"]))) for r in got.collect()) == want
    assert decontaminate.matches(docs, items.limit(0)).schema == got.schema


# ---- texts beyond a segment


def test_texts_longer_than_a_segment(spark):
    random.seed(13)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(7))
    long = "\n".join(" ".join(word() for _ in range(20)) for _ in range(8000))
    assert len(long) > 1 << 20
    item = long[(1 << 20) - 60 : (1 << 20) + 90]
    passage = "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
    near = long.replace(long[500_000:500_007], "changed", 1)
    docs = spark.createDataFrame([(1, long + "\n" + passage), (2, passage + "\n" + near), (3, "tiny")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.matches(docs, items).collect()} == {1, 2}
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    cut = {r["doc_id"]: r for r in line_dedup.without_repeats(docs).collect()}
    assert cut[1]["lines_removed"] == 0 and cut[2]["lines_removed"] > 7990 and cut[3]["text"] == "tiny"
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert counts[1] == len(library.encode(long + "\n" + passage, add_special_tokens=False).ids)
    assert sum(r["length"] for r in packing.packed(docs, PATH).collect()) == sum(counts.values()) + 3
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, _learnt_quality()[0]).collect())
    model = language_id.train(table(spark, SF, "documents"), most_rows=100, landmarks=16)
    assert language_id.predict(docs, model).count() == 3


def test_hot_keys_are_joined_like_others(spark):
    from folioflow.llm.shared import join_counted

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    counted = Workspace(spark, "hot").keep(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m")), "counted")
    got = sorted(map(tuple, join_counted(rows, counted, ["k"], least=10).select("k", "id", "m").collect()))
    assert got == sorted(map(tuple, rows.join(counted.drop("n"), "k").select("k", "id", "m").collect()))


def test_added_strings_of_any_vocabulary(tmp_path):
    from folioflow.llm.wordbpe import MergeCounter

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": max(t["id"] for t in spec["added_tokens"]) + 1_000_000, "content": "[MARK]"})
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert MergeCounter(str(path)).count("a [MARK] b") == MergeCounter(PATH).count("a  b") + 1
