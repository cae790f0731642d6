"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import centroids, decontaminate, language_id, line_dedup, near_dedup, neighbours, oracles, packing, quality, set_join, token_count, url_filter, vector_codes, warc
from folioflow.llm.shared import Workspace, crc32_of
from folioflow.session import table

WORDS_49K = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"), k=5, similarity=0.8)
    return found.select("doc_id", "class_id", "keep")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Workspace(spark, "warc").keep(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0), "archives")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
    return warc.read_archives(archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_of("doc_id") % 3 == 1
    model = quality.train(docs, labels.where(~held_out), most_rows=20_000)
    picked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return quality.scored(picked, model).drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS_49K), max_tokens=4096, end_id=1)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS_49K), limit=2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs, min_words=50)


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES, order=4, lost=0.01).drop("url")


def learnt():
    """Whether a row is of the folds that languages are learnt from; a null id can't be dealt to a fold and is left out."""
    return crc32_of("doc_id") % 5 != 0


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.train(docs.where(learnt()), most_rows=6000, landmarks=256)


def held_out():
    """Whether a row is of the fold that languages are not learnt from."""
    return F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return language_id.predict(picked, language_model(docs)).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.06)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.linked_sets(table(spark, sf_dir, "documents"), k=4, percent=85)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dimensions=64, seed="2")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_vector_packing": op4_vector_packing,
    "op5_token_count": op5_token_count,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_neighbours": op10_neighbours,
    "op11_vector_codes": op11_vector_codes,
    "op12_set_join": op12_set_join,
    "op13_centroids": op13_centroids,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": oracles.warc(),
    "op11_vector_codes": oracles.vector_codes(),
    "op12_set_join": oracles.set_join(),
    "op13_centroids": oracles.centroids(),
}
