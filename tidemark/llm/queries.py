"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_encode
from tidemark.llm.common import WORD, ascii_lower, whole, written
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.graph_index import nearest_neighbours
from tidemark.llm.language_id import fit_languages, predict_languages
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.line_dedup import repeated_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.passage_dedup import drop_repeats
from tidemark.llm.simhash import near_dedup
from tidemark.llm.token_alignment import align_tokens, link_counts, score_links
from tidemark.llm.warc import warc_round_trip
from tidemark.llm.whitening import whiten
from tidemark.llm.window_dedup import drop_windows
from tidemark.scratch import scratch_path
from tidemark.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def language_model(docs):
    """Fitted on rows outside the held-out quarter, drawn by a hash of the text."""
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return fit_languages(learn, "text", "lang", F.xxhash64("text"))


@query
def op1_language_id(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = predict_languages(docs, "doc_id", "text", language_model(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_exact_dedup(spark, folder):
    (docs,) = load(spark, folder, "documents")
    digest = F.sha2(ascii_lower(whole(F.col("text"))), 256)
    return exact_dedup(docs, "doc_id", "text", {"text_sha256": digest})


@query
def op3_license_scans(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = scan_licenses(docs, "doc_id", "text")
    names = F.array_sort(F.array_distinct(F.col("licenses.license")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licenses")
    )


@query
def op4_suffix_array_dedup(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = drop_repeats(docs, "doc_id", "text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_simhash_near_dedup(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = near_dedup(docs, "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_warc(spark, folder):
    (pages,) = load(spark, folder, "pages")
    return warc_round_trip(pages, "page_id", "url", "html", scratch_path(spark, "warc"))


@query
def op7_line_dedup(spark, folder):
    """Per document, what line dedup takes out of it."""
    (docs,) = load(spark, folder, "documents")
    removed = repeated_lines(docs, "doc_id", "text")
    counts = removed.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count_if(F.col("edits") == 0).alias("copies"),
        F.count_if(F.col("edits") == 1).alias("near_copies"),
        F.sum(F.col("pos").cast("long") + 1).alias("places"),
    )
    lines = docs.select("doc_id", F.size(F.split(whole(F.col("text")), "\n")).cast("long").alias("n_lines"))
    found = lines.join(counts, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    numbers = [F.coalesce(name, F.lit(0)).alias(name) for name in ("copies", "near_copies", "places")]
    return found.select("doc_id", "n_lines", *numbers)


@query
def op8_bpe(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = bpe_encode(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_nearest_neighbours(spark, folder):
    (vectors,) = load(spark, folder, "embeddings")
    return nearest_neighbours(vectors, "vec_id", "embedding")


def words(text):
    """Number of words of a text; a null text has none."""
    return F.regexp_count(whole(text), F.lit(WORD))


def quality_of(docs, labels):
    """Weights from the labels: good documents 2, bad ones 1/2, documents without a label 1."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    return docs.join(known, "doc_id", "left").withColumn(
        "_weight", F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    )


@query
def op10_mix_sources(spark, folder):
    docs, labels = load(spark, folder, "documents", "labels")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    mixed = mix_sources(quality_of(sized, labels), "doc_id", "source", F.col("size"), F.col("_weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_embedding_whitening(spark, folder):
    (vectors,) = load(spark, folder, "embeddings")
    return whiten(vectors, "vec_id", "embedding")


@query
def op13_substring_dedup(spark, folder):
    (docs,) = load(spark, folder, "documents")
    found = drop_windows(docs, "doc_id", "text")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_token_alignment(spark, folder):
    (docs,) = load(spark, folder, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_tokens(docs, "doc_id", "text", *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "links", "times")
    # the number, written with the rows, tells apart those that repeat a key
    aligned = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    scored = score_links(aligned, "_row", written(link_counts(aligned), "scored-links"))
    found = aligned.drop("links", "times").join(scored, "_row", "left")
    sums = [F.coalesce(name, F.lit(0)).alias(name) for name in ("n_links", "n_best", "count_sum")]
    return found.select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")
