"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.llm import (
    conversation_trie, fingerprints, license_scan, mixing, oracle, packing, piece_encoding, quality_classifier, quality_rules,
    sharding, simhash_dedup, substring_dedup, url_filter, whitening,
)
from finledger.llm._common import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


#: The rules of the url query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words that make an unlisted host a bad example for training (never a verdict of their own).
BAD_HOST_WORDS = ["spam", "pills", "adult", "casino", "porn", "xxx"]


@register("op1_quality_classifier")
def q_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    out = quality_classifier.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


@register("op2_packing")
def q_packing(spark, sf_dir):
    return packing.pack_digest(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register("op3_url_filters")
def q_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labels_from_rules(pages, URL_RULES, BAD_HOST_WORDS))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "bad_score")


@register("op4_substring_dedup", oracle.SUBSTRING_DEDUP)
def q_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op5_mixing", oracle.MIXING)
def q_mixing(spark, sf_dir):
    keyed = mixing.keyed(table(spark, sf_dir, "documents"))
    rows = written(keyed.select("doc_id", "source", "_src", "_nosrc", "_size", "_key", "_tie"), "mix-keys")
    out = mixing.copies(rows, mixing.plan_mix(rows))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                      (F.col("copies") * F.col("_size")).alias("taken"), "source")


@register("op6_license_scans")
def q_license_scans(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("places")


@register("op7_quality_rules", oracle.QUALITY_RULES)
def q_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "n_line_words")


@register("op8_simhash_dedup")
def q_simhash_dedup(spark, sf_dir):
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op9_document_fingerprints")
def q_document_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = fingerprints.with_next(docs)
    edited = fingerprints.edited_text(fingerprints.text_or_empty("text"), F.col("next_text"))
    d = fingerprints.with_sketch(d.withColumn("_edited", edited), "_edited", "edited_fingerprint")
    a, e, n = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return d.select(
        "doc_id", F.length(fingerprints.text_or_empty("text")).cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(a).alias("fingerprint"), fingerprints.as_text(e).alias("edited_fingerprint"),
        fingerprints.resemblance(a, e).alias("near_edited"), fingerprints.resemblance(a, n).alias("near_next"))


@register("op10_sharding")
def q_sharding(spark, sf_dir):
    out = sharding.deal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source", "position")


@register("op11_conversation_trie")
def q_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@register("op12_embedding_whitening")
def q_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", *whitening.ADDED)


@register("op13_piece_encoding")
def q_piece_encoding(spark, sf_dir):
    out = piece_encoding.encode(table(spark, sf_dir, "documents"), decoded="decoded", keep=["doc_id"])
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
