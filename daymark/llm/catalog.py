"""Registered queries of the text operators: name -> (Spark builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.llm import (
    byte_bpe, decontaminate, drift_clusters, html_text, lattice_lm, line_rules, mixing, pii,
    prefix_trie, shards, simhash, sql, toxicity, url_filter)
from daymark.llm.words import crc_remainder, table

SHARD_BYTES = 1 << 20
#: The tokenizer file of the language model; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The ranks file of the byte-level tokenizer, in the installed collection of tokenizers.
BYTE_RANKS = "byte_bpe_50k.tiktoken"
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SCALE = 16, 3, 64
RULES = [
    url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"), url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    sample = toxicity.labelled_texts(docs.filter(~held_out),
                                     table(spark, sf_dir, "labels").filter(~held_out))
    out = toxicity.score(docs, toxicity.train(sample))
    return out.select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.size("bad_starts").cast("bigint").alias("n_offending"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict",
                      F.round("p_blocked", 6).alias("p_blocked"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"),
        pii.listing(F.col("spans")).alias("spans"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 5) == 1
    out = lattice_lm.score(docs, VOCABULARY, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score", "blend")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *line_rules.BASE, "n_removed_words", "base_failed", "kept")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"),
                      "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = shards.shard(docs, size=F.col("n_bytes"), max_bytes=SHARD_BYTES)
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").cast("bigint").alias("depth"),
                      "shard_bytes")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens",
                      F.round("weight", 6).alias("weight"),
                      F.round("probability", 6).alias("probability"), "sampled")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tok = byte_bpe.load(public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.decode(byte_bpe.encode(docs, tok), tok)
    return out.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift_clusters.cluster(
        table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=CLUSTER_ROUNDS, scale=CLUSTER_SCALE)
    return out.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
        .alias("centroid_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(turns)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_quality_rules": (op2_quality_rules, None),
    "op3_url_filters": (op3_url_filters, None),
    "op4_simhash_near_dedup": (op4_simhash_near_dedup, None),
    "op5_html_extraction": (op5_html_extraction, None),
    "op6_pii": (op6_pii, None),
    "op7_sharding": (op7_sharding, sql.shards(SHARD_BYTES)),
    "op8_mixing": (op8_mixing, sql.mixing()),
    "op9_lm_scoring": (op9_lm_scoring, None),
    "op10_benchmark_decontamination": (op10_benchmark_decontamination, sql.DECONTAMINATION),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_centroid_clusters": (
        op12_centroid_clusters, sql.clusters(CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SCALE)),
    "op13_conversation_trie": (op13_conversation_trie, sql.PREFIX_TRIE),
    "pipeline": (pipeline, None),
}
