"""The registered queries of the training-data operators: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, divergence, importance, language_id, near_copies, packing, pseudonyms, quality_rules, secrets, sharding, warc
from .common import table, utf8, written
from .oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled good and not toxic are what the sample is to look like."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("doc"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return importance.resampled(docs, good_labels(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def op2_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(language_id.held_out(), F.lit(False)))
    labelled = docs.where("not held_out and lang is not null").select(F.col("doc_id").alias("id"), "text", "lang")
    net = language_id.trained(language_id.training_sample(labelled))
    return language_id.identified(docs, net, ["doc_id", "held_out"])


def op3_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(utf8(F.coalesce("text", F.lit("")))).alias("text_crc32"),
    )
    return sharding.interleave(rows, 40, "mixture").select(
        F.col("id").alias("doc_id"), "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on this machine; the executors are expected to hold the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return packing.packed(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")


#: For the registered queries only; a deployment passes its own secret.
DEMO_KEY = b"riskweave demonstration key"


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymized(docs, DEMO_KEY, spans="spans")
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_pii"), secrets.joined("spans").alias("spans"))


def op6_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return near_copies.near_copies(docs).withColumnRenamed("doc", "doc_id")


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    stats = written(quality_rules.text_stats(docs).drop("text"), "rule-stats")
    cuts = written(quality_rules.cutoffs(stats.join(labels, "doc_id"), "lang", "good"), "rule-cuts")
    out = quality_rules.judged(stats, cuts, "lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"cut_{r}" for r in quality_rules.LADDERS])


def op9_boundary_chain_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return warc.round_trip(pages).select(
        number("record").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("refers").isNotNull(), number("refers")).alias("refers_to"),
        "digest_ok",
    )


def op10_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    out = secrets.scan(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return out.select(
        F.col("doc").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


#: A conversation of control strings, which the formatted texts must give back.
PROBE = "conv_id long, turn long, role string, text string", [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.formatted(rows.unionByName(spark.createDataFrame(PROBE[1], PROBE[0])))
    back = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: Sums by label up to this number are broadcast; more are joined by sorting.
FEW_LABELS = 200_000


def op13_exact_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = codes.trained(vectors)
    out = written(codes.coded(vectors, books, keep=["vec_id", "label"]), "vector-codes")
    sums = out.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return out.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_byte_bigru": op2_byte_bigru,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_multi_order_jaccard": op6_multi_order_jaccard,
    "op7_positional_index": op7_positional_index,
    "op9_boundary_chain_warc": op9_boundary_chain_warc,
    "op10_token_efficiency_secrets": op10_token_efficiency_secrets,
    "op8_risk_controlled_rules": op8_risk_controlled_rules,
    "op3_stratified_sharding": op3_stratified_sharding,
    "op11_relational_chat": op11_relational_chat,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_vector_codes": op13_exact_vector_codes,
}
