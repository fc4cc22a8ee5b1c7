"""The queries of the text operators over the given tables. Each one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    bagminhash, bytebpe, chatcollapse, decontaminate, fillmiddle, merkle, overlapjoin, quality_rules, qualityscore,
    secrets, sql, surrogates, toxicity, warc,
)
from ledgerloom.llm.labelled import fold, stored
from ledgerloom.session import shared_folder

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Of the demonstration; a real run takes its own.
SURROGATE_KEY = "demonstration"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = shared_folder(spark, "warc")
    warc.write(_table(spark, folder, "pages"), archive, "page_id", "url", "html")
    return warc.read(spark, archive).select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.classes(_table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"]
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"), ["doc_id"])
    return found.select(
        "doc_id",
        *[secrets.count("strong", name).alias(f"n_{name}") for name in ("assign", "access", "hex")],
        F.sha2(secrets.listed("strong"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return bytebpe.round_trip(_table(spark, folder, "documents"), path, ["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_chat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    placed = chatcollapse.positions(_table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    collapsed = chatcollapse.collapse(chatcollapse.prefixes(placed))
    shown = (
        chatcollapse.render(placed, collapsed)
        .groupBy(F.col("conv").alias("conv_"))
        .agg(F.sum(F.char_length("rendered")).alias("rendered_chars"))
    )
    return collapsed.join(shown, F.col("conv").eqNullSafe(F.col("conv_")), "left").select(
        F.col("conv").alias("conv_id"), "n_turns", "is_snapshot", "kept", "rendered_chars"
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.measure(_table(spark, folder, "documents"), ["doc_id"]))
    base_failed = F.coalesce(
        (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")), F.lit(False)
    )
    return judged.select(
        "doc_id",
        *quality_rules.COUNTS,
        base_failed.alias("base_failed"),
        (~base_failed & F.col("kept")).alias("kept"),
        "failed_rules",
    )


def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    replaced = surrogates.replace_personal_data(_table(spark, folder, "documents"), SURROGATE_KEY, ["doc_id"])
    values, given = F.transform("entities", lambda e: e["value"]), F.transform("entities", lambda e: e["surrogate"])
    return replaced.select(
        "doc_id",
        *[surrogates.count(kind).alias(f"n_{kind}") for kind in surrogates.KINDS],
        (
            (F.size(F.array_distinct(values)) == F.size(F.array_distinct(given)))
            & ~F.exists("entities", surrogates.unchanged)
        ).alias("distinct_kept"),
        "text",
    )


def op10_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = qualityscore.score(
        _table(spark, folder, "documents"), _table(spark, folder, "labels"), fold("doc_id", 4) != 2
    )
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select(
        merkle.tree_of("lang").alias("tree"),
        "doc_id",
        merkle.leaf([*columns, F.col("text")]).alias("digest"),
        F.when(tampered, merkle.leaf([*columns, lowered])).alias("tampered"),
    )
    # Stored first, as the range partitioning reads its input twice.
    placed = stored(merkle.ranked(stored(leaves, "merkle-digests"), ["doc_id", "digest"]), "merkle-leaves")
    manifest = merkle.build(placed)
    kept = F.struct("doc_id", F.col("digest").alias("leaf"), F.coalesce("tampered", "digest").alias("now"))
    proofs = manifest.proofs(placed.select("tree", "place", "n", kept.alias("kept")))
    found = proofs.select(
        "kept.doc_id", "kept.leaf", "subroot", "root",
        merkle.proof_digest().alias("proof_sha256"),
        merkle.folded(F.col("kept.now")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    return overlapjoin.components_of(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fillmiddle.fill_in_middle(_table(spark, folder, "documents"), ["doc_id"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fillmiddle.restored("output", "form"), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_bagminhash": op2_bagminhash,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_secrets": op5_secrets,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_chat_collapse": op7_chat_collapse,
        "op8_quality_rules": op8_quality_rules,
        "op9_surrogates": op9_surrogates,
        "op10_quality_score": op10_quality_score,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_overlap_join": op12_overlap_join,
        "op13_fill_middle": op13_fill_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
