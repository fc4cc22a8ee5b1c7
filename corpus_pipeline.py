"""A text-cleaning pipeline over ``documents``: five stages, each of which works on all that the one before kept.

Every stage but the last returns the columns of ``documents``. Rows with a null or empty text pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bagminhash, bytebpe, decontaminate, secrets, toxicity
from ledgerloom.llm.labelled import fold, stored

#: Toxicity from which a document is rejected.
REJECTED_FROM = 0.5
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _wrapped(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside the text, so that no column of theirs meets one of an operator."""
    return docs.select(F.struct("*").alias("doc"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``REJECTED_FROM``; the model learns from the same rows as the query's."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(_wrapped(docs), model, ["doc"])
    return scored.filter(F.col("score") < REJECTED_FROM).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return bagminhash.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover less than a twentieth."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_wrapped(docs), items, ["doc"])
    return found.filter(~F.col("contaminated")).select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and ``n_chars`` of the new text."""
    found = secrets.find_secrets(_wrapped(docs), ["doc", "text"])
    text = secrets.redacted("text", "spans")
    changed = F.size("spans") > 0
    new = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        counted = F.when(changed, F.char_length(text)).otherwise(F.col("doc.n_chars"))
        new = new.withField("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return found.select(new.alias("doc")).select("doc.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every text, and the digest of the bytes that they decode to."""
    return bytebpe.round_trip(docs, public_tokenizers.path(TOKENIZER), ["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_texts),
]

#: Trees and signatures are not to be had in SQL; the tests compare with a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
