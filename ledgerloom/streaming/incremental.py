"""Prediction files scored as they arrive, and session totals kept up to date.

All work of a batch is on the rows that arrived; what is known so far lives in a table of bounded folders (``kept``), not
in streaming state, so nothing is forgotten after a delay and late rows count like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.evaluation import score
from ledgerloom.sources.turnlog import TURN_LOG_SCHEMA
from ledgerloom.streaming import kept

PREDS_SCHEMA = "record_id STRING, turn INT, actual STRING, error STRING"
_SCORED = ["record_id", "turn"]


def first_predictions(preds: DataFrame, arrived: str | None = None) -> DataFrame:
    """One prediction per (record_id, turn): that of the earliest file, then the least by text.

    A rerun scores only what has no result yet, so an answer that came first stays.
    """
    error = F.col("error") if "error" in preds.columns else F.lit(None).cast("string").alias("error")
    at = F.col(arrived) if arrived else F.lit(0)
    order = F.struct(at.alias("at"), F.coalesce("actual", F.lit("")).alias("text"), F.coalesce(error, F.lit("")).alias("why"))
    least = F.min_by(F.struct("actual", error.alias("error")), order).alias("_first")
    return preds.groupBy(*_SCORED).agg(least).select(*_SCORED, "_first.*")


def _scores(turns: DataFrame | None = None, policy: str = "basic") -> kept.Kind:
    def addition(arrived: DataFrame, batch: int) -> DataFrame:
        results = score(first_predictions(arrived, "_at"), turns, policy, drop_failed=True)
        return results.withColumn("_batch", F.lit(batch).cast("long"))

    return kept.Kind(addition, kept.first_by(_SCORED, "_batch"))


def stream_scores(
    spark: SparkSession,
    preds_folder: str,
    turns: DataFrame,
    ledger_path: str,
    checkpoint: str,
    policy: str = "basic",
    files_at_once: int | None = None,
) -> StreamingQuery:
    """Score new prediction files into the ledger, each file once, also across restarts.

    A (record, turn) has one result, that of the prediction that came first. The gold turns are written beside the ledger
    at the first start, and every batch reads that snapshot. Files without an ``error`` column hold no failed predictions.
    """
    snapshot = f"{ledger_path}/turns"
    if not kept.exists(spark, f"{snapshot}/_SUCCESS"):
        turns.write.mode("overwrite").parquet(snapshot)
    reader = spark.readStream.schema(PREDS_SCHEMA)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    arriving = reader.parquet(preds_folder).select("*", F.col("_metadata.file_modification_time").alias("_at"))
    return _into_table(arriving, _scores(spark.read.parquet(snapshot), policy), ledger_path, checkpoint)


def read_scores(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The results so far, one per (record, turn)."""
    return kept.read(spark, _scores(), ledger_path).drop("_batch")


def session_totals(log: DataFrame) -> DataFrame:
    """Turn count and first and last time per session."""
    return log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def _merged_sessions(totals: DataFrame) -> DataFrame:
    return totals.groupBy("session_id").agg(
        F.sum("turn_count").alias("turn_count"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def entity_totals(log: DataFrame) -> DataFrame:
    """Mentions per session and entity."""
    return (
        log.select("session_id", F.explode(F.array_distinct("referenced_entities")).alias("entity"))
        .groupBy("session_id", "entity")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def _merged_entities(totals: DataFrame) -> DataFrame:
    return totals.groupBy("session_id", "entity").agg(F.sum("mentions").alias("mentions"))


SESSIONS = kept.Kind(lambda log, _: session_totals(log), _merged_sessions)
ENTITIES = kept.Kind(lambda log, _: entity_totals(log), _merged_entities)


def stream_totals(log: DataFrame, kind: kept.Kind, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keep totals of a streamed turn log (``SESSIONS`` or ``ENTITIES``). Turns count whenever they arrive."""
    return _into_table(log, kind, table_path, checkpoint)


def _into_table(arriving: DataFrame, kind: kept.Kind, path: str, checkpoint: str) -> StreamingQuery:
    return (
        arriving.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda arrived, batch: kept.add(kind, arrived, batch, path))
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, kind: kept.Kind, table_path: str) -> DataFrame:
    """The current totals, one row per key."""
    return kept.read(spark, kind, table_path)


def open_turn_log(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """A turn log folder as a stream."""
    reader = spark.readStream.schema(TURN_LOG_SCHEMA)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)
