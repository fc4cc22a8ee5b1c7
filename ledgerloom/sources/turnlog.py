"""The turn log: sessions as append-only rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_LOG_SCHEMA = (
    "session_id STRING, record_id STRING, seq BIGINT, user_message STRING, assistant_response STRING, "
    "ts TIMESTAMP, tool_calls ARRAY<MAP<STRING, STRING>>, referenced_entities ARRAY<STRING>, "
    "computation_results ARRAY<MAP<STRING, STRING>>"
)


def append_turns(turns: DataFrame, path: str) -> None:
    """Append turns, one folder per day."""
    turns.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def load_session(log: DataFrame, session_id: str) -> DataFrame:
    """Turns of one session, in order."""
    return log.filter(F.col("session_id") == session_id).orderBy("seq")


def list_sessions(log: DataFrame, record_id: str | None = None) -> DataFrame:
    """Sessions newest first: session_id, created_at, record_id, turn_count."""
    chosen = log if record_id is None else log.filter(F.col("record_id") == record_id)
    return (
        chosen.groupBy("session_id")
        .agg(
            F.min("ts").alias("created_at"),
            F.min_by("record_id", "seq").alias("record_id"),
            F.count(F.lit(1)).alias("turn_count"),
        )
        .orderBy(F.desc("created_at"), "session_id")
    )


def without_sessions(log: DataFrame, doomed: DataFrame) -> DataFrame:
    """The log without the sessions listed in ``doomed``."""
    return log.join(doomed.select("session_id").distinct(), "session_id", "left_anti").select(*log.columns)


def delete_sessions(log: DataFrame, doomed: DataFrame, new_path: str) -> DataFrame:
    """Write the log without the given sessions to a new folder; report which of them existed."""
    append_turns(without_sessions(log, doomed), new_path)
    existing = log.join(doomed, "session_id", "left_semi").select("session_id").distinct()
    return (
        doomed.select("session_id")
        .distinct()
        .join(existing.withColumn("deleted", F.lit(True)), "session_id", "left")
        .select("session_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    )
