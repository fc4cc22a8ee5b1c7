"""The results ledger: scored results appended run by run, processed records skipped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.evaluation import score

LEDGER_SCHEMA = (
    "rec_ord BIGINT, record_id STRING, turn INT, question STRING, expected STRING, actual STRING, "
    "is_correct BOOLEAN, is_hybrid BOOLEAN"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; empty when it does not exist yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def remaining(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Available rows whose record is not processed yet."""
    return available.join(processed.select("record_id").distinct(), "record_id", "left_anti").select(
        *available.columns
    )


def limit_turns(
    turns: DataFrame, max_records: int | None = None, max_questions: int | None = None
) -> DataFrame:
    """Turns of the first records, and the first questions of each."""
    if max_records is not None:
        first = turns.select("rec_ord").distinct().orderBy("rec_ord").limit(max_records)
        turns = turns.join(first, "rec_ord", "left_semi").select(*turns.columns)
    if max_questions is not None:
        turns = turns.filter(F.col("turn") <= max_questions)
    return turns


def evaluate_incremental(
    preds: DataFrame,
    turns: DataFrame,
    ledger_path: str,
    max_records: int | None = None,
    max_questions: int | None = None,
    policy: str = "basic",
) -> DataFrame:
    """Score the records that have predictions and are not in the ledger, append them, return the ledger.

    The append is one job, committed as the file system's committer does; a run that failed can be repeated.
    """
    spark = preds.sparkSession
    open_turns = remaining(limit_turns(turns, max_records, max_questions), read_ledger(spark, ledger_path))
    predicted = open_turns.join(preds.select("record_id").distinct(), "record_id", "left_semi").select(
        *open_turns.columns
    )
    results = score(preds, predicted, policy).withColumn("turn", F.col("turn").cast("int"))
    results.write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)
