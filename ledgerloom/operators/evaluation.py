"""Scoring predicted answers and summing up accuracy.

``turns``: rec_ord, record_id, turn, question, answer, program, executed_answer, is_hybrid.
``preds``: record_id, turn, actual and optionally error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import MATCH_TOLERANCE, answers_match, to_float
from ledgerloom.functions.programs import evaluate_program
from ledgerloom.functions.text import shorten
from ledgerloom.operators.ordered import SLICE_ROWS, running_totals

# Published execution accuracies (model, method, percent).
PUBLISHED = [
    ("GPT-3", "answer-only-prompt", 24.09),
    ("GPT-3", "CoT prompting", 40.63),
    ("GPT-3", "DSL program", 45.15),
    ("FinQANet(RoBERTa-large)", "DSL program", 68.90),
    ("Human Expert", "", 89.44),
]
ERROR_MARK = "ERROR: "


def score(
    preds: DataFrame,
    turns: DataFrame,
    policy: str = "basic",
    drop_failed: bool = False,
    plain_types: bool = False,
) -> DataFrame:
    """Every gold turn with its prediction and whether that is right.

    A turn with an error or without a prediction is wrong; ``drop_failed`` leaves turns without a prediction
    out. ``plain_types`` treats every conversation as simple.
    """
    error = F.col("error") if "error" in preds.columns else F.lit(None).cast("string")
    given = preds.select(
        "record_id", "turn", F.coalesce(F.concat(F.lit(ERROR_MARK), error), F.col("actual")).alias("actual"),
        error.isNotNull().alias("_failed"),
    )
    joined = turns.join(given, ["record_id", "turn"], "inner" if drop_failed else "left")
    right = answers_match(F.col("actual"), F.col("answer"), policy) & ~F.coalesce("_failed", F.lit(True))
    hybrid = F.lit(False) if plain_types else F.coalesce("is_hybrid", F.lit(False))
    return joined.select(
        "rec_ord",
        "record_id",
        "turn",
        shorten(F.col("question"), 100).alias("question"),
        F.col("answer").alias("expected"),
        F.coalesce("actual", F.lit(ERROR_MARK + "no prediction")).alias("actual"),
        right.alias("is_correct"),
        hybrid.alias("is_hybrid"),
    )


def _percent(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total * 100).otherwise(F.lit(0.0))


def accuracy(results: DataFrame) -> DataFrame:
    """One row: correct, total and the percentage, 0 for no results."""
    counted = results.agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("accuracy", _percent(F.col("correct"), F.col("total")))


def accuracy_breakdown(results: DataFrame) -> DataFrame:
    """Accuracy overall, by turn and by conversation type: level, name, correct, total, accuracy.

    Both types are always listed, with zeros where one does not occur.
    """
    kind = F.when(F.col("is_hybrid"), "hybrid").otherwise("simple")
    counted = (
        results.select("turn", kind.alias("kind"), "is_correct")
        .groupingSets([["turn"], ["kind"], []], "turn", "kind")
        .agg(
            F.count_if("is_correct").alias("correct"),
            F.count(F.lit(1)).alias("total"),
            F.grouping_id().alias("_level"),
        )
        .select(
            F.when(F.col("_level") == 1, "turn").when(F.col("_level") == 2, "type").otherwise("overall").alias("level"),
            F.when(F.col("_level") == 1, F.col("turn").cast("string"))
            .when(F.col("_level") == 2, F.col("kind"))
            .otherwise("all")
            .alias("name"),
            "correct",
            "total",
        )
    )
    spark = results.sparkSession
    zeros = spark.createDataFrame(
        [("type", "simple", 0, 0), ("type", "hybrid", 0, 0)],
        "level string, name string, correct long, total long",
    )
    return (
        counted.unionByName(zeros)
        .groupBy("level", "name")
        .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        .withColumn("accuracy", _percent(F.col("correct"), F.col("total")))
    )


def baseline_report(results: DataFrame, model: str = "This run", method: str = "Predictions") -> DataFrame:
    """The published accuracies and this run's, as one table."""
    published = results.sparkSession.createDataFrame(PUBLISHED, "model string, method string, accuracy double")
    own = accuracy(results).select(F.lit(model).alias("model"), F.lit(method).alias("method"), "accuracy")
    return published.unionByName(own)


def example_results(results: DataFrame, count: int = 3) -> DataFrame:
    """The first ``count`` right and wrong results in record and turn order.

    Each task keeps its first ``count`` of either kind, so only those meet to be ranked.
    """
    kinds = [
        results.filter(F.col("is_correct") == right).orderBy("rec_ord", "turn").limit(count) for right in (True, False)
    ]
    rank = F.row_number().over(Window.partitionBy("is_correct").orderBy("rec_ord", "turn"))
    return kinds[0].unionByName(kinds[1]).withColumn("rank", rank)


def running_accuracy(results: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Accuracy after each record, in record order."""
    per_record = results.groupBy("rec_ord", "record_id").agg(
        F.count_if("is_correct").alias("_correct"), F.count(F.lit(1)).alias("_total")
    )
    totals = running_totals(
        per_record, "rec_ord", {"correct_so_far": "_correct", "total_so_far": "_total"}, slice_rows=slice_rows
    )
    return totals.select(
        "rec_ord",
        "record_id",
        "correct_so_far",
        "total_so_far",
        _percent(F.col("correct_so_far"), F.col("total_so_far")).alias("accuracy"),
    )


def check_programs(turns: DataFrame) -> DataFrame:
    """Evaluate every turn's program and compare it with the stored result."""
    value, expected = F.col("_run.value"), to_float(F.col("executed_answer"))
    # Comparisons are stored as words.
    truth = F.when(F.lower("executed_answer").isin("yes", "true"), 1.0).when(
        F.lower("executed_answer").isin("no", "false"), 0.0
    )
    near = F.abs(value - F.coalesce(truth, expected)) < MATCH_TOLERANCE
    return turns.withColumn("_run", evaluate_program(F.col("program"))).select(
        "record_id",
        "turn",
        "program",
        value.alias("value"),
        F.col("_run.status").alias("status"),
        F.coalesce(near, F.lit(False)).alias("agrees"),
    )
