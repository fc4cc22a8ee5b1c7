"""Keyword rules over questions, labels and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import _any_of

# Word lists.
FINANCIAL_TERMS = [
    "revenue",
    "sales",
    "income",
    "profit",
    "loss",
    "expenses",
    "costs",
    "assets",
    "liabilities",
    "equity",
    "debt",
    "cash",
    "margin",
]
METRIC_TERMS = ["revenue", "sales", "income", "profit", "loss", "expenses", "costs"]
TIME_MARKS = ["year", "quarter", "q1", "q2", "q3", "q4"]
TIME_WORDS = ["year", "fy", "fiscal", "period", "month"]
YEAR_PATTERN = r"\b(19|20)[0-9]{2}\b"
QUARTER_PATTERN = r"\b(q[1-4]|quarter)\b"

# Intent keywords in the order they are tried, and the query type of each operation.
INTENT_WORDS = [
    ("analyze_change", ["change", "increase", "decrease", "difference"]),
    ("calculate", ["calculate", "compute", "total"]),
    ("compare", ["compare", "versus", "vs"]),
]
QUERY_TYPES = {
    "lookup": "selection",
    "calculate": "calculation",
    "compare": "comparison",
    "aggregate": "aggregation",
    "analyze_change": "change_analysis",
}

# Messages of the selection check.
WARN_SENIOR = "🚨 Question asks for 'senior notes' but selected data doesn't mention 'senior'"
HINT_SENIOR = "Look for table rows specifically labeled with 'senior notes' or similar"
WARN_GENERAL = (
    "⚠️  Using general/aggregate debt costs - consider if specific instrument costs are needed"
)
HINT_FOLLOW_UP = (
    "💡 This seems to be a follow-up question - use the same data from previous calculation"
)
PROCEED = "Proceed with calculation"
REVIEW = "Review data selection before calculating"


def mentions(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains any of the words."""
    lowered = F.lower(text)
    return _any_of([F.contains(lowered, F.lit(w)) for w in words])


def financial_terms(text: Column) -> Column:
    """Sorted array of the financial terms a text contains."""
    lowered = F.lower(text)
    # Joined one-word arrays stay in generated code, where the lower-casing is done once.
    return F.concat(
        *[_word_if(F.contains(lowered, F.lit(w)), w) for w in sorted(FINANCIAL_TERMS)]
    )


def _word_if(condition: Column, word: str) -> Column:
    return F.when(condition, F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))


def has_financial_content(text: Column) -> Column:
    return mentions(text, FINANCIAL_TERMS)


def is_financial_metric(text: Column) -> Column:
    return mentions(text, METRIC_TERMS)


def has_time_mark(text: Column) -> Column:
    """The short time check: a year or quarter word."""
    return mentions(text, TIME_MARKS)


def is_time_label(text: Column) -> Column:
    """The pattern time check used on column labels: a year, a quarter or a period word."""
    lowered = F.lower(text)
    return lowered.rlike(YEAR_PATTERN) | lowered.rlike(QUARTER_PATTERN) | mentions(text, TIME_WORDS)


def entities(text: Column) -> Column:
    """Entities a response refers to without a language model: the table, when it names one."""
    return _word_if(mentions(text, ["table"]), "financial_table")


def operation(question: Column) -> Column:
    """Keyword intent of a question."""
    chosen = F.lit("lookup")
    for name, words in reversed(INTENT_WORDS):
        chosen = F.when(mentions(question, words), F.lit(name)).otherwise(chosen)
    return chosen


def query_type(op: Column) -> Column:
    kind = F.lit("analysis")
    for name, label in QUERY_TYPES.items():
        kind = F.when(op == name, F.lit(label)).otherwise(kind)
    return kind


def expression_intent(expression: Column) -> Column:
    """struct(expression_type, operation, is_table_dependent) by keyword."""
    whole_table = mentions(expression, ["sum", "total"])
    return F.struct(
        F.when(whole_table, "table_operation").otherwise("mathematical").alias("expression_type"),
        F.when(whole_table, "sum")
        .when(mentions(expression, ["+", "add"]), "add")
        .when(mentions(expression, ["*", "multiply"]), "multiply")
        .alias("operation"),
        whole_table.alias("is_table_dependent"),
    )


def check_selection(question: Column, selected: Column) -> Column:
    """struct(validation_status, warnings, suggestions, recommendation) for chosen table values."""
    no_senior = mentions(question, ["senior notes"]) & ~mentions(selected, ["senior"])
    too_general = mentions(question, ["debt issuance costs"]) & mentions(
        selected, ["general", "aggregate"]
    )
    follow_up = mentions(question, ["percentage", "%"]) & mentions(question, ["previous", "that"])
    warned = no_senior | too_general
    return F.struct(
        F.when(warned, "warnings_found").otherwise("looks_good").alias("validation_status"),
        F.array_compact(
            F.array(F.when(no_senior, WARN_SENIOR), F.when(too_general, WARN_GENERAL))
        ).alias("warnings"),
        F.array_compact(
            F.array(F.when(no_senior, HINT_SENIOR), F.when(follow_up, HINT_FOLLOW_UP))
        ).alias("suggestions"),
        F.when(warned, REVIEW).otherwise(PROCEED).alias("recommendation"),
    )


def shorten(text: Column, limit: int) -> Column:
    """The text, cut at ``limit`` characters with ``...`` when longer."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)
