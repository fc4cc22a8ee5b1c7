"""Layout of a table: which columns are times, which rows are metrics, and how to read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import has_financial_content, is_time_label
from ledgerloom.operators.tables import KEY, axis_labels

# Fixed value: confidence words as numbers.
CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3}


def _flagged(cells: DataFrame) -> DataFrame:
    """Axis labels with ``hit``: a time column or a metric row."""
    label = F.col("label")
    hit = F.when(F.col("axis") == "col", is_time_label(label)).otherwise(has_financial_content(label))
    return axis_labels(cells).withColumn("hit", F.coalesce(hit, F.lit(False)))


def _classified(counts: DataFrame) -> DataFrame:
    times, metrics = F.col("time_columns"), F.col("metric_rows")
    series = (times >= 2) & (metrics >= 1)
    categories = (F.col("row_count") > F.col("column_count")) & (metrics > times)
    some = (times > 0) | (metrics > 0)
    return counts.withColumn(
        "structure",
        F.when(series, "time_series")
        .when(categories, "metrics_by_categories")
        .when(some, "mixed")
        .otherwise("unknown"),
    ).withColumn(
        "confidence",
        F.when(series, F.least(F.lit(0.9), F.lit(0.5) + times * F.lit(0.1) + metrics * F.lit(0.05)))
        .when(categories, F.lit(0.7))
        .when(some, F.lit(0.5))
        .otherwise(F.lit(0.2)),
    )


def _label_counts(is_col: Column) -> list[Column]:
    return [
        F.count_if(~is_col).alias("row_count"),
        F.count_if(is_col).alias("column_count"),
        F.count_if(is_col & F.col("hit")).alias("time_columns"),
        F.count_if(~is_col & F.col("hit")).alias("metric_rows"),
    ]


def classify_structure(cells: DataFrame) -> DataFrame:
    """Structure and confidence per table, with the counts they rest on."""
    return _classified(_flagged(cells).groupBy(*KEY).agg(*_label_counts(F.col("axis") == "col")))


def _named_counts(is_col: Column) -> list[Column]:
    """Counts per table, and all hit labels of each axis in order; they fit a row as the table did."""
    named = F.struct("ord", "label")
    return [
        *_label_counts(is_col),
        F.array_sort(F.collect_list(F.when(is_col & F.col("hit"), named))).alias("_all_cols"),
        F.array_sort(F.collect_list(F.when(~is_col & F.col("hit"), named))).alias("_all_rows"),
    ]


def _with_names(flagged: DataFrame) -> DataFrame:
    """Counts, hit labels and structure per table."""
    return _classified(flagged.groupBy(*KEY).agg(*_named_counts(F.col("axis") == "col")))


def _joined(names: Column | str) -> Column:
    return F.coalesce(F.array_join(F.transform(names, lambda s: s["label"]), ", "), F.lit(""))


def structure_guide(cells: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """``classify_structure`` plus the reading guide as a map, and the column types when a schema is given."""
    return _guided(_with_names(_flagged(cells)), schema)


def _guided(joined: DataFrame, schema: DataFrame | None) -> DataFrame:
    """Add the guide for the structure, counts and hit labels of each table, and the column types of a schema."""
    first_cols, first_rows = F.slice("_all_cols", 1, 3), F.slice("_all_rows", 1, 3)
    size = {c: F.col(c).cast("string") for c in ("row_count", "column_count", "time_columns", "metric_rows")}

    def more(count: str) -> Column:
        return F.when(F.col(count) > 3, F.lit("...")).otherwise(F.lit(""))

    # The sentences of the guides.
    def guide(**entries: Column | str) -> Column:
        flat = []
        for name, text in entries.items():
            flat += [F.lit(name), F.lit(text) if isinstance(text, str) else text]
        return F.create_map(*flat)

    series = guide(
        structure=F.concat(
            F.lit("Time series financial data with "), size["time_columns"],
            F.lit(" time periods and "), size["metric_rows"], F.lit(" identified metrics"),
        ),
        columns=F.concat(F.lit("Columns represent time periods: "), _joined(first_cols), more("time_columns")),
        rows=F.concat(F.lit("Rows represent financial metrics: "), _joined(first_rows), more("metric_rows")),
        reading_guide="Each cell shows the value of a financial metric for a specific time period",
        analysis_suggestion="Use time-based comparisons and trend analysis for insights",
    )
    categories = guide(
        structure=F.concat(
            F.lit("Categorical financial data with "), size["column_count"],
            F.lit(" categories and "), size["row_count"], F.lit(" data points"),
        ),
        organization="Data is organized by categories rather than time periods",
        rows=F.when(
            F.col("metric_rows") > 0, F.concat(F.lit("Contains "), size["metric_rows"], F.lit(" identified financial metrics"))
        ).otherwise("Contains various data points"),
        reading_guide="Each cell shows the value of a metric for a specific category",
        analysis_suggestion="Use category-based comparisons for insights",
    )
    shape = F.concat(size["row_count"], F.lit("x"), size["column_count"])
    mixed = guide(
        structure=F.concat(
            F.lit("Mixed structure with both time and categorical elements ("), shape, F.lit(")")
        ),
        complexity="This table combines multiple organizational patterns",
        time_elements=F.when(
            F.col("time_columns") > 0, F.concat(F.lit("Time-related columns: "), _joined("_all_cols"))
        ).otherwise("No clear time columns identified"),
        metric_elements=F.when(
            F.col("metric_rows") > 0, F.concat(F.lit("Financial metrics: "), _joined("_all_rows"))
        ).otherwise("No clear financial metrics identified"),
        reading_guide="Examine both row and column headers to understand data organization",
        analysis_suggestion="Consider the context provided in pre_text and post_text for interpretation",
    )
    unknown = guide(
        structure=F.concat(
            F.lit("Table structure not automatically recognized ("), size["row_count"],
            F.lit(" rows, "), size["column_count"], F.lit(" columns)"),
        ),
        organization="Unable to determine standard financial table patterns",
        reading_guide="Refer to the document context (pre_text and post_text) to understand data organization",
        analysis_suggestion="Examine column headers and row labels manually for patterns",
    )
    kind = F.col("structure")
    result = joined.select(
        *[c for c in joined.columns if not c.startswith("_")],
        F.when(kind == "time_series", series)
        .when(kind == "metrics_by_categories", categories)
        .when(kind == "mixed", mixed)
        .otherwise(unknown)
        .alias("guide"),
    )
    if schema is None:
        return result
    types = schema.groupBy(*KEY).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_ord", "col_name", "column_type"))),
                lambda c: F.struct(c["col_name"], c["column_type"]),
            )
        ).alias("data_types")
    )
    return result.join(types, KEY, "left")


def _labelled(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Axis labels with what is said of their table; ``hit`` where their axis has times or metrics."""
    confidence = F.lit(CONFIDENCE["low"])
    for word, value in CONFIDENCE.items():
        confidence = F.when(F.col("_word") == word, F.lit(value)).otherwise(confidence)
    word = F.coalesce("confidence", F.lit("low")) if "confidence" in labels.columns else F.lit("low")
    given = labels.select("record_id", "table_type", "time_axis", "metric_axis", word.alias("_word"))
    hit = ((F.col("axis") == "col") & (F.col("time_axis") == "columns")) | (
        (F.col("axis") == "row") & (F.col("metric_axis") == "rows")
    )
    return axis_labels(cells).join(given, "record_id", "left").select(
        *KEY, "axis", "ord", "label",
        F.coalesce("table_type", F.lit("unknown")).alias("structure"),
        confidence.alias("confidence"),
        F.coalesce(hit, F.lit(False)).alias("hit"),
    )


def apply_axis_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Axis roles from given labels (record_id, table_type, time_axis, metric_axis, confidence).

    When the time axis is the columns every column is a time, when the metric axis is the rows every row is
    a metric; otherwise none is. A table without a label is ``unknown``, of low confidence.
    """
    counts = _label_counts(F.col("axis") == "col")
    return _labelled(cells, labels).groupBy(*KEY, "structure", "confidence").agg(*counts).select(
        *KEY, "structure", "time_columns", "metric_rows", "confidence"
    )


def labelled_guide(cells: DataFrame, labels: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """``apply_axis_labels`` plus the reading guide as a map, and the column types when a schema is given."""
    named = _labelled(cells, labels).groupBy(*KEY, "structure", "confidence").agg(*_named_counts(F.col("axis") == "col"))
    return _guided(named, schema)


def labelled_axes(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """The time columns and metric rows themselves, one row per label."""
    chosen = ((F.col("axis") == "col") & (F.col("time_axis") == "columns")) | (
        (F.col("axis") == "row") & (F.col("metric_axis") == "rows")
    )
    return (
        axis_labels(cells)
        .join(labels.select("record_id", "time_axis", "metric_axis"), "record_id")
        .filter(chosen)
        .select(*KEY, F.when(F.col("axis") == "col", "time").otherwise("metric").alias("role"), "ord", "label")
    )
