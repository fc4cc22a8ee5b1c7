"""Whole tables of user requests: change jobs, text queries and computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import change, display_number, to_float
from ledgerloom.functions.programs import with_arithmetic
from ledgerloom.functions.text import expression_intent, operation, query_type
from ledgerloom.operators.matching import get_values
from ledgerloom.operators.tables import KEY, column_facts, first_numeric_sum

DEFAULT_COLUMNS = 3
PREVIEW_ROWS = 5


def change_requests(requests: DataFrame, cells: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Change between two columns of one row, per request.

    ``requests``: request_id, record_id, row_identifier, old_column, new_column, change_type. Both lookups
    of all requests run as one lookup job.
    """
    sides = F.array(
        F.struct(F.lit("old").alias("side"), F.col("old_column").alias("column_identifier")),
        F.struct(F.lit("new").alias("side"), F.col("new_column").alias("column_identifier")),
    )
    # The request travels inside the id of its two lookups, so it need not be joined back.
    stacked = requests.select(F.struct(*requests.columns).alias("_request"), "*", F.inline(sides)).select(
        F.struct("_request", "side").alias("request_id"),
        "record_id",
        "row_identifier",
        "column_identifier",
    )
    found = get_values(stacked, cells, fuzzy=fuzzy)
    is_old = F.col("request_id.side") == "old"
    paired = found.groupBy(F.col("request_id._request").alias("_request")).agg(
        F.max(F.when(is_old, F.col("value"))).alias("old_value"),
        F.max(F.when(~is_old, F.col("value"))).alias("new_value"),
        F.max(F.when(is_old, F.col("status"))).alias("old_status"),
        F.max(F.when(~is_old, F.col("status"))).alias("new_status"),
    )
    result = change(F.col("old_value"), F.col("new_value"), F.col("_request.change_type"))
    failed = F.when(F.col("old_status") != "OK", F.col("old_status")).when(
        F.col("new_status") != "OK", F.col("new_status")
    )
    return paired.withColumn("_change", result).select(
        "_request.*",
        "old_value",
        "new_value",
        F.col("_change.value").alias("change"),
        F.coalesce(failed, F.col("_change.status")).alias("status"),
    )


def period_change(cells: DataFrame) -> DataFrame:
    """Change of every row from each numeric value to the next one, in column order."""
    order = Window.partitionBy(*KEY, "row_ord").orderBy("col_ord")
    numbers = cells.withColumn("new_value", to_float(F.col("raw"))).filter("new_value IS NOT NULL")
    paired = numbers.select(
        *KEY,
        "row_ord",
        "row_name",
        F.lag("col_name").over(order).alias("old_column"),
        F.col("col_name").alias("new_column"),
        F.lag("new_value").over(order).alias("old_value"),
        "new_value",
    ).filter("old_column IS NOT NULL")
    old, new = F.col("old_value"), F.col("new_value")
    return paired.select(
        "*",
        change(old, new, F.lit("auto"))["value"].alias("change"),
        change(old, new, F.lit("percentage"))["value"].alias("percent_change"),
    )


def final_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers reduced to the bare number where they are one."""
    return answers.withColumn("final_answer", display_number(F.col(column)))


def _column_lists(cells: DataFrame, types: DataFrame | None) -> DataFrame:
    """Per record its columns in order: struct(col_ord, col_name, numeric, total), from one pass over the cells."""
    facts = column_facts(cells)
    if types is not None:
        given = types.select(*KEY, "col_ord", "column_type")
        facts = facts.drop("column_type").join(given, [*KEY, "col_ord"], "left")
    numeric = F.coalesce(F.col("column_type") == "numeric", F.lit(False)).alias("numeric")
    return facts.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("col_ord", "col_name", numeric, "total"))).alias("_columns")
    )


def _wanted(operation: Column, targets: Column, columns: Column) -> Column:
    """What a request asks for, as an array: columns whose cells are to be fetched (``fetch``), or finished rows."""

    def want(fetch, position, name, number, note, preview: bool = False) -> Column:
        return F.struct(
            fetch.cast("int").alias("fetch"),
            position.cast("long").alias("position"),
            name.cast("string").alias("col_name"),
            number.cast("double").alias("_number"),
            note.cast("string").alias("note"),
            F.lit(preview).alias("_preview"),
        )

    none = F.lit(None)
    # The columns of each wanted name, by its first place in the list.
    named = F.flatten(
        F.transform(
            F.array_distinct(targets),
            lambda name: F.transform(
                F.filter(columns, lambda c: c["col_name"] == name),
                lambda c: F.struct((F.array_position(targets, name) - 1).alias("at"), c.alias("column")),
            ),
        )
    )
    numeric = F.filter(named, lambda c: c["column"]["numeric"])
    totals = F.transform(
        numeric,
        lambda c: want(none, c["at"], F.concat(c["column"]["col_name"], F.lit("_total")), c["column"]["total"], none),
    )
    # The notes on what could not be given.
    listed = F.array_join(F.transform(F.filter(columns, lambda c: c["numeric"]), lambda c: c["col_name"]), ", ")
    no_total = F.array(want(none, F.lit(0), none, none, F.concat(F.lit("Available numeric columns: "), listed)))
    chosen = F.transform(named, lambda c: want(c["column"]["col_ord"], c["at"], c["column"]["col_name"], none, none))

    def all_columns(note: str, preview: bool) -> Column:
        return F.transform(columns, lambda c: want(c["col_ord"], c["col_ord"], c["col_name"], none, F.lit(note), preview))

    first_rows = all_columns("analysis_required", True)
    everything = all_columns("Columns not found. Showing all data.", False)
    no_table = F.array(want(none, none, none, none, F.lit("No table for this record.")))
    totalled = (operation == "aggregate") & (F.size(targets) > 0)
    return (
        F.when(columns.isNull(), no_table)
        .when(operation.isin("calculate", "analyze_change", "compare"), first_rows)
        .when(totalled & (F.size(numeric) > 0), totals)
        .when(totalled, no_total)
        .when(operation.isNotNull() & (F.size(named) > 0), chosen)
        .when(operation.isNotNull(), everything)
    )


def query_tables(requests: DataFrame, cells: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Answer text requests: request_id, record_id, query and optionally operation, target_columns.

    Lookups return the target columns, aggregates their totals, and change, calculation and comparison
    requests the first rows of the table for further steps. Without target columns the table's first ones are taken. One
    row per returned value; a request on a record that is unknown or has no table gets one row that says so.

    One pass over the cells lists every table's columns with types (``types`` where given) and totals. A request meets
    that list once, and becomes what it wants: finished rows, or columns, which meet the cells in one join.
    """
    names = requests.columns
    given_op = F.col("operation") if "operation" in names else F.lit(None).cast("string")
    given_cols = F.col("target_columns") if "target_columns" in names else F.lit(None).cast("array<string>")
    leading = F.transform(F.slice("_columns", 1, DEFAULT_COLUMNS), lambda c: c["col_name"])
    asked = requests.join(_column_lists(cells, types), "record_id", "left").select(
        "request_id",
        "record_id",
        F.coalesce(given_op, operation(F.col("query"))).alias("operation"),
        F.coalesce(given_cols, leading).alias("_targets"),
        "_columns",
    )
    wanted = asked.select(
        "request_id", "record_id", "operation", F.inline(_wanted(F.col("operation"), F.col("_targets"), F.col("_columns")))
    )
    # Rows that fetch nothing have no key to join by and keep their own number.
    keyed = wanted.withColumn("_record", F.when(F.col("fetch").isNotNull(), F.col("record_id")))
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row_ord"))
    values = cells.select(
        F.col("record_id").alias("_record"), F.col("col_ord").alias("fetch"), F.col("row_ord").cast("long").alias("row_ord"),
        "row_name", "raw", (rank <= PREVIEW_ROWS).alias("_leads"),
    )
    found = keyed.join(values, ["_record", "fetch"], "left").filter(
        F.col("fetch").isNull() | F.when(F.col("_preview"), F.col("_leads")).otherwise(F.col("row_ord").isNotNull())
    )
    return found.select(
        "request_id", "record_id", "operation", query_type(F.col("operation")).alias("query_type"),
        "position", "col_name", "row_ord", "row_name", "raw",
        F.coalesce("_number", to_float(F.col("raw"))).alias("num"), "note",
    )


def compute_requests(requests: DataFrame, cells: DataFrame, types: DataFrame) -> DataFrame:
    """Evaluate (request_id, record_id, expression).

    Sum or total expressions add up the table's first numeric column; the others, and those on a table
    without numbers, are arithmetic on the text.
    """
    tagged = requests.withColumn("_table", expression_intent(F.col("expression"))["is_table_dependent"])
    sums = first_numeric_sum(
        tagged.filter("_table").select(
            "request_id", "record_id", F.array().cast("array<string>").alias("target_columns")
        ),
        cells,
        types,
    ).select("request_id", "total")
    return (
        with_arithmetic(tagged, "expression", "_text")
        .join(sums, "request_id", "left")
        .select(
            "request_id",
            "record_id",
            "expression",
            F.coalesce("total", "_text.value").alias("value"),
            F.when(F.col("total").isNotNull(), "OK").otherwise(F.col("_text.status")).alias("status"),
        )
    )
