"""Tables in long form: axes, dense grids, schema inference, typed values, selection and totals.

``cells`` has one row per present value: rec_ord, record_id, col_ord, col_name, row_ord, row_name, raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import PLAIN_NUMBER, exact_sum, parse_plain, strip, to_exact, to_float
from ledgerloom.functions.text import shorten

KEY = ["rec_ord", "record_id"]
# Rows of one table handled by one task when a table is expanded or packed.
ROWS_PER_PART = 1000

_MONTH = (
    r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\b\.?"
)
# Date layouts: name, pattern, reader pattern, reader pattern when the day comes first.
DATE_LAYOUTS = [
    ("year-month-day", r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d", None),
    ("year/month/day", r"^\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d", None),
    ("slashes", r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy", "d/M/yyyy"),
    ("dashes", r"^\d{1,2}-\d{1,2}-\d{4}\z", "M-d-yyyy", "d-M-yyyy"),
    ("dots", r"^\d{1,2}\.\d{1,2}\.\d{4}\z", "M.d.yyyy", "d.M.yyyy"),
    ("short slashes", r"^\d{1,2}/\d{1,2}/\d{2}\z", "M/d/yy", "d/M/yy"),
    ("month day, year", r"^[A-Za-z]{3} \d{1,2}, \d{4}\z", "MMM d, yyyy", None),
    ("month day year", r"^[A-Za-z]{3} \d{1,2} \d{4}\z", "MMM d yyyy", None),
    ("day month year", r"^\d{1,2} [A-Za-z]{3} \d{4}\z", "d MMM yyyy", None),
    ("month year", r"^[A-Za-z]{3} \d{4}\z", "MMM yyyy", None),
    ("year-month", r"^\d{4}-\d{1,2}\z", "yyyy-M", None),
    ("month/year", r"^\d{1,2}/\d{4}\z", "M/yyyy", None),
    ("time of day", r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}\z", "yyyy-M-d HH:mm:ss", None),
    ("iso time", r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}\z", "yyyy-M-d'T'HH:mm:ss", None),
]
_DATE_LIKE = r"(?i)^\s*(\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_NUMBER_LIKE = r"^[\s0-9.,$()+\-eE]*\z"
_DATE_HINT = r"\d{4}|\d{2}/\d{2}|\d{2}-\d{2}"


def axis_labels(cells: DataFrame) -> DataFrame:
    """Distinct row and column labels of every table: KEY, axis, ord, label."""
    both = F.array(
        F.struct(F.lit("col").alias("axis"), F.col("col_ord").alias("ord"), F.col("col_name").alias("label")),
        F.struct(F.lit("row").alias("axis"), F.col("row_ord").alias("ord"), F.col("row_name").alias("label")),
    )
    return cells.select(*KEY, F.inline(both)).distinct()


def densify(cells: DataFrame) -> DataFrame:
    """Every (row, column) of every table, with null where the table has no value.

    One aggregate holds the rows and columns of every block of rows, so even a very tall table is expanded by many
    tasks, and meets the values in one join.
    """
    block = F.expr(f"row_ord div {ROWS_PER_PART}").alias("_block")
    blocks = cells.groupBy(*KEY, block).agg(
        F.collect_set(F.struct("row_ord", "row_name")).alias("_rows"),
        F.array_sort(F.collect_set(F.struct("col_ord", "col_name"))).alias("_columns"),
    )
    # Blocks with the same columns count once, so a table has one or few sets of columns.
    every = F.array_distinct(F.flatten(F.collect_set("_columns").over(Window.partitionBy(*KEY))))
    return (
        blocks.select(*KEY, "_rows", every.alias("_columns"))
        .select(*KEY, F.inline("_rows"), "_columns")
        .select(*KEY, "row_ord", "row_name", F.inline("_columns"))
        .join(
            cells.select(*KEY, "row_ord", "col_ord", "raw"), [*KEY, "row_ord", "col_ord"], "left"
        )
        .select(*KEY, "col_ord", "col_name", "row_ord", "row_name", "raw")
    )


def _date_text(value: Column) -> Column:
    """The value with month names cut to three letters."""
    return F.regexp_replace(strip(value), _MONTH, "$1")


def _date_layout(text: Column) -> Column:
    """Number of the layout a date-like text has; null for other texts."""
    layout = F.lit(None).cast("int")
    for number, (_, pattern, _, _) in reversed(list(enumerate(DATE_LAYOUTS))):
        layout = F.when(text.rlike(pattern), F.lit(number)).otherwise(layout)
    return F.when(text.rlike(r"\d"), layout)


def _is_real_date(text: Column, layout: Column, day_first: bool) -> Column:
    """Whether the text names an existing day when read in its layout, month-first or day-first."""
    real = F.lit(None).cast("boolean")
    for number, (_, _, reader, day_reader) in enumerate(DATE_LAYOUTS):
        reader = day_reader if day_first else reader
        if reader:
            read = F.try_to_timestamp(text, F.lit(reader)).isNotNull()
            if day_first:  # a month above 12 need not be tried
                read = (F.regexp_extract(text, r"^\d+\D(\d+)", 1).cast("int") <= 12) & read
            real = F.when(layout == number, read).otherwise(real)
    return real


def column_facts(cells: DataFrame) -> DataFrame:
    """All that one pass tells of every column: KEY, col_ord, col_name, column_type, value_count, row_count (of its
    table), plain_count (unformatted numbers) and total (sum of its amounts).

    Aggregates are of fixed width, so they run as hash aggregates without a sort, and those that a caller does not
    select are not computed. Rows are counted through the first cell of each, so a tall table is no window of its own.
    """
    raw, plain = F.col("raw"), F.col("_plain")
    # Each step is a column of its own and cheap tests come first: plain numbers skip the rest, words skip
    # the number formats, and only what starts like a date is tried as one.
    # An empty string reads as a missing number, as it does for a data-frame reader.
    row = Window.partitionBy(*KEY, "row_ord").orderBy("col_ord")
    step = cells.select(
        *KEY, "col_ord", "col_name", "row_ord", "raw", ((raw == "") | raw.rlike(PLAIN_NUMBER)).alias("_plain"),
        (F.row_number().over(row) == 1).alias("_opens_row"),
    )
    unsigned = F.translate(raw, "$,", "")
    step = step.select(
        "*",
        F.when(
            ~plain & raw.rlike(_NUMBER_LIKE),
            F.when(
                F.contains(raw, F.lit("(")), F.regexp_replace(unsigned, r"\(([0-9.,]+)\)", "-$1")
            ).otherwise(unsigned),
        ).alias("_unformatted"),
        F.when(~plain & F.contains(raw, F.lit("%")), F.translate(raw, "%", "")).alias("_unpercented"),
        F.when(~plain & raw.rlike(_DATE_LIKE), _date_text(raw)).alias("_text"),
    )
    step = step.withColumn("_layout", _date_layout(F.col("_text")))

    def numeric(text: str) -> Column:
        return F.coalesce((F.col(text) == "") | F.col(text).rlike(PLAIN_NUMBER), F.lit(False))

    checks = step.select(
        *KEY,
        "col_ord",
        "col_name",
        "row_ord",
        raw.alias("_raw"),
        "_opens_row",
        to_float(raw).alias("_num"),
        parse_plain(raw).isNotNull().alias("_is_number"),
        plain,
        (plain | numeric("_unformatted")).alias("_formatted"),
        F.col("_unpercented").isNotNull().alias("_percent"),
        (plain | numeric("_unpercented")).alias("_percented"),
        F.when(F.col("_layout").isNotNull(), raw.rlike(_DATE_HINT)).alias("_hint"),
        (raw != "").alias("_filled"),
        "_layout",
        _is_real_date(F.col("_text"), F.col("_layout"), day_first=False).alias("_month_first"),
        _is_real_date(F.col("_text"), F.col("_layout"), day_first=True).alias("_day_first"),
    )
    exact = to_exact(F.col("_raw"), F.col("_num"))
    stats = checks.withColumn("_exact", exact).groupBy(*KEY, "col_ord", "col_name").agg(
        F.count_if("_opens_row").alias("_opened"),
        F.count_if("_is_number").alias("plain_count"),
        exact_sum(F.col("_exact"), F.col("_num")).alias("total"),
        F.count("_raw").alias("value_count"),
        F.bool_and("_plain").alias("_plain"),
        F.bool_and("_formatted").alias("_formatted"),
        F.bool_or("_percent").alias("_percent"),
        F.bool_and("_percented").alias("_percented"),
        F.bool_or("_hint").alias("_hint"),
        F.count_if("_filled").alias("_filled"),
        F.count("_layout").alias("_dated"),
        F.min("_layout").alias("_first_layout"),
        F.max("_layout").alias("_last_layout"),
        F.bool_and("_month_first").alias("_month_first"),
        F.bool_and("_day_first").alias("_day_first"),
        F.min(
            F.when(
                F.col("_filled"),
                F.col("row_ord").cast("long") * 2 + F.when(F.col("_month_first"), 0).otherwise(1),
            )
        ).alias("_first"),
    )
    one_layout = (F.col("_dated") == F.col("_filled")) & (F.col("_first_layout") == F.col("_last_layout"))
    # The first value settles whether the day comes first; the others must then agree.
    day_first_column = F.col("_day_first") & (F.col("_first") % 2 == 1)
    is_date = F.col("_hint") & one_layout & (F.col("_month_first") | F.coalesce(day_first_column, F.lit(False)))
    kind = (
        F.when(F.col("value_count") == 0, "text")
        .when(F.col("_plain") | F.col("_formatted"), "numeric")
        .when(F.col("_percent") & F.col("_percented"), "percentage")
        .when(is_date, "date")
        .otherwise("text")
    )
    rows = F.sum("_opened").over(Window.partitionBy(*KEY))
    return stats.select(
        *KEY, "col_ord", "col_name", kind.alias("column_type"), "value_count", rows.alias("row_count"), "plain_count", "total"
    )


def infer_column_types(cells: DataFrame) -> DataFrame:
    """Type of every column from its values, and how many values it has."""
    return column_facts(cells).select(*KEY, "col_ord", "col_name", "column_type", "value_count")


def build_schema(cells: DataFrame) -> DataFrame:
    """Schema catalog: one row per column with its type, nullability and the table's row count."""
    return column_facts(cells).select(
        *KEY,
        "col_ord",
        "col_name",
        "column_type",
        (F.col("value_count") < F.col("row_count")).alias("nullable"),
        "row_count",
    )


def typed_cells(cells: DataFrame, schema: DataFrame, faithful: bool = False) -> DataFrame:
    """Cells with ``num`` for numeric columns.

    By default formatted amounts keep their value; ``faithful`` reads plain numbers only and leaves the
    others null.
    """
    number = parse_plain(F.col("raw")) if faithful else to_float(F.col("raw"))
    types = schema.select(*KEY, "col_ord", "column_type")
    return cells.join(types, [*KEY, "col_ord"]).select(
        *cells.columns,
        "column_type",
        F.when(F.col("column_type") == "numeric", number).alias("num"),
    )


def conversion_warnings(cells: DataFrame) -> DataFrame:
    """Numeric columns of which more than half the rows have no number when only plain numbers are read."""
    return (
        column_facts(cells)
        .filter("column_type = 'numeric'")
        .withColumn("null_count", F.col("row_count") - F.col("plain_count"))
        .filter(F.col("null_count") / F.col("row_count") > 0.5)
        .select(*KEY, "col_ord", "col_name", "null_count", "row_count")
    )


def list_tables(schema: DataFrame, compact: bool = False) -> DataFrame:
    """Per table: name, rows, columns and the ordered column names; very wide tables come in parts.

    ``compact`` keeps the name and the column names.
    """
    part = F.expr(f"col_ord div {10 * ROWS_PER_PART}")
    counts = schema.groupBy(*KEY).agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )
    names = (
        schema.groupBy(*KEY, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("col_ord", "col_name"))).alias("_cols"))
        .select(*KEY, "part", F.transform("_cols", lambda c: c["col_name"]).alias("column_names"))
    )
    table_name = F.concat("record_id", F.lit("_table")).alias("table_name")
    if compact:
        return names.select(table_name, "part", "column_names")
    return names.join(counts, KEY).select(
        *KEY,
        table_name,
        "row_count",
        "column_count",
        "part",
        "column_names",
    )


def table_head(cells: DataFrame, count: int) -> DataFrame:
    """Cells of the first ``count`` rows of every table; each task drops later rows before they are shuffled."""
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row_ord"))
    return cells.withColumn("_rank", rank).filter(F.col("_rank") <= count).select(*cells.columns)


def show_tables(
    records: DataFrame, cells: DataFrame, schema: DataFrame, structure: DataFrame, text_limit: int = 500
) -> DataFrame:
    """Table cards: context texts, column types, structure analysis and the data, in parts of rows.

    ``part`` counts blocks of ROWS_PER_PART rows; an ordinary table has part 0 only.
    """
    packed = (
        cells.withColumn("part", F.expr(f"row_ord div {ROWS_PER_PART}"))
        .groupBy(*KEY, "part")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("row_ord", "col_ord", "row_name", "col_name", "raw"))
            ).alias("data")
        )
    )
    columns = schema.groupBy(*KEY).agg(
        F.max("row_count").alias("total_rows"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_ord", "col_name", "column_type", "nullable"))),
            lambda c: F.struct(
                c["col_name"].alias("name"), c["column_type"].alias("type"), c["nullable"].alias("nullable")
            ),
        ).alias("columns"),
    )
    texts = records.select(
        *KEY,
        shorten(F.col("pre_text"), text_limit).alias("pre_text"),
        shorten(F.col("post_text"), text_limit).alias("post_text"),
    )
    return (
        packed.join(columns, KEY)
        .join(texts, KEY, "left")
        .join(structure, KEY, "left")
        .select(
            *KEY,
            F.concat("record_id", F.lit("_table")).alias("table_name"),
            "part",
            "total_rows",
            "columns",
            "pre_text",
            "post_text",
            *[c for c in structure.columns if c not in KEY],
            "data",
        )
    )


def compact_cards(cells: DataFrame) -> DataFrame:
    """Short table cards: column names, row names and the data in row and column order, in parts of rows."""

    def names(order: str, name: str) -> Column:
        return F.transform(F.array_sort(F.collect_set(F.struct(order, name))), lambda l: l[name])

    values = F.array_sort(F.collect_list(F.struct("row_ord", "col_ord", "row_name", "col_name", "raw")))
    return cells.groupBy(*KEY, F.expr(f"row_ord div {ROWS_PER_PART}").alias("part")).agg(
        names("col_ord", "col_name").alias("cols"),
        names("row_ord", "row_name").alias("rows"),
        values.alias("data"),
    )


def cards_as_json(cards: DataFrame) -> DataFrame:
    """Each card as one JSON text, nulls kept."""
    return cards.select(
        "record_id", F.to_json(F.struct(*cards.columns), {"ignoreNullFields": "false"}).alias("card")
    )


def cards_from_json(texts: DataFrame, like: DataFrame, column: str = "card") -> DataFrame:
    """The cards that ``cards_as_json`` wrote; ``like`` has their columns."""
    card = F.from_json(column, like.schema, {"mode": "FAILFAST"})
    return texts.select(card.alias("_card")).select("_card.*")


def wide_table(cells: DataFrame, record_id: str, column_names: list[str]) -> DataFrame:
    """One record's table with real columns; the names are given, so no extra pass finds them."""
    return (
        cells.filter(F.col("record_id") == record_id)
        .groupBy("row_ord", "row_name")
        .pivot("col_name", column_names)
        .agg(F.first("raw"))
        .orderBy("row_ord")
    )


def _targets(requests: DataFrame) -> DataFrame:
    """request_id, record_id, position and name of every requested column, repeated names once."""
    named = requests.select(
        "request_id", "record_id", F.posexplode("target_columns").alias("target_pos", "col_name")
    )
    return named.groupBy("request_id", "record_id", "col_name").agg(F.min("target_pos").alias("target_pos"))


def choose_columns(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """The requested columns that exist; all columns, flagged, for a request where none does."""
    columns = cells.select("record_id", "col_ord", "col_name").distinct()
    found = _targets(requests).join(columns, ["record_id", "col_name"]).withColumn(
        "fallback", F.lit(False)
    )
    unmet = requests.select("request_id", "record_id").join(
        found.select("request_id").distinct(), "request_id", "left_anti"
    )
    everything = unmet.join(columns, "record_id").select(
        "request_id", "record_id", "col_name", F.col("col_ord").alias("target_pos"), "col_ord",
        F.lit(True).alias("fallback"),
    )
    return found.select(everything.columns).unionByName(everything)


def select_columns(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the chosen columns, per request."""
    return (
        choose_columns(requests, cells)
        .join(cells.select("record_id", "col_ord", "row_ord", "row_name", "raw"), ["record_id", "col_ord"])
        .select(
            "request_id", "record_id", "target_pos", "col_name", "row_ord", "row_name", "raw", "fallback"
        )
    )


def column_sums(cells: DataFrame, types: DataFrame, faithful: bool = False) -> DataFrame:
    """Sum of every numeric column, missing values skipped."""
    typed = typed_cells(cells, types.filter("column_type = 'numeric'"), faithful)
    return (
        typed.withColumn("_exact", to_exact(F.col("raw"), F.col("num")))
        .groupBy("record_id", "col_ord", "col_name")
        .agg(exact_sum(F.col("_exact"), F.col("num")).alias("total"))
    )


def column_totals(
    requests: DataFrame, cells: DataFrame, types: DataFrame, faithful: bool = False
) -> DataFrame:
    """``{column}_total`` per requested numeric column; one error row listing the numeric columns otherwise.

    Every request has a row, also one on an unknown table or without a list of columns. ``types`` needs KEY, col_ord,
    col_name and column_type; where it has ``total`` too, as ``column_facts`` returns, the cells are not read again. A
    request meets one list of its table's numeric columns.
    """
    numeric = types.filter("column_type = 'numeric'")
    if faithful or "total" not in types.columns:
        sums = column_sums(cells, types, faithful)
        numeric = numeric.drop("total").join(sums, ["record_id", "col_ord", "col_name"])
    available = numeric.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("col_ord", "col_name", "total"))).alias("_columns")
    )
    names, columns = F.array_distinct("target_columns"), F.col("_columns")
    hits = F.flatten(
        F.transform(
            names,
            lambda name: F.transform(
                F.filter(columns, lambda c: c["col_name"] == name),
                lambda c: F.struct(
                    (F.array_position("target_columns", name) - 1).cast("int").alias("target_pos"),
                    F.concat(c["col_name"], F.lit("_total")).alias("total_name"),
                    c["total"].alias("total"),
                ),
            ),
        )
    )
    none = F.struct(
        F.lit(0).alias("target_pos"),
        F.lit(None).cast("string").alias("total_name"),
        F.lit(None).cast("double").alias("total"),
    )
    missed = F.coalesce(F.size("_hits"), F.lit(0)) <= 0
    listed = F.coalesce(F.array_join(F.transform("_columns", lambda c: c["col_name"]), ", "), F.lit(""))
    return (
        requests.select("request_id", "record_id", "target_columns")
        .join(available, "record_id", "left")
        .withColumn("_hits", hits)
        .select(
            "request_id",
            "record_id",
            F.inline(F.when(missed, F.array(none)).otherwise(F.col("_hits"))),
            F.when(missed, "NO_NUMERIC_COLUMNS").otherwise("OK").alias("status"),
            F.when(missed, listed).alias("numeric_columns"),
        )
    )


def first_numeric_sum(
    requests: DataFrame, cells: DataFrame, types: DataFrame, faithful: bool = False
) -> DataFrame:
    """Sum of the first requested column that is numeric; a request naming none takes the table's first.

    Every request has a row; ``status`` says where there is no numeric column to add up.
    """
    sums = column_sums(cells, types, faithful)
    named = F.coalesce(F.size("target_columns"), F.lit(0)) > 0
    option = F.struct("pos", "col_name", "total")
    by_name = (
        _targets(requests.filter(named))
        .join(sums, ["record_id", "col_name"])
        .withColumn("pos", F.col("target_pos"))
        .groupBy("request_id")
        .agg(F.min(option).alias("_pick"))
    )
    first = sums.withColumn("pos", F.col("col_ord")).groupBy("record_id").agg(F.min(option).alias("_first"))
    picked = F.when(F.col("_named"), F.col("_pick")).otherwise(F.col("_first"))
    return (
        requests.select("request_id", "record_id", named.alias("_named"))
        .join(by_name, "request_id", "left")
        .join(first, "record_id", "left")
        .select(
            "request_id",
            "record_id",
            picked["col_name"].alias("col_name"),
            picked["total"].alias("total"),
            F.when(picked["col_name"].isNull(), "NO_NUMERIC_COLUMNS").otherwise("OK").alias("status"),
        )
    )
