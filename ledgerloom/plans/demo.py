"""Records, tables, dialogues, predictions and requests derived from the supplied tables.

A customer is a record, an order year a column, an order priority a row, and the summed order value a cell,
written in different formats so that type inference and parsing have work to do. Everything grows with the
orders, customers, events, conversations and documents it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.operators.dialogue import pair_messages


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _split(key: Column) -> Column:
    return F.when(key % 4 == 0, "dev").otherwise("train")


def _row_name() -> Column:
    """Row label of a priority, the first three with a financial term."""
    digit, priority = F.substring("priority", 1, 1), F.col("priority")
    return (
        F.when(digit == "1", _text("total revenue (", priority, ")"))
        .when(digit == "2", _text("net income (", priority, ")"))
        .when(digit == "3", _text("operating costs (", priority, ")"))
        .otherwise(priority)
    )


def _amounts(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """One row per customer, priority and year: rec_ord, record_id, priority, row_ord, row_name, yr, amt and ``more``."""
    # One shuffle by customer serves the aggregate, windows and the join. Hardly two orders share a customer, priority and
    # year, so combining them before the shuffle would only hold as many groups as a task reads orders.
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("rec_ord"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("yr"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    ).repartition("rec_ord")
    amounts = orders.groupBy("rec_ord", "priority", "yr").agg(F.sum("price").alias("amt")).select("*", *more)
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("rec_ord"), F.col("c_name").alias("record_id")
    )
    return amounts.join(names, "rec_ord").select(
        "rec_ord",
        "record_id",
        "priority",
        (F.substring("priority", 1, 1).cast("int") - 1).alias("row_ord"),
        _row_name().alias("row_name"),
        *[c for c in amounts.columns if c not in ("rec_ord", "priority")],
    )


def _years() -> WindowSpec:
    return Window.partitionBy("rec_ord", "priority").orderBy("yr")


def yearly(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and priority with its years: rec_ord, record_id, row_ord, row_name, years."""
    return (
        _amounts(spark, folder)
        .groupBy("rec_ord", "record_id", "priority", "row_ord", "row_name")
        .agg(F.array_sort(F.collect_list(F.struct("yr", "amt"))).alias("years"))
        .drop("priority")
    )


def _formatted(yr: Column, amt: Column) -> Column:
    """A value written plainly, as currency, in parentheses, as a percentage, or partly missing."""
    style, text = F.pmod(yr + F.col("rec_ord"), F.lit(5)), amt.cast("string")
    return (
        F.when(style == 0, text)
        .when(style == 1, _text("$", text))
        .when(style == 2, _text("(", text, ")"))
        .when(style == 3, _text(text, "%"))
        .when(F.col("row_ord") % 2 == 0, text)
        .otherwise("n/a")
    )


def _as_of() -> Column:
    """A date column: one layout, another layout, or mixed layouts, by record."""
    iso = _text((F.col("row_ord") + 2001).cast("string"), "-12-31")
    kind = F.col("rec_ord") % 3
    return (
        F.when(kind == 0, iso)
        .when(kind == 1, "12/31/2001")
        .when(F.col("row_ord") % 2 == 0, iso)
        .otherwise("Dec 31, 2001")
    )


def _cell(order: Column, name: Column, raw: Column) -> Column:
    return F.struct(order.cast("int").alias("col_ord"), name.alias("col_name"), raw.alias("raw"))


def _amount_cell() -> Column:
    yr = F.col("yr")
    return _cell(yr, yr.cast("string"), _formatted(yr, F.col("amt")))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """A cell per year; the first year of a row brings the row's other two cells along."""
    extra = F.array(
        _cell(F.lit(9998), F.lit("as_of"), _as_of()),
        _cell(F.lit(9999), F.lit("note"), _text("see ", F.col("row_name"))),
    )
    values = F.array(_amount_cell())
    opens = (F.row_number().over(_years()) == 1).alias("_opens")
    return _amounts(spark, folder, opens).select(
        "rec_ord", "record_id", "row_ord", "row_name",
        F.inline(F.when(F.col("_opens"), F.concat(values, extra)).otherwise(values)),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Three questions per row and pair of adjacent years: a lookup, a change, a percentage change."""
    following = [F.lead(c).over(_years()).alias(name) for c, name in (("yr", "_next"), ("amt", "new"))]
    pairs = (
        _amounts(spark, folder, *following)
        .withColumn("old", F.col("amt"))
        .filter("_next = yr + 1 AND old IS NOT NULL AND new IS NOT NULL")
    )
    old, new = F.col("old").cast("string"), F.col("new").cast("string")
    since, until = F.col("yr").cast("string"), (F.col("yr") + 1).cast("string")
    rise = F.col("new") - F.col("old")
    share = F.round(rise.cast("double") / F.col("old").cast("double"), 5).cast("decimal(18,5)").cast("string")
    # The last digit of the year tells the pairs of a row apart.
    first = (F.col("row_ord") * 10 + F.col("yr") % 10) * 3 + 1

    def turn(number: Column, question: Column, answer: Column, program: Column) -> Column:
        return F.struct(
            number.cast("int").alias("turn"),
            question.alias("question"),
            answer.alias("answer"),
            program.alias("program"),
        )

    subtract = _text("subtract(", new, ", ", old, ")")
    three = F.array(
        turn(first, _text("what was ", F.col("row_name"), " in ", since, "?"), old, old),
        turn(first + 1, _text("and what was the change from ", since, " to ", until, "?"), rise.cast("string"), subtract),
        turn(
            first + 2,
            F.lit("so what was the percentage change?"),
            share,
            _text(subtract, ", divide(#0, ", old, ")"),
        ),
    )
    return pairs.select("rec_ord", "record_id", F.inline(three)).select(
        _split(F.col("rec_ord")).alias("split"),
        "*",
        F.col("answer").alias("executed_answer"),
        (F.col("rec_ord") % 3 == 0).alias("is_hybrid"),
    )


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions for four fifths of the turns, a third of them wrong, some failed."""
    mark = F.col("turn") + F.col("rec_ord")
    return turns(spark, folder).filter(mark % 5 != 0).select(
        "record_id",
        "turn",
        F.when(mark % 3 == 0, "The answer is 1.")
        .otherwise(_text("In 1998 the answer is $", F.col("answer")))
        .alias("actual"),
        F.when(mark % 11 == 0, "timeout").alias("error"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("rec_ord"), F.col("c_name").alias("record_id"), "c_mktsegment"
    )
    texts = table(spark, folder, "documents").select(
        F.col("doc_id").alias("rec_ord"), F.col("text").alias("pre_text")
    )
    key = F.col("rec_ord")
    return customers.join(texts, "rec_ord", "left").select(
        _split(key).alias("split"),
        "rec_ord",
        "record_id",
        F.coalesce("pre_text", F.lit("")).alias("pre_text"),
        _text("segment ", F.col("c_mktsegment")).alias("post_text"),
        F.create_map(
            F.lit("has_type2_question"), F.when(key % 3 == 0, "true").otherwise("false")
        ).alias("features"),
    )


def record_keys(spark: SparkSession, folder: str) -> DataFrame:
    """split, rec_ord, record_id without the texts."""
    return table(spark, folder, "customer").select(
        _split(F.col("c_custkey")).alias("split"),
        F.col("c_custkey").alias("rec_ord"),
        F.col("c_name").alias("record_id"),
    )


def messy_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Record keys with blank ids and ids used twice."""
    key = F.col("rec_ord")
    doubled = _text("Customer#", F.lpad((key - 1).cast("string"), 9, "0"))
    return record_keys(spark, folder).withColumn(
        "record_id",
        F.when(key % 97 == 5, "").when(key % 50 == 7, doubled).otherwise(F.col("record_id")),
    )


def messy_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells without those of every 13th record, and with one column label doubled in every 17th."""
    key = F.col("rec_ord")
    return (
        cells(spark, folder)
        .filter(key % 13 != 3)
        .withColumn(
            "col_name", F.when((key % 17 == 4) & (F.col("col_ord") == 9999), "as_of").otherwise(F.col("col_name"))
        )
    )


def id_requests(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, folder, "customer").select(
        key.alias("request_id"),
        F.when(key % 4 == 0, name)
        .when(key % 16 == 1, "CUSTOMER#00000")
        .when(key % 4 == 1, F.lower(name))
        .when(key % 4 == 2, F.substring(name, 13, 6))
        .otherwise(_text("nobody ", key.cast("string")))
        .alias("record_id"),
    )


def _amount_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _amounts(spark, folder).filter("yr < 9000").select(
        "rec_ord", "record_id", "row_ord", "row_name", F.inline(F.array(_amount_cell()))
    )


def value_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup for every value, worded exactly, in capitals, shortened, embedded, wrongly or not at all."""
    row, column = F.col("row_name"), F.col("col_name")
    wording = F.pmod(F.col("rec_ord") + F.col("row_ord") + F.col("col_ord"), F.lit(7))
    return _amount_cells(spark, folder).select(
        (F.col("rec_ord") * 100000 + F.col("row_ord") * 10000 + F.col("col_ord")).alias("request_id"),
        "record_id",
        F.when(wording == 1, F.upper(row))
        .when(wording == 2, F.substring(row, 1, 8))
        .when(wording == 3, _text("the ", row, " row"))
        .when(wording == 4, "@@@@")
        .when(wording == 5, F.when(F.col("row_ord") == 0, "").otherwise(F.substring(row, 1, 3)))
        .otherwise(row)
        .alias("row_identifier"),
        F.when(wording == 3, _text("fiscal ", column))
        .when((wording == 0) & (F.col("row_ord") == 4), "####")
        .when(wording == 6, "note")
        .otherwise(column)
        .alias("column_identifier"),
    )


def misspelt_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups whose row label has letters replaced, so that only similarity finds it."""
    return _amount_cells(spark, folder).select(
        (F.col("rec_ord") * 100000 + F.col("row_ord") * 10000 + F.col("col_ord")).alias("request_id"),
        "record_id",
        F.translate(F.upper("row_name"), "AEO", "xyz").alias("row_identifier"),
        F.col("col_name").alias("column_identifier"),
    )


def change_jobs(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("auto", "standard", "cost", "percentage", "simple")])
    return yearly(spark, folder).select(
        (F.col("rec_ord") * 10 + F.col("row_ord")).alias("request_id"),
        "record_id",
        F.col("row_name").alias("row_identifier"),
        F.lit("1997").alias("old_column"),
        F.lit("fiscal 1998").alias("new_column"),
        F.get(kinds, F.col("row_ord")).alias("change_type"),
    )


def column_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Per record a list of wanted columns: some, one that is text and one unknown, only unknown ones, or none."""
    key = F.col("rec_ord")

    def names(*words: str) -> Column:
        return F.array(*[F.lit(w) for w in words])

    return record_keys(spark, folder).select(
        key.alias("request_id"),
        "record_id",
        F.when(key % 12 == 5, F.lit(None).cast("array<string>"))
        .when(key % 12 == 2, F.array().cast("array<string>"))
        .when(key % 3 == 0, names("1998", "1996", "1997"))
        .when(key % 3 == 1, names("note", "1999", "none"))
        .otherwise(names("none", "nothing"))
        .alias("target_columns"),
    )


def text_requests(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("rec_ord")
    columns = column_requests(spark, folder).select(F.col("request_id").alias("rec_ord"), "target_columns")
    return record_keys(spark, folder).join(columns, "rec_ord").select(
        key.alias("request_id"),
        "record_id",
        F.when(key % 5 == 0, "what was the Increase in revenue?")
        .when(key % 5 == 1, "calculate the average")
        .when(key % 5 == 2, "1997 versus 1998")
        .otherwise("show the latest figures")
        .alias("query"),
        F.when(key % 7 == 0, "aggregate").alias("operation"),
        F.when(key % 2 == 0, F.col("target_columns")).alias("target_columns"),
    )


def expressions(spark: SparkSession, folder: str) -> DataFrame:
    """A computation per order, in words, as a call or as plain arithmetic."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    key, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate").cast("string")
    kind = key % 13
    spoken = (
        F.when(kind == 0, _text("add(", price, ", ", day, ")"))
        .when(kind == 1, _text(price, " / ", day))
        .when(kind == 2, _text("difference of ", price, " and ", day))
        .when(kind == 3, _text(price, " times ", day))
        .when(kind == 4, _text("divide(", price, ", 0)"))
        .when(kind == 5, "nothing to compute")
        .when(kind == 6, _text("only ", price))
        .when(kind == 7, _text(day, " * -3"))
        .when(kind == 8, _text("(", price, " - ", day, ") / ", day))
        .when(kind == 9, _text("-(", price, " + ", day, ") * 2"))
        .when(kind == 10, _text("abs(", day, " - ", price, ") + 2 ** 3 ** 1"))
        .when(kind == 11, _text(price, " - ", day, " - ", day, " * 2"))
        .otherwise(_text(price, " over ", day))
    )
    return table(spark, folder, "orders").select(key.alias("request_id"), spoken.alias("expression"))


def compute_jobs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("rec_ord")
    return record_keys(spark, folder).select(
        key.alias("request_id"),
        "record_id",
        F.when(key % 3 == 0, "total of the table")
        .when(key % 3 == 1, _text("add(", key.cast("string"), ", 20)"))
        .otherwise("sum 5 and 6")
        .alias("expression"),
    )


def axis_roles(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("rec_ord")
    return record_keys(spark, folder).filter(key % 10 != 9).select(
        "record_id",
        F.when(key % 2 == 0, "time_series").otherwise("metrics_by_categories").alias("table_type"),
        F.when(key % 2 == 0, "columns").otherwise("rows").alias("time_axis"),
        F.when(key % 3 == 0, "columns").otherwise("rows").alias("metric_axis"),
        F.when(key % 5 == 0, "high").when(key % 5 == 1, "medium").when(key % 5 == 2, "low").alias("confidence"),
    )


def chat_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns paired from the conversations."""
    return pair_messages(table(spark, folder, "conversations")).select(
        F.col("conv_id").cast("string").alias("session_id"), "seq", "user_message", "assistant_response"
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns made of events: a user is a session, an event a turn."""
    key, kind = F.col("event_id"), F.col("event_type")
    amount = F.col("value").cast("decimal(18,2)").cast("string")

    def called(*names: Column) -> Column:
        return F.array(*[F.create_map(F.lit("tool_name"), n) for n in names])

    none = F.array().cast("array<map<string,string>>")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("record_id"),
        key.alias("seq"),
        _text("show ", kind).alias("user_message"),
        _text("the ", kind, " Table holds ", amount).alias("assistant_response"),
        "ts",
        F.when(key % 9 == 0, called(kind, F.lit("compute"))).when(key % 3 == 0, called(kind)).otherwise(none)
        .alias("tool_calls"),
        F.when(key % 5 == 0, F.array(kind, F.lit("financial_table"), kind)).otherwise(F.array(kind))
        .alias("referenced_entities"),
        F.when(key % 4 == 0, F.array(F.create_map(F.lit("result"), amount))).otherwise(none)
        .alias("computation_results"),
    )
