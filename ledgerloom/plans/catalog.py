"""One query per operator over the supplied tables: name to function of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numeric, programs, text
from ledgerloom.operators import (
    dialogue,
    evaluation,
    matching,
    records,
    requests,
    structure,
    tables,
)
from ledgerloom.plans import demo
from ledgerloom.session import shared_folder, tune
from ledgerloom.sources import corpus, ledger, turnlog
from ledgerloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        _QUERIES[name] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _joined(column: Column | str) -> Column:
    return F.array_join(column, "|")


def _schema(spark: SparkSession, folder: str) -> DataFrame:
    return tables.build_schema(demo.cells(spark, folder))


def _results(spark: SparkSession, folder: str, **options) -> DataFrame:
    return evaluation.score(demo.preds(spark, folder), demo.turns(spark, folder), **options)


# --- sources and sinks ---------------------------------------------------------------------------


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The demonstration corpus in the nested shape corpora are read in."""
    cells = demo.cells(spark, folder)
    columns = cells.groupBy("rec_ord", "col_ord", "col_name").agg(
        F.array_sort(F.collect_list(F.struct("row_ord", "row_name", "raw"))).alias("_rows")
    )
    grids = columns.groupBy("rec_ord").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_ord", "col_name", "_rows"))),
                lambda c: F.struct(
                    c["col_name"],
                    F.map_from_entries(F.transform(c["_rows"], lambda r: F.struct(r["row_name"], r["raw"]))),
                ),
            )
        ).alias("table")
    )
    asked = (
        demo.turns(spark, folder)
        .groupBy("rec_ord")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("turn", "question", "answer", "program", "executed_answer"))
            ).alias("t")
        )
    )

    def listed(name: str) -> Column:
        return F.transform(F.coalesce("t", F.array()), lambda x: x[name])

    return (
        demo.records(spark, folder)
        .join(grids, "rec_ord", "left")
        .join(asked, "rec_ord", "left")
        .select(
            "split",
            "rec_ord",
            F.col("record_id").alias("id"),
            F.struct("pre_text", "post_text", F.coalesce("table", F.create_map()).alias("table")).alias("doc"),
            F.when(F.col("t").isNotNull(), F.struct(
                listed("question").alias("conv_questions"),
                listed("answer").alias("conv_answers"),
                listed("program").alias("turn_program"),
                listed("executed_answer").alias("executed_answers"),
                F.transform(listed("turn"), lambda n: n % 2 == 0).alias("qa_split"),
            )).alias("dialogue"),
            "features",
        )
    )


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The demonstration corpus, written as JSON lines and read from there."""
    path = shared_folder(spark, "corpus")
    _corpus(spark, folder).write.json(path)
    return corpus.read_corpus(spark, path, "lines")


@_query("s1_corpus_scan")
def _(spark, folder):
    return records.corpus_counts(corpus.normalize_records(_read_back(spark, folder)))


@_query("s1_corpus_fields")
def _(spark, folder):
    def pairs(entries: Column, render) -> Column:
        return F.array_join(F.transform(F.map_entries(entries), render), ";")

    table = pairs(
        F.col("doc.table"),
        lambda c: F.concat(c["key"], F.lit("{"), pairs(c["value"], lambda r: F.concat(r["key"], F.lit("="), r["value"])), F.lit("}")),
    )
    said = [F.array_join(F.col(f"dialogue.{n}").cast("array<string>"), "|").alias(n) for n in (
        "conv_questions", "conv_answers", "turn_program", "executed_answers", "qa_split"
    )]
    return _read_back(spark, folder).select(
        "split", "rec_ord", "id", F.col("doc.pre_text").alias("pre_text"), F.col("doc.post_text").alias("post_text"),
        table.alias("table_text"), *said, F.element_at("features", "has_type2_question").alias("has_type2_question"),
    )


@_query("s2_normalize_cells")
def _(spark, folder):
    return corpus.normalize_cells(_corpus(spark, folder)).select(
        "split", "rec_ord", "record_id", "col_ord", "col_name", "row_ord", "row_name", "raw"
    )


@_query("s2_normalize_records")
def _(spark, folder):
    return corpus.normalize_records(_corpus(spark, folder)).select(
        "split", "rec_ord", "record_id", "pre_text", "post_text",
        F.element_at("features", "has_type2_question").alias("has_type2_question"),
    )


@_query("s2_normalize_turns")
def _(spark, folder):
    return corpus.normalize_turns(_corpus(spark, folder)).select(
        "split", "rec_ord", "record_id", "turn", "question", "answer", "program", "executed_answer",
        "qa_split", "is_hybrid",
    )


@_query("j5_unequal_turn_lists")
def _(spark, folder):
    """Dialogues whose lists are cut to different lengths."""
    def cut(name: str, count: Column) -> Column:
        listed = F.col(f"dialogue.{name}")
        return F.slice(listed, 1, F.greatest(F.size(listed) - count, F.lit(0)))

    key = F.col("rec_ord")
    lists = {"conv_questions": key % 3, "conv_answers": key % 5, "turn_program": key % 7, "qa_split": key % 2}
    dialogue_ = F.col("dialogue")
    for name, count in lists.items():
        dialogue_ = dialogue_.withField(name, cut(name, count.cast("int")))
    return corpus.normalize_turns(_corpus(spark, folder).withColumn("dialogue", dialogue_)).select(
        "rec_ord", "record_id", "turn", "question", "answer", "program", "executed_answer", "qa_split"
    )


@_query("s3_list_records")
def _(spark, folder):
    return records.list_records(demo.record_keys(spark, folder), "dev", 10)


@_query("s3_list_all_records")
def _(spark, folder):
    return records.list_records(demo.record_keys(spark, folder), None, None)


@_query("s3_listing_counts")
def _(spark, folder):
    return records.listing_counts(demo.record_keys(spark, folder), 10)


@_query("s4_lookup_records")
def _(spark, folder):
    usable = records.usable_records(demo.messy_keys(spark, folder), demo.messy_cells(spark, folder))
    return records.lookup_records(demo.id_requests(spark, folder), usable).withColumn(
        "similar_records", _joined("similar_records")
    )


@_query("s5_remaining_turns")
def _(spark, folder):
    """Turns of the first records and questions that earlier runs have not scored."""
    limited = ledger.limit_turns(demo.turns(spark, folder), max_records=500, max_questions=9)
    done = demo.record_keys(spark, folder).filter("rec_ord % 3 = 0")
    return ledger.remaining(limited, done).select("rec_ord", "record_id", "turn", "question")


@_query("s5_incremental_ledger")
def _(spark, folder):
    """Two runs into one ledger: half of the predictions first, then all of them."""
    preds, turns = demo.preds(spark, folder), demo.turns(spark, folder)
    path = shared_folder(spark, "ledger")
    early = preds.join(
        demo.record_keys(spark, folder).filter("rec_ord % 2 = 0"), "record_id", "left_semi"
    ).select(*preds.columns)
    ledger.evaluate_incremental(early, turns, path)
    return evaluation.accuracy_breakdown(ledger.evaluate_incremental(preds, turns, path))


@_query("s6_list_sessions")
def _(spark, folder):
    return turnlog.list_sessions(demo.event_log(spark, folder)).select(
        "session_id", _stamp("created_at"), "record_id", "turn_count"
    )


@_query("s6_load_session")
def _(spark, folder):
    return turnlog.load_session(demo.event_log(spark, folder), "7").select(
        "session_id", "seq", "user_message", "assistant_response"
    )


@_query("s6_delete_sessions")
def _(spark, folder):
    log = demo.event_log(spark, folder)
    doomed = log.filter(F.col("session_id").cast("long") % 3 == 0).select("session_id")
    path = shared_folder(spark, "turnlog")
    turnlog.delete_sessions(log, doomed, path)
    return (
        turnlog.read_turns(spark, path)
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("turn_count"), F.max("seq").alias("last_seq"))
    )


@_query("s7_quality_issues")
def _(spark, folder):
    return records.quality_issues(demo.messy_keys(spark, folder), demo.messy_cells(spark, folder))


# --- projections, filters, packaging -------------------------------------------------------------


@_query("s7_malformed_records")
def _(spark, folder):
    """Every 11th record cut short, every 13th without its dialogue."""
    key = F.col("rec_ord")
    packed = _corpus(spark, folder).withColumn("dialogue", F.when(key % 13 != 0, F.col("dialogue")))
    line = F.to_json(F.struct("*"))
    cut = F.when(key % 11 == 0, F.concat(F.lit('{"rec_ord": '), key.cast("string"), F.lit(', "id"'))).otherwise(line)
    broken = corpus.malformed_records(packed.select(cut.alias("value")))
    return broken.groupBy(F.col("detail").isNotNull().alias("cut_short")).agg(F.count(F.lit(1)).alias("lines"))


@_query("p1_select_columns")
def _(spark, folder):
    return tables.select_columns(demo.column_requests(spark, folder), demo.cells(spark, folder))


@_query("p2_table_head")
def _(spark, folder):
    return tables.table_head(demo.cells(spark, folder), 3)


@_query("p3_list_tables")
def _(spark, folder):
    return tables.list_tables(_schema(spark, folder)).withColumn("column_names", _joined("column_names"))


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    cells = demo.cells(spark, folder)
    return tables.show_tables(
        demo.records(spark, folder), cells, tables.build_schema(cells), structure.classify_structure(cells)
    )


def _card_texts(cards: DataFrame) -> DataFrame:
    return cards.select(
        "record_id",
        "table_name",
        "part",
        "total_rows",
        _joined(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"]))).alias("columns"),
        "pre_text",
        "post_text",
        "structure",
        _joined(
            F.transform("data", lambda v: F.concat_ws("/", v["row_name"], v["col_name"], v["raw"]))
        ).alias("data"),
    )


@_query("p4_table_cards")
def _(spark, folder):
    return _card_texts(_cards(spark, folder))


@_query("p3_list_tables_compact")
def _(spark, folder):
    return tables.list_tables(_schema(spark, folder), compact=True).withColumn(
        "column_names", _joined("column_names")
    )


@_query("p4_compact_cards")
def _(spark, folder):
    return tables.compact_cards(demo.cells(spark, folder)).select(
        "record_id",
        "part",
        _joined("cols").alias("cols"),
        _joined("rows").alias("rows"),
        _joined(F.transform("data", lambda v: v["raw"])).alias("data"),
    )


@_query("p4_table_cards_json")
def _(spark, folder):
    """Cards written as JSON and read again."""
    cards = _cards(spark, folder)
    return _card_texts(tables.cards_from_json(tables.cards_as_json(cards), cards))


@_query("p5_dialogue_view")
def _(spark, folder):
    return dialogue.dialogue_view(demo.turns(spark, folder))


# --- table shaping, schema, structure ------------------------------------------------------------


@_query("t1_densify")
def _(spark, folder):
    return tables.densify(demo.cells(spark, folder))


@_query("t2_column_types")
def _(spark, folder):
    return tables.infer_column_types(demo.cells(spark, folder))


@_query("t3_schema")
def _(spark, folder):
    return _schema(spark, folder)


@_query("t4_typed_cells")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    return tables.typed_cells(cells, tables.infer_column_types(cells))


@_query("t4_typed_cells_faithful")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    return tables.typed_cells(cells, tables.infer_column_types(cells), faithful=True)


@_query("t4_conversion_warnings")
def _(spark, folder):
    return tables.conversion_warnings(demo.cells(spark, folder))


@_query("t5_corpus_counts")
def _(spark, folder):
    return records.corpus_counts(demo.record_keys(spark, folder))


@_query("t5_column_type_histogram")
def _(spark, folder):
    return records.column_type_histogram(
        demo.record_keys(spark, folder), tables.infer_column_types(demo.cells(spark, folder)), 100
    )


@_query("t5_column_type_histogram_all")
def _(spark, folder):
    return records.column_type_histogram(
        demo.record_keys(spark, folder), tables.infer_column_types(demo.cells(spark, folder)), None
    )


@_query("t5_table_shapes")
def _(spark, folder):
    return records.table_shapes(demo.record_keys(spark, folder), demo.cells(spark, folder), 10)


@_query("t6_structure")
def _(spark, folder):
    return structure.classify_structure(demo.cells(spark, folder))


@_query("t7_structure_guide")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    guide = structure.structure_guide(cells, tables.build_schema(cells))
    return guide.select(
        "record_id",
        "structure",
        F.col("guide")["structure"].alias("headline"),
        F.coalesce(F.col("guide")["columns"], F.col("guide")["time_elements"]).alias("times"),
        F.coalesce(F.col("guide")["rows"], F.col("guide")["metric_elements"]).alias("metrics"),
        F.size("data_types").cast("long").alias("typed_columns"),
    )


@_query("t8_axis_roles")
def _(spark, folder):
    return structure.apply_axis_labels(demo.cells(spark, folder), demo.axis_roles(spark, folder))


@_query("t8_labelled_guide")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    guide = structure.labelled_guide(cells, demo.axis_roles(spark, folder), tables.build_schema(cells))
    entries = F.map_entries("data_types")
    return guide.select(
        "record_id",
        "structure",
        F.col("guide")["structure"].alias("headline"),
        F.coalesce(F.col("guide")["columns"], F.col("guide")["organization"]).alias("times"),
        F.col("guide")["rows"].alias("metrics"),
        F.col("guide")["reading_guide"].alias("reading_guide"),
        _joined(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("data_types"),
    )


@_query("t8_labelled_axes")
def _(spark, folder):
    return structure.labelled_axes(demo.cells(spark, folder), demo.axis_roles(spark, folder))


# --- joins and matching --------------------------------------------------------------------------


@_query("j1_match_columns")
def _(spark, folder):
    return matching.match_columns(demo.value_requests(spark, folder), demo.cells(spark, folder)).select(
        "request_id", "matched_column", "column_match"
    )


@_query("j1_match_column_lists")
def _(spark, folder):
    wanted = demo.column_requests(spark, folder).withColumn(
        "target_columns",
        F.transform("target_columns", lambda n: F.concat(F.lit(" Fiscal "), n)),
    )
    return matching.match_column_lists(wanted, demo.cells(spark, folder)).withColumn(
        "target_columns", _joined("target_columns")
    )


@_query("j2_closest_label")
def _(spark, folder):
    return matching.closest_label(demo.value_requests(spark, folder), demo.cells(spark, folder)).select(
        "request_id", "matched_label", "confidence"
    )


@_query("j3_match_rows_direct")
def _(spark, folder):
    return matching.match_rows(
        demo.value_requests(spark, folder), demo.cells(spark, folder), fuzzy=False
    ).select("request_id", "matched_row", "row_match", F.col("row_score").cast("double").alias("row_score"))


@_query("j3_match_rows_similar")
def _(spark, folder):
    return matching.match_rows(demo.misspelt_requests(spark, folder), demo.cells(spark, folder)).select(
        "request_id", "matched_row", "row_match", "row_score"
    )


@_query("j4_get_values")
def _(spark, folder):
    return matching.get_values(demo.value_requests(spark, folder), demo.cells(spark, folder)).select(
        "request_id", "matched_row", "matched_column", "value", "value_text", "status",
        _joined("available").alias("available"),
    )


@_query("j6_score_predictions")
def _(spark, folder):
    return _results(spark, folder)


@_query("j6_score_predictions_compat")
def _(spark, folder):
    return _results(spark, folder, policy="primary", drop_failed=True, plain_types=True)


@_query("j7_entity_index")
def _(spark, folder):
    return dialogue.entity_index(demo.event_log(spark, folder))


@_query("j7_find_entity")
def _(spark, folder):
    return dialogue.find_entity(dialogue.entity_index(demo.event_log(spark, folder)), "financial_table")


@_query("j8_change_requests")
def _(spark, folder):
    return requests.change_requests(demo.change_jobs(spark, folder), demo.cells(spark, folder)).select(
        "request_id", "record_id", "change_type", "old_value", "new_value", "change", "status"
    )


@_query("j8_period_change")
def _(spark, folder):
    return requests.period_change(demo.cells(spark, folder))


# --- aggregations --------------------------------------------------------------------------------


@_query("a1_column_totals")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    facts = tables.column_facts(cells)
    return tables.column_totals(demo.column_requests(spark, folder), cells, facts).select("request_id", "total_name", "total", "status", "numeric_columns")


@_query("a2_first_numeric_sum")
def _(spark, folder):
    wanted = demo.column_requests(spark, folder).withColumn(
        "target_columns", F.when(F.col("request_id") % 4 != 0, F.col("target_columns"))
    )
    cells = demo.cells(spark, folder)
    return tables.first_numeric_sum(wanted, cells, tables.infer_column_types(cells))


@_query("a3_accuracy")
def _(spark, folder):
    return evaluation.accuracy(_results(spark, folder))


@_query("a4_accuracy_breakdown")
def _(spark, folder):
    return evaluation.accuracy_breakdown(_results(spark, folder))


@_query("a5_baseline_report")
def _(spark, folder):
    return evaluation.baseline_report(_results(spark, folder))


@_query("a6_example_results")
def _(spark, folder):
    return evaluation.example_results(_results(spark, folder), 3)


@_query("a7_entity_counts")
def _(spark, folder):
    return dialogue.entity_counts(demo.event_log(spark, folder))


# --- windows, sorts, set operations --------------------------------------------------------------


@_query("w1_turn_numbers")
def _(spark, folder):
    return dialogue.number_turns(demo.event_log(spark, folder)).select("session_id", "seq", "turn_no", "turn_id")


@_query("w2_recent_context")
def _(spark, folder):
    return dialogue.recent_context(demo.event_log(spark, folder))


@_query("w2_recent_context_chats")
def _(spark, folder):
    none = F.array().cast("array<map<string,string>>")
    log = demo.chat_log(spark, folder).withColumn("tool_calls", none).withColumn("computation_results", none)
    return dialogue.recent_context(log)


@_query("w3_qa_context")
def _(spark, folder):
    return dialogue.qa_context(demo.chat_log(spark, folder))


@_query("w4_latest_state")
def _(spark, folder):
    return dialogue.latest_state(demo.event_log(spark, folder)).select(
        "session_id",
        _joined(F.transform("last_tool_calls", lambda c: c["tool_name"])).alias("last_tools"),
        _joined(F.transform("last_computation_results", lambda c: c["result"])).alias("last_results"),
        _stamp("created_at"),
        _stamp("updated_at"),
        "turn_count",
    )


@_query("w5_running_accuracy")
def _(spark, folder):
    return evaluation.running_accuracy(_results(spark, folder))


@_query("w6_dedup_last")
def _(spark, folder):
    return records.dedup_records(demo.messy_keys(spark, folder), "last")


@_query("w6_dedup_first")
def _(spark, folder):
    return records.dedup_records(demo.messy_keys(spark, folder), "first")


@_query("o1_first_records")
def _(spark, folder):
    return records.first_records(demo.record_keys(spark, folder), 25)


@_query("u1_union_splits")
def _(spark, folder):
    keys = demo.record_keys(spark, folder)
    train, dev = (keys.filter(F.col("split") == name) for name in ("train", "dev"))
    return train.unionByName(dev)


@_query("u2_unprocessed_records")
def _(spark, folder):
    keys = demo.record_keys(spark, folder)
    return ledger.remaining(keys, demo.preds(spark, folder))


# --- scalar functions ----------------------------------------------------------------------------


@_query("f1_primary_number")
def _(spark, folder):
    documents = demo.table(spark, folder, "documents")
    return documents.select("doc_id", numeric.primary_number(F.col("text")).alias("number"))


@_query("f1_primary_number_answers")
def _(spark, folder):
    return demo.preds(spark, folder).select(
        "record_id", "turn", numeric.primary_number(F.col("actual")).alias("number")
    )


@_query("f2_last_number")
def _(spark, folder):
    documents = demo.table(spark, folder, "documents")
    return documents.select("doc_id", numeric.last_number(F.col("text")).alias("number"))


@_query("f3_safe_float")
def _(spark, folder):
    return _cell_function(spark, folder, numeric.safe_float(F.col("raw"), F.lit(-1.0)), "number")


@_query("f4_to_float")
def _(spark, folder):
    number = numeric.to_float(F.col("raw"))
    return _cell_function(
        spark, folder, number, "number", F.when(number.isNull(), "INVALID").otherwise("OK").alias("status")
    )


@_query("f5_clean_numeric_string")
def _(spark, folder):
    return _cell_function(spark, folder, numeric.clean_numeric_string(F.col("raw")), "cleaned")


@_query("f6_display_number")
def _(spark, folder):
    return _cell_function(spark, folder, numeric.display_number(F.col("raw")), "shown")


def _cell_function(spark, folder, column: Column, name: str, *more: Column) -> DataFrame:
    return demo.cells(spark, folder).select("rec_ord", "row_ord", "col_ord", "raw", column.alias(name), *more)


@_query("f7_numeric_match")
def _(spark, folder):
    turns = demo.turns(spark, folder)
    return turns.select(
        "record_id",
        "turn",
        numeric.numeric_match(F.col("program"), F.col("answer")).alias("program_is_answer"),
        numeric.numeric_match(F.when(F.col("turn") % 2 == 0, F.col("answer")), F.col("answer")).alias("half_null"),
    )


@_query("f8_match_policies")
def _(spark, folder):
    turns, preds = demo.turns(spark, folder), demo.preds(spark, folder)
    both = turns.join(preds, ["record_id", "turn"])
    return both.select(
        "record_id",
        "turn",
        *[
            numeric.answers_match(F.col("actual"), F.col("answer"), policy).alias(policy)
            for policy in ("primary", "basic", "normalized")
        ],
    )


@_query("f9_change")
def _(spark, folder):
    items = demo.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
        (F.col("l_extendedprice") - 40000).cast("decimal(18,2)").cast("double").alias("old"),
        (F.col("l_quantity") * 1000 - 30000).alias("new"),
    )
    result = numeric.change
    kinds = ["auto", "standard", "cost", "percentage", "other"]
    return items.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "old", "new",
        *[result(F.col("old"), F.col("new"), F.lit(k))["value"].alias(f"change_{k}") for k in kinds],
    )


@_query("f10_arithmetic")
def _(spark, folder):
    items = demo.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity",
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("percent"),
    )
    a, b = F.col("l_quantity"), F.col("percent")
    quotient = programs.call(F.lit("divide"), a, b)
    return items.select(
        "*",
        *[programs.call(F.lit(n), a, b)["value"].alias(n) for n in ("subtract", "add", "multiply", "greater")],
        quotient["value"].alias("divide"),
        F.round(programs.call(F.lit("exp"), b, F.lit(None).cast("double"))["value"], 6).alias("exponential"),
        quotient["status"].alias("divide_status"),
        programs.constant(F.concat(F.lit("const_"), F.col("percent").cast("int").cast("string"))).alias("constant"),
    )


@_query("f11_programs")
def _(spark, folder):
    return evaluation.check_programs(demo.turns(spark, folder))


@_query("f12_keyword_arithmetic")
def _(spark, folder):
    return programs.with_arithmetic(demo.expressions(spark, folder), "expression", "_r").select(
        "request_id", "expression", F.col("_r.value").alias("value"), F.col("_r.status").alias("status")
    )


@_query("f12_compute_requests")
def _(spark, folder):
    cells = demo.cells(spark, folder)
    return requests.compute_requests(demo.compute_jobs(spark, folder), cells, tables.infer_column_types(cells))


@_query("f13_intents")
def _(spark, folder):
    asked = demo.text_requests(spark, folder)
    op = text.operation(F.col("query"))
    intent = text.expression_intent(F.col("query"))
    return asked.select(
        "request_id", "query", op.alias("intent"), text.query_type(op).alias("query_type"),
        intent["expression_type"].alias("expression_type"), intent["operation"].alias("expression_operation"),
    )


@_query("f14_financial_terms")
def _(spark, folder):
    labels = tables.axis_labels(demo.cells(spark, folder))
    label = F.col("label")
    return labels.select(
        "rec_ord", "axis", "ord", "label",
        _joined(text.financial_terms(label)).alias("terms"),
        text.has_financial_content(label).alias("financial"),
        text.is_financial_metric(label).alias("metric"),
        text.has_time_mark(label).alias("time_mark"),
        text.is_time_label(label).alias("time_label"),
        _joined(text.entities(label)).alias("entities"),
    )


@_query("f14_document_terms")
def _(spark, folder):
    return demo.table(spark, folder, "documents").select(
        "doc_id",
        _joined(text.financial_terms(F.col("text"))).alias("terms"),
        text.has_time_mark(F.col("text")).alias("time_mark"),
        _joined(text.entities(F.col("text"))).alias("entities"),
    )


@_query("f15_selection_checks")
def _(spark, folder):
    mark = F.col("turn") + F.col("rec_ord")
    asked = demo.turns(spark, folder).select(
        "record_id",
        "turn",
        F.when(mark % 3 == 0, "change of the Senior Notes debt issuance costs?")
        .when(mark % 3 == 1, F.concat(F.lit("and that? "), F.col("question")))
        .otherwise(F.col("question"))
        .alias("question"),
        F.when(mark % 2 == 0, "the general row").otherwise("the Senior row").alias("selected"),
    )
    return asked.withColumn("_c", text.check_selection(F.col("question"), F.col("selected"))).select(
        "record_id",
        "turn",
        F.col("_c.validation_status").alias("validation_status"),
        _joined("_c.warnings").alias("warnings"),
        _joined("_c.suggestions").alias("suggestions"),
        F.col("_c.recommendation").alias("recommendation"),
    )


@_query("f16_expected_format")
def _(spark, folder):
    asked = demo.cells(spark, folder)
    question = F.when(F.col("row_ord") % 2 == 0, F.col("row_name")).otherwise("the percentage rate")
    return asked.select(
        "rec_ord", "row_ord", "col_ord", numeric.expected_format(F.col("raw"), question).alias("expected_format")
    )


@_query("f17_query_tables")
def _(spark, folder):
    return requests.query_tables(demo.text_requests(spark, folder), demo.cells(spark, folder))


# --- streaming -----------------------------------------------------------------------------------


@_query("st1_stream_scores")
def _(spark, folder):
    preds = demo.preds(spark, folder).select("record_id", "turn", "actual", "error")
    base = shared_folder(spark, "scores")
    preds.write.parquet(f"{base}/preds")
    turns = demo.turns(spark, folder)
    stream = incremental.stream_scores(
        spark, f"{base}/preds", turns, f"{base}/ledger", f"{base}/checkpoint"
    )
    stream.awaitTermination()
    return evaluation.accuracy_breakdown(incremental.read_scores(spark, f"{base}/ledger"))


@_query("st2_stream_sessions")
def _(spark, folder):
    base = shared_folder(spark, "sessions")
    demo.event_log(spark, folder).write.parquet(f"{base}/log")
    log = incremental.open_turn_log(spark, f"{base}/log")
    kind = incremental.SESSIONS
    incremental.stream_totals(log, kind, f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    return incremental.read_totals(spark, kind, f"{base}/totals").select(
        "session_id", "turn_count", _stamp("created_at"), _stamp("updated_at")
    )


@_query("st2_stream_entities")
def _(spark, folder):
    base = shared_folder(spark, "entities")
    demo.event_log(spark, folder).write.parquet(f"{base}/log")
    log = incremental.open_turn_log(spark, f"{base}/log")
    kind = incremental.ENTITIES
    incremental.stream_totals(log, kind, f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    return incremental.read_totals(spark, kind, f"{base}/totals")
