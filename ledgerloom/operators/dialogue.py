"""Dialogues: turn numbers, recent context, session state and entity references.

``log`` has one row per question-answer turn: session_id, record_id, seq (integer, rising within a session),
user_message, assistant_response, ts, tool_calls, referenced_entities, computation_results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import entities, shorten
from ledgerloom.operators.ordered import SLICE_ROWS, carry_forward, number_rows, with_previous

SESSION = ["session_id"]
# Fixed value: the context of a first turn.
EMPTY_CONTEXT = "This is the start of a new conversation."


def number_turns(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``turn_no`` 1, 2, ... per session and ``turn_id`` turn_1, turn_2, ..."""
    numbered = number_rows(log, SESSION, "seq", "turn_no", slice_rows)
    return numbered.withColumn("turn_id", F.concat(F.lit("turn_"), F.col("turn_no").cast("string")))


def pair_messages(messages: DataFrame) -> DataFrame:
    """Question-answer turns from single messages (conv_id, turn, role, text).

    A user message and the assistant message right after it form a turn; a user message without one is a turn that
    waits, with a null response. The pairing is an equi-join on (conv_id, turn), so one long conversation spreads
    over all tasks.
    """
    users = messages.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("seq"), (F.col("turn") + 1).alias("_next"),
        F.col("text").alias("user_message"),
    )
    replies = messages.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("_next"), F.col("text").alias("assistant_response")
    )
    return users.join(replies, ["conv_id", "_next"], "left").drop("_next")


def with_entities(log: DataFrame) -> DataFrame:
    """Set ``referenced_entities`` from the response text."""
    return log.withColumn("referenced_entities", entities(F.col("assistant_response")))


def _with_next(numbered: DataFrame) -> DataFrame:
    """Add a row per session for the question to come: the next turn number, ``turn_id`` next, all else null."""
    coming = numbered.groupBy(*SESSION).agg((F.max("turn_no") + 1).alias("turn_no"), F.lit("next").alias("turn_id"))
    return numbered.unionByName(coming, allowMissingColumns=True)


def _filled(array: str) -> Column:
    return F.when(F.size(array) > 0, F.col(array))


def recent_context(log: DataFrame, depth: int = 5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per turn, the context text before it: the last ``depth`` turns, then what was last called and computed.

    The row ``next`` of a session holds the context for its coming question, newest turn included. A turn without a
    response is shown as its question alone.
    """
    numbered = _with_next(
        number_turns(log, slice_rows).select(
            "session_id", "turn_no", "turn_id", "user_message", "assistant_response", "tool_calls",
            "computation_results",
        )
    )
    # The words of contexts, here and below.
    reply = F.concat(F.lit("\nAssistant: "), F.col("assistant_response"))
    line = F.concat(F.lit("User: "), F.col("user_message"), F.coalesce(reply, F.lit("")))
    seen = with_previous(numbered, SESSION, "turn_no", depth, line, "_lines", slice_rows, keep_slice=True)
    names = F.transform(
        _filled("tool_calls"), lambda c: F.coalesce(F.try_element_at(c, F.lit("tool_name")), F.lit("unknown"))
    )
    state = carry_forward(
        seen.withColumn("_names", names),
        SESSION,
        "turn_no",
        {
            "_tools": F.when(F.col("_names").isNotNull(), F.array_join("_names", "', '")),
            "_computed": F.when(F.size("computation_results") > 0, F.lit(True)),
        },
        slice_rows,
    )
    # A context line keeps the place it first took, so sessions that computed before calling are singled out.
    swapped = (
        numbered.groupBy(*SESSION)
        .agg(
            F.min(F.when(F.size("tool_calls") > 0, F.col("turn_no"))).alias("_tool"),
            F.min(F.when(F.size("computation_results") > 0, F.col("turn_no"))).alias("_comp"),
        )
        .filter("_comp < _tool")
        .select(*SESSION, F.lit(True).alias("_computed_first"))
    )
    called = F.concat(F.lit("- Last tool calls: ['"), F.col("_tools"), F.lit("']"))
    computed = F.when(F.col("_computed"), F.lit("- Recent computations available for reference"))
    tail = F.when(F.col("_computed_first"), F.array(computed, called)).otherwise(F.array(called, computed))
    any_state = F.col("_tools").isNotNull() | F.col("_computed").isNotNull()
    parts = F.concat(
        F.array(F.lit("Recent conversation history:")),
        F.col("_lines"),
        F.when(any_state, F.array(F.lit("\nCurrent context:"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(tail),
    )
    return state.join(swapped, SESSION, "left").select(
        "session_id",
        "turn_id",
        F.when(F.size("_lines") == 0, EMPTY_CONTEXT).otherwise(F.array_join(parts, "\n")).alias("context"),
    )


def qa_context(log: DataFrame, depth: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per turn, ``Q1: ... | A1: ... | Q2: ...`` over the last ``depth`` turns; empty at the start.

    The row ``next`` of a session is for its coming question. A turn without a response has no ``A`` part.
    """
    numbered = _with_next(
        number_turns(log, slice_rows).select("session_id", "turn_no", "turn_id", "user_message", "assistant_response")
    )
    pair = F.struct("user_message", "assistant_response")
    seen = with_previous(numbered, SESSION, "turn_no", depth, pair, "_pairs", slice_rows)

    def labelled(p: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        answer = F.concat(F.lit(" | A"), n, F.lit(": "), p["assistant_response"])
        return F.concat(F.lit("Q"), n, F.lit(": "), p["user_message"], F.coalesce(answer, F.lit("")))

    return seen.select(
        "session_id", "turn_id", F.array_join(F.transform("_pairs", labelled), " | ").alias("context")
    )


def latest_state(log: DataFrame) -> DataFrame:
    """Per session: last non-empty tool calls and computation results, first and last time, turn count."""
    calls, computed = _filled("tool_calls"), _filled("computation_results")
    return log.groupBy(*SESSION).agg(
        F.max_by("tool_calls", F.when(calls.isNotNull(), F.col("seq"))).alias("last_tool_calls"),
        F.max_by("computation_results", F.when(computed.isNotNull(), F.col("seq"))).alias(
            "last_computation_results"
        ),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("turn_count"),
    )


def entity_index(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Which turns mention which entity, in order: session_id, entity, mention_no, turn_no, turn_id.

    Kept in long form, so an entity named in every turn of a huge session needs no single array.
    """
    mentioned = (
        number_turns(log, slice_rows)
        .select("session_id", "turn_no", "turn_id", F.explode(F.array_distinct("referenced_entities")).alias("entity"))
    )
    return number_rows(mentioned, ["session_id", "entity"], "turn_no", "mention_no", slice_rows).select(
        "session_id", "entity", "mention_no", "turn_no", "turn_id"
    )


def find_entity(index: DataFrame, entity: str) -> DataFrame:
    """Turns that mention one entity."""
    return index.filter(F.col("entity") == entity)


def entity_counts(log: DataFrame) -> DataFrame:
    """Mentions per session and entity, and over the corpus (session_id null)."""
    per_session = (
        log.select("session_id", F.explode(F.array_distinct("referenced_entities")).alias("entity"))
        .groupBy("session_id", "entity")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    return per_session.groupingSets(
        [["session_id", "entity"], ["entity"]], "session_id", "entity"
    ).agg(F.sum("mentions").alias("mentions"))


def dialogue_view(turns: DataFrame) -> DataFrame:
    """Turns that have a question, answer and program, each shortened for display."""
    return turns.filter("program IS NOT NULL").select(
        "record_id",
        "turn",
        shorten(F.col("question"), 80).alias("question"),
        shorten(F.col("answer"), 30).alias("answer"),
        shorten(F.col("program"), 50).alias("program"),
    )
