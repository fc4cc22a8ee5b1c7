"""Sliced windows against plain Python, with slices far smaller than the groups."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dialogue, evaluation
from ledgerloom.operators.ordered import carry_forward, number_rows, running_totals, with_previous


@pytest.fixture(scope="module")
def sample():
    """One session holds most rows; numbers are not dense."""
    rng = random.Random(5)
    rows = []
    for session, size in (("hot", 300), ("a", 1), ("b", 7), ("c", 16)):
        for seq in sorted(rng.sample(range(2000), size)):
            rows.append((session, seq, rng.choice([None, f"v{seq}"]), rng.randint(0, 9)))
    return rows


def grouped(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample, "s string, seq long, v string, n int").repartition(7)


def test_number_rows(frame, sample):
    got = {(r.s, r.seq): r.k for r in number_rows(frame, ["s"], "seq", "k", slice_rows=16).collect()}
    want = {(s, r[1]): i for s, rows in grouped(sample).items() for i, r in enumerate(rows, 1)}
    assert got == want


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_with_previous(frame, sample, depth):
    numbered = number_rows(frame, ["s"], "seq", "k", slice_rows=16)
    out = with_previous(numbered, ["s"], "k", depth, F.col("seq"), "p", slice_rows=8)
    got = {(r.s, r.seq): r.p for r in out.collect()}
    want = {
        (s, r[1]): [p[1] for p in rows[max(0, i - depth) : i]]
        for s, rows in grouped(sample).items()
        for i, r in enumerate(rows)
    }
    assert got == want


def test_carry_forward(frame, sample):
    numbered = number_rows(frame, ["s"], "seq", "k", slice_rows=16)
    out = carry_forward(numbered, ["s"], "k", {"last": F.col("v")}, slice_rows=8)
    got = {(r.s, r.seq): r.last for r in out.collect()}
    want = {}
    for s, rows in grouped(sample).items():
        last = None
        for r in rows:
            want[(s, r[1])] = last
            last = r[2] or last
    assert got == want


def test_running_totals(frame, sample):
    out = running_totals(frame, "seq", {"total": "n"}, group=["s"], slice_rows=64)
    got = {(r.s, r.seq): r.total for r in out.collect()}
    want = {}
    for s, rows in grouped(sample).items():
        total = 0
        for r in rows:
            total += r[3]
            want[(s, r[1])] = total
    assert got == want


def test_running_accuracy_does_not_depend_on_slices(spark):
    rows = [(i, f"r{i}", t, (i * t) % 3 == 0) for i in range(200) for t in (1, 2)]
    results = spark.createDataFrame(rows, "rec_ord long, record_id string, turn int, is_correct boolean")
    small = evaluation.running_accuracy(results, slice_rows=8).orderBy("rec_ord").collect()
    assert small == evaluation.running_accuracy(results).orderBy("rec_ord").collect()
    assert small[-1].total_so_far == 400


LOG = "session_id string, seq long, user_message string, assistant_response string, ts timestamp, " \
      "tool_calls array<map<string,string>>, referenced_entities array<string>, " \
      "computation_results array<map<string,string>>"


def build_log(spark, count, **extras):
    rows = [
        (
            "s", i, f"Question {i}", f"Answer {i}", None,
            [{"tool_name": "show_table"}] if i in extras.get("tools", ()) else [],
            ["revenue", "revenue"] if i in extras.get("entities", ()) else [],
            [{"r": "1"}] if i in extras.get("computed", ()) else [],
        )
        for i in range(1, count + 1)
    ]
    return spark.createDataFrame(rows, LOG)


def test_recent_context(spark):
    contexts = {
        r.turn_id: r.context
        for r in dialogue.recent_context(build_log(spark, 4, computed=[1], tools=[2]), depth=2, slice_rows=3).collect()
    }
    assert contexts["turn_1"] == "This is the start of a new conversation."
    assert contexts["turn_2"] == (
        "Recent conversation history:\nUser: Question 1\nAssistant: Answer 1\n\nCurrent context:\n"
        "- Recent computations available for reference"
    )
    assert contexts["turn_4"] == (
        "Recent conversation history:\nUser: Question 2\nAssistant: Answer 2\nUser: Question 3\nAssistant: Answer 3"
        "\n\nCurrent context:\n- Recent computations available for reference\n- Last tool calls: ['show_table']"
    )
    assert "Question 1" not in contexts["turn_4"]


def test_context_of_the_coming_question(spark):
    log = build_log(spark, 3)
    coming = dialogue.recent_context(log, depth=2, slice_rows=3).filter("turn_id = 'next'").first().context
    assert "Question 2" in coming and "Answer 3" in coming and "Question 1" not in coming
    waiting = log.withColumn("assistant_response", F.when(F.col("seq") < 3, F.col("assistant_response")))
    last = dialogue.qa_context(waiting).filter("turn_id = 'next'").first().context
    assert last == "Q1: Question 1 | A1: Answer 1 | Q2: Question 2 | A2: Answer 2 | Q3: Question 3"


def test_qa_context_and_entities(spark):
    log = build_log(spark, 5, entities=[1, 4])
    last = dialogue.qa_context(log, slice_rows=4).filter("turn_id = 'turn_5'").first().context
    assert last == "Q1: Question 2 | A1: Answer 2 | Q2: Question 3 | A2: Answer 3 | Q3: Question 4 | A3: Answer 4"
    index = dialogue.find_entity(dialogue.entity_index(log), "revenue").orderBy("mention_no").collect()
    assert [r.turn_id for r in index] == ["turn_1", "turn_4"]
    counts = {(r.session_id, r.entity): r.mentions for r in dialogue.entity_counts(log).collect()}
    assert counts == {("s", "revenue"): 2, (None, "revenue"): 2}


def test_pairing(spark):
    messages = [(1, 0, "system", "hi"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
                (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", "z")]
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.seq, r.user_message, r.assistant_response) for r in dialogue.pair_messages(frame).collect()}
    assert got == {(1, 1, "q1", "a1"), (1, 3, "q2", None), (2, 0, "x", None), (2, 1, "y", "z")}


def test_running_totals_through_three_levels(spark, monkeypatch):
    from itertools import accumulate

    from ledgerloom.operators import ordered

    monkeypatch.setattr(ordered, "FAN", 4)
    draw = random.Random(8)
    orders = sorted(draw.sample(range(-300, 2000), 700))
    values = [draw.choice([-3, 0, 1, 7]) for _ in orders]
    frame = spark.createDataFrame(list(zip(orders, values)), "seq long, n long").repartition(6)
    for levels in (0, 1, 2, 3):
        out = running_totals(frame, "seq", {"total": "n"}, slice_rows=4, levels=levels)
        got = {r.seq: r.total for r in out.collect()}
        assert got == dict(zip(orders, accumulate(values)))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
