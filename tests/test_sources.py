"""Corpus reading, the results ledger, the turn log and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dialogue, evaluation
from ledgerloom.sources import corpus, ledger, objects, turnlog
from ledgerloom.streaming import incremental, kept


def record(name, table, questions=("q1", "q2"), answers=("1", "2", "3"), features=None):
    return {
        "id": name,
        "doc": {"pre_text": "before", "post_text": "after", "table": table},
        "dialogue": {
            "conv_questions": list(questions),
            "conv_answers": list(answers),
            "turn_program": ["1"],
            "executed_answers": [1, 2.5],
            "qa_split": [True, False],
        },
        "features": features,
    }


TRAIN = [
    record("t1", {"c1": {"b": 1.50, "a": "x"}, "c2": {"z": 3, "a": 4}}),
    record("t2", {"c1": {}, "c2": {"r": "9"}}, features={"has_type2_question": True}),
]
DEV = [record("d1", {})]


@pytest.fixture
def corpus_file(tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"train": TRAIN, "dev": DEV}))
    return str(path)


def check(loaded):
    parts = corpus.normalize(loaded)
    keys = [(r.split, r.rec_ord, r.record_id) for r in parts.records.orderBy("rec_ord").collect()]
    assert keys == [("train", 0, "t1"), ("train", 1, "t2"), ("dev", 2, "d1")]
    cells = {(r.record_id, r.col_name, r.row_name): (r.col_ord, r.row_ord, r.raw) for r in parts.cells.collect()}
    assert cells == {
        ("t1", "c1", "b"): (0, 0, "1.5"), ("t1", "c1", "a"): (0, 1, "x"), ("t1", "c2", "z"): (1, 2, "3"),
        ("t1", "c2", "a"): (1, 1, "4"), ("t2", "c1", "r"): (0, 0, None), ("t2", "c2", "r"): (1, 0, "9"),
    }
    turns = [r for r in parts.turns.filter("record_id = 't2'").orderBy("turn").collect()]
    assert [(r.turn, r.question, r.answer, r.program, r.executed_answer, r.is_hybrid) for r in turns] == [
        (1, "q1", "1", "1", "1", True), (2, "q2", "2", None, "2.5", True),
    ]
    assert dialogue.dialogue_view(parts.turns).count() == 3


def test_object_corpus(spark, corpus_file):
    check(corpus.read_corpus(spark, corpus_file))


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("order", [("train", "dev"), ("dev", "train")])
def test_object_corpus_is_read_in_ranges(spark, tmp_path, indent, order):
    """Braces, brackets, quotes and escapes in texts; arrays of objects inside records; ranges that cut anywhere."""
    odd = ['{"train": [', "}]}", 'a "quoted\\" {', "\\\\", "é\n}{", "]", ""]
    made = {"train": [], "dev": []}
    for split, count in (("train", 60), ("dev", 25)):
        for i in range(count):
            r = record(f"{split}{i}", {f"c{odd[i % 7]}": {odd[(i + 1) % 7]: odd[(i + 2) % 7]}}, questions=odd[: i % 8], answers=odd)
            made[split].append({"extra": [{"x": "}"}, [i]], **r})
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({k: made[k] for k in order}, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (indent or 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        loaded = corpus.read_corpus(spark, str(path))
        assert objects._pieces(spark, str(path)).select(F.spark_partition_id().alias("p")).distinct().count() > 5
        rows = loaded.orderBy("rec_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [("train", r) for r in made["train"]] + [("dev", r) for r in made["dev"]]
    assert [(r.split, r.rec_ord, r.id) for r in rows] == [(s, k, r["id"]) for k, (s, r) in enumerate(expected)]
    for row, (_, given) in zip(rows, expected, strict=True):
        assert row.doc.table == given["doc"]["table"] and row.dialogue.conv_questions == given["dialogue"]["conv_questions"]
        assert row.dialogue.conv_answers == odd and row.dialogue.executed_answers == ["1", "2.5"]


@pytest.mark.parametrize("train, dev", [([], []), ([], DEV), (TRAIN, [])])
def test_empty_arrays(spark, tmp_path, train, dev):
    path = tmp_path / "corpus.json"
    for made in ({"train": train, "dev": dev}, {"dev": dev, "train": train}):
        path.write_text(json.dumps(made))
        rows = corpus.read_corpus(spark, str(path)).orderBy("rec_ord").collect()
        assert [(r.split, r.id) for r in rows] == [("train", r["id"]) for r in train] + [("dev", r["id"]) for r in dev]


def test_line_and_parquet_corpora(spark, tmp_path):
    lines = tmp_path / "lines.json"
    numbered = [{"split": "train", "rec_ord": i, **r} for i, r in enumerate(TRAIN)]
    numbered += [{"split": "dev", "rec_ord": 2, **DEV[0]}]
    lines.write_text("\n".join(json.dumps(r) for r in numbered))
    loaded = corpus.read_corpus(spark, str(lines), "lines")
    check(loaded)
    loaded.write.parquet(str(tmp_path / "parquet"))
    check(corpus.read_corpus(spark, str(tmp_path / "parquet"), "parquet"))
    check(corpus.parse_records(spark.read.text(str(lines))))


@pytest.mark.parametrize("content", ["", "[1]", '{"train": []}', "{broken", '{"train": {}, "dev": 3}',
                                     '{"train": [{"id": "x"}], "dev": []}'])
def test_bad_corpora(spark, tmp_path, content):
    path = tmp_path / "bad.json"
    path.write_text(content)
    with pytest.raises(corpus.CorpusError):
        corpus.read_corpus(spark, str(path))


def test_malformed_records(spark):
    good = {"split": "train", "rec_ord": 1, **TRAIN[0]}
    lines = [json.dumps(good), json.dumps({**good, "rec_ord": 2, "doc": None}), '{"rec_ord": 3, "id"']
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    found = {r.rec_ord: r.detail for r in corpus.malformed_records(frame).collect()}
    assert len(found) == 2 and found[2] is None and lines[2] in found.values()


def test_missing_corpus(spark, tmp_path):
    with pytest.raises(corpus.CorpusError):
        corpus.read_corpus(spark, str(tmp_path / "none.json"))


@pytest.fixture
def gold(spark):
    rows = [(i, f"r{i}", t, f"q{t}", str(i * t), i % 2 == 0) for i in range(4) for t in (1, 2)]
    turns = spark.createDataFrame(rows, "rec_ord long, record_id string, turn int, question string, answer string, is_hybrid boolean")
    said = [(r[1], r[2], r[4] if r[2] == 1 else "wrong 77", None) for r in rows]
    return turns, spark.createDataFrame(said, "record_id string, turn int, actual string, error string")


def test_scores(spark, gold):
    turns, preds = gold
    results = evaluation.score(preds.filter("record_id <> 'r3'"), turns)
    summary = {(r.level, r.name): (r.correct, r.total, r.accuracy) for r in evaluation.accuracy_breakdown(results).collect()}
    assert summary[("overall", "all")] == (3, 8, 37.5)
    assert summary[("turn", "1")] == (3, 4, 75.0)
    assert summary[("type", "hybrid")] == (2, 4, 50.0)
    assert evaluation.score(preds.filter("record_id <> 'r3'"), turns, drop_failed=True).count() == 6
    failed = preds.withColumn("error", F.when(F.col("turn") == 1, F.col("actual")))
    rows = evaluation.score(failed, turns).collect()
    assert not any(r.is_correct for r in rows) and sum(r.actual.startswith("ERROR: ") for r in rows) == 4
    empty = evaluation.accuracy_breakdown(evaluation.score(preds, turns).limit(0)).collect()
    assert {(r.name, r.accuracy) for r in empty if r.level == "type"} == {("simple", 0.0), ("hybrid", 0.0)}
    report = evaluation.baseline_report(results).collect()
    assert len(report) == 6 and report[-1].accuracy == 37.5


def test_incremental_equals_full(spark, gold, tmp_path):
    turns, preds = gold
    path = str(tmp_path / "ledger")
    ledger.evaluate_incremental(preds.filter("record_id IN ('r0', 'r2')"), turns, path)
    assert ledger.read_ledger(spark, path).count() == 4
    both = ledger.evaluate_incremental(preds, turns, path)
    again = ledger.evaluate_incremental(preds, turns, path)
    full = evaluation.score(preds, turns)
    assert both.exceptAll(full).count() == 0 and again.count() == full.count() == 8


def test_limits(spark, gold):
    turns, _ = gold
    kept = ledger.limit_turns(turns, max_records=2, max_questions=1).collect()
    assert sorted((r.record_id, r.turn) for r in kept) == [("r0", 1), ("r1", 1)]


@pytest.fixture
def log(spark):
    rows = [(s, f"rec-{s}", i, f"2024-01-0{1 + (s == 's2')} 00:00:0{i}", ["revenue"] if i == 1 else []) for s in ("s1", "s2") for i in (1, 2)]
    frame = spark.createDataFrame(rows, "session_id string, record_id string, seq long, t string, referenced_entities array<string>")
    return frame.select(
        "session_id", "record_id", "seq", F.lit("Original question").alias("user_message"),
        F.lit("Original response").alias("assistant_response"), F.to_timestamp("t").alias("ts"),
        F.array().cast("array<map<string,string>>").alias("tool_calls"), "referenced_entities",
        F.array().cast("array<map<string,string>>").alias("computation_results"),
    )


def test_turn_log(spark, log, tmp_path):
    path = str(tmp_path / "log")
    turnlog.append_turns(log, path)
    stored = turnlog.read_turns(spark, path)
    assert [r.session_id for r in turnlog.list_sessions(stored).collect()] == ["s2", "s1"]
    assert [r.turn_count for r in turnlog.list_sessions(stored, "rec-s1").collect()] == [2]
    assert [r.user_message for r in turnlog.load_session(stored, "s1").collect()] == ["Original question"] * 2
    doomed = spark.createDataFrame([("s1",), ("none",)], "session_id string")
    report = {r.session_id: r.deleted for r in turnlog.delete_sessions(stored, doomed, str(tmp_path / "new")).collect()}
    assert report == {"s1": True, "none": False}
    assert [r.session_id for r in turnlog.list_sessions(turnlog.read_turns(spark, str(tmp_path / "new"))).collect()] == ["s2"]


def test_streamed_scores(spark, gold, tmp_path):
    turns, preds = gold
    arrived, kept_, state = (str(tmp_path / n) for n in ("preds", "ledger", "state"))

    def run():
        incremental.stream_scores(spark, arrived, turns, kept_, state, files_at_once=1).awaitTermination()
        return incremental.read_scores(spark, kept_)

    plain = preds.select("record_id", "turn", "actual")
    plain.filter("record_id = 'r0'").coalesce(1).write.mode("append").parquet(arrived)
    assert run().count() == 2
    assert run().count() == 2
    later = plain.filter("record_id = 'r0'").withColumn("actual", F.lit("changed my mind"))
    later.unionByName(plain.filter("record_id <> 'r0'")).coalesce(1).write.mode("append").parquet(arrived)
    final = run()
    batch = evaluation.score(preds, turns).select(final.columns)
    assert final.count() == 8 and final.exceptAll(batch).count() == 0 and batch.exceptAll(final).count() == 0


def test_first_prediction_of_a_turn_stays(spark):
    rows = [("r", 1, "b", 2), ("r", 1, "a", 1), ("r", 2, "d", 1), ("r", 2, "c", 1), ("s", None, None, 1)]
    preds = spark.createDataFrame(rows, "record_id string, turn int, actual string, _at int")
    got = {(r.record_id, r.turn): r.actual for r in incremental.first_predictions(preds, "_at").collect()}
    assert got == {("r", 1): "a", ("r", 2): "c", ("s", None): None}


def test_streamed_totals(spark, log, tmp_path):
    arrived, table, state = (str(tmp_path / n) for n in ("log", "totals", "state"))

    def run():
        stream = incremental.open_turn_log(spark, arrived)
        incremental.stream_totals(stream, incremental.SESSIONS, table, state).awaitTermination()
        return {r.session_id: r.turn_count for r in incremental.read_totals(spark, incremental.SESSIONS, table).collect()}

    log.filter("seq = 1").write.mode("append").parquet(arrived)
    assert run() == {"s1": 1, "s2": 1}
    log.filter("seq = 2 AND session_id = 's2'").write.mode("append").parquet(arrived)
    assert run() == {"s1": 1, "s2": 2}


def test_many_batches_keep_few_folders(spark, log, tmp_path, monkeypatch):
    """Ten batches: one current row per key, a bounded number of folders, late rows counted, repeats without effect."""
    monkeypatch.setattr(kept, "EVERY", 3)
    table = tmp_path / "totals"
    for batch in range(10):
        day = F.col("ts") + F.make_interval(days=F.lit(5 - batch))
        kept.add(incremental.SESSIONS, log.withColumn("ts", day), batch, str(table))
        if batch in (2, 7):
            kept.add(incremental.SESSIONS, log.withColumn("ts", day), batch, str(table))
        folders = [p.name for p in table.iterdir()]
        assert sum(f.startswith("delta=") for f in folders) < 3 and sum(f.startswith("base=") for f in folders) <= 2
    got = incremental.read_totals(spark, incremental.SESSIONS, str(table)).collect()
    assert {r.session_id: r.turn_count for r in got} == {"s1": 20, "s2": 20} and len(got) == 2
    days = {r.session_id: (r.updated_at - r.created_at).days for r in got}
    assert days == {"s1": 9, "s2": 9}
    # A merge that was not finished does not count.
    (table / "base=99").mkdir()
    assert {r.turn_count for r in incremental.read_totals(spark, incremental.SESSIONS, str(table)).collect()} == {20}
    empty = kept.read(spark, incremental.ENTITIES, str(tmp_path / "none"), "session_id string, entity string, mentions long")
    assert empty.count() == 0
