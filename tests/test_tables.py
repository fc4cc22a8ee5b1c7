"""Tables: shaping, typing, structure, selection."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import records, requests, structure, tables

CELLS = "rec_ord long, record_id string, col_ord int, col_name string, row_ord int, row_name string, raw string"


def grid(spark, columns, record="r", rec_ord=0):
    """Cells of a {column: {row: value}} table."""
    rows = []
    for values in columns.values():
        for name in values:
            if name not in rows:
                rows.append(name)
    cells = [
        (rec_ord, record, c, column, rows.index(row), row, raw)
        for c, (column, values) in enumerate(columns.items())
        for row, raw in values.items()
    ]
    return spark.createDataFrame(cells, CELLS)


def column(spark, values):
    return grid(spark, {"c": {f"row{i}": v for i, v in enumerate(values)}})


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "2.5", "-3"], "numeric"),
        (["1e5", ""], "numeric"),
        ([" 7 ", "8\t"], "numeric"),
        (["$1,234.50", "(12)", "3"], "numeric"),
        (["1_000", "2"], "text"),
        (["1d", "2"], "text"),
        (["10.83%", "5"], "percentage"),
        (["$5%", "3"], "text"),
        (["2001-12-31", "2002-01-01"], "date"),
        (["2001-12-31", ""], "date"),
        (["2001-12-31", "12/31/2001"], "text"),
        (["12/31/2001", "01/02/2003"], "date"),
        (["01/02/2003", "31/12/2003"], "text"),
        (["31/12/2003", "01/02/2003"], "date"),
        (["2001-13-45"], "text"),
        (["Dec 31, 2001", "Jan 1, 2002"], "date"),
        (["December 31, 2001"], "date"),
        (["may 2001"], "date"),
        (["FY 2001"], "text"),
        (["see 2001"], "text"),
        ([None, None], "text"),
        ([None, "4"], "numeric"),
        (["a", "b"], "text"),
    ],
)
def test_column_types(spark, values, kind):
    assert tables.infer_column_types(column(spark, values)).first().column_type == kind


@pytest.mark.parametrize(
    "values",
    [["12/31/2001", "01/02/2003"], ["31/12/2003", "01/02/2003"], ["01/02/2003", "31/12/2003"], ["Dec 31, 2001"],
     ["2001/12/31"], ["31 Dec 2001"], ["2001-12"], ["12/2001"], ["2001-12-31 10:00:00"], ["12.31.2001"], ["2001 Q1"]],
)
def test_dates_agree_with_pandas(spark, values):
    import warnings

    import pandas as pd

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            pd.to_datetime(pd.Series(values, dtype=object), errors="raise")
            kind = "date"
        except ValueError:
            kind = "text"
    assert tables.infer_column_types(column(spark, values)).first().column_type == kind


def test_densify_and_schema(spark):
    cells = grid(spark, {"c1": {"b": "1", "a": "2"}, "c2": {"z": "3", "a": "x"}})
    dense = {(r.col_name, r.row_name): r.raw for r in tables.densify(cells).collect()}
    assert len(dense) == 6
    assert dense[("c1", "z")] is None and dense[("c2", "a")] == "x"
    schema = {r.col_name: (r.column_type, r.nullable, r.row_count) for r in tables.build_schema(cells).collect()}
    assert schema == {"c1": ("numeric", True, 3), "c2": ("text", True, 3)}


def test_densify_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_PART", 3)
    cells = grid(spark, {f"c{i}": {f"r{j}": f"{i}{j}" for j in range(i, 20)} for i in range(4)})
    dense = tables.densify(cells)
    assert dense.count() == 80 and dense.distinct().count() == 80
    assert dense.filter("raw IS NULL").count() == 0 + 1 + 2 + 3
    cards = tables.show_tables(
        spark.createDataFrame([(0, "r", "p" * 600, "q")], "rec_ord long, record_id string, pre_text string, post_text string"),
        cells, tables.build_schema(cells), structure.classify_structure(cells),
    ).orderBy("part").collect()
    assert [c.part for c in cards] == list(range(7))
    assert sum(len(c.data) for c in cards) == cells.count()
    assert cards[0].pre_text == "p" * 500 + "..."


def test_typed_modes_and_warnings(spark):
    cells = column(spark, ["$1,234.50", "(12)", "3"])
    schema = tables.build_schema(cells)
    keep = [r.num for r in tables.typed_cells(cells, schema).orderBy("row_ord").collect()]
    faithful = tables.typed_cells(cells, schema, faithful=True)
    assert keep == [1234.5, -12.0, 3.0]
    assert [r.num for r in faithful.orderBy("row_ord").collect()] == [None, None, 3.0]
    assert tables.conversion_warnings(cells).first().null_count == 2


@pytest.mark.parametrize(
    "columns, expected",
    [
        ({"2007": {"net income": "1"}, "2008": {"net income": "2"}}, ("time_series", 0.75)),
        ({"amount": {"cash": "1", "debt": "2"}}, ("metrics_by_categories", 0.7)),
        ({"year": {"x": "1"}}, ("mixed", 0.5)),
        ({"a": {"x": "1"}}, ("unknown", 0.2)),
    ],
)
def test_structure(spark, columns, expected):
    row = structure.classify_structure(grid(spark, columns)).first()
    assert (row.structure, pytest.approx(row.confidence)) == expected


def test_guides(spark):
    cells = grid(spark, {str(y): {"cash": "1"} for y in range(2001, 2006)})
    row = structure.structure_guide(cells, tables.build_schema(cells)).first()
    assert row.guide["columns"] == "Columns represent time periods: 2001, 2002, 2003..."
    assert row.guide["rows"] == "Rows represent financial metrics: cash"
    assert row.data_types == {str(y): "numeric" for y in range(2001, 2006)}


def test_wide_table(spark):
    cells = grid(spark, {"c1": {"b": "1", "a": "2"}, "c2": {"z": "3"}})
    rows = tables.wide_table(cells, "r", ["c1", "c2"]).collect()
    assert [(r.row_name, r.c1, r.c2) for r in rows] == [("b", "1", None), ("a", "2", None), ("z", None, "3")]


def test_totals(spark):
    cells = grid(spark, {"c1": {"a": "1.1", "b": "2.2"}, "c2": {"a": "x"}, "c3": {"a": "$5", "b": "(2)"}})
    wanted = spark.createDataFrame(
        [(1, "r", ["c3", "c1", "nope"]), (2, "r", ["c2"]), (3, "r", [])],
        "request_id long, record_id string, target_columns array<string>",
    )
    types = tables.infer_column_types(cells)
    got = {(r.request_id, r.total_name): r.total for r in tables.column_totals(wanted, cells, types).collect()}
    assert got[(1, "c3_total")] == 3.0 and got[(1, "c1_total")] == pytest.approx(3.3)
    assert got[(2, None)] is None and got[(3, None)] is None  # every request has a row
    firsts = {r.request_id: r.col_name for r in tables.first_numeric_sum(wanted, cells, types).collect()}
    assert firsts == {1: "c3", 2: None, 3: "c1"}


def test_totals_read_the_cells_once(spark):
    """Facts that have totals give the same rows as types without, from one pass over the cells."""
    cells = grid(spark, {"c1": {"a": "1.1", "b": "2.2"}, "c2": {"a": "x"}, "c3": {"a": "$5", "b": "(2)"}})
    wanted = spark.createDataFrame(
        [(1, "r", ["c3", None, "c1", "c3", "nope"]), (2, "r", ["c2"]), (3, "r", []), (4, "r", None), (5, "none", ["c1"])],
        "request_id long, record_id string, target_columns array<string>",
    )
    facts = tables.column_totals(wanted, cells, tables.column_facts(cells))
    assert facts._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    rows = sorted(facts.collect(), key=str)
    assert rows == sorted(tables.column_totals(wanted, cells, tables.infer_column_types(cells)).collect(), key=str)
    assert {(r.request_id, r.target_pos, r.total_name) for r in rows if r.status == "OK"} == {(1, 0, "c3_total"), (1, 2, "c1_total")}
    assert {r.request_id: r.numeric_columns for r in rows if r.status != "OK"} == {2: "c1, c3", 3: "c1, c3", 4: "c1, c3", 5: ""}


def test_selection_and_head(spark):
    cells = grid(spark, {"c1": {f"r{i}": str(i) for i in range(6)}, "c2": {"r0": "x"}})
    wanted = spark.createDataFrame(
        [(1, "r", ["c2", "nope"]), (2, "r", ["nope"])], "request_id long, record_id string, target_columns array<string>"
    )
    chosen = tables.select_columns(wanted, cells)
    assert chosen.filter("request_id = 1").count() == 1
    assert chosen.filter("request_id = 2 AND fallback").count() == 7
    assert tables.table_head(cells, 3).count() == 4


def test_query_tables(spark):
    cells = grid(spark, {"c1": {f"r{i}": str(i) for i in range(6)}, "c2": {"r0": "x"}})
    asked = spark.createDataFrame(
        [(1, "r", "show it", None), (2, "r", "the change", None), (3, "r", "add up", "aggregate")],
        "request_id long, record_id string, query string, operation string",
    )
    rows = requests.query_tables(asked, cells, tables.infer_column_types(cells)).collect()
    by_request = {i: [r for r in rows if r.request_id == i] for i in (1, 2, 3)}
    assert len(by_request[1]) == 7 and by_request[1][0].query_type == "selection"
    assert len(by_request[2]) == 6 and by_request[2][0].note == "analysis_required"
    assert [(r.col_name, r.num) for r in by_request[3]] == [("c1_total", 15.0)]


def test_records(spark):
    keys = spark.createDataFrame(
        [("train", 0, "A"), ("train", 1, ""), ("dev", 2, "A"), ("dev", 3, "B1"), ("dev", 4, "C")],
        "split string, rec_ord long, record_id string",
    )
    cells = spark.createDataFrame(
        [(o, i, c, n, 0, "x", "1") for o, i in ((0, "A"), (2, "A"), (3, "B1")) for c, n in ((0, "k"), (1, "k" if o == 3 else "m"))],
        CELLS,
    )
    issues = {(r.rec_ord, r.issue) for r in records.quality_issues(keys, cells).collect()}
    assert issues == {(1, "EMPTY_ID"), (4, "NO_TABLE"), (3, "DUPLICATE_COLUMN")}
    usable = records.usable_records(keys, cells)
    assert sorted(r.rec_ord for r in usable.collect()) == [2, 3]
    asked = spark.createDataFrame([(1, "A"), (2, "b"), (3, "zz"), (4, "1")], "request_id long, record_id string")
    found = {r.request_id: r for r in records.lookup_records(asked, usable).collect()}
    assert found[1].status == "OK" and found[1].rec_ord == 2
    assert found[2].similar_records == ["B1"] and found[2].available_count == 2
    assert found[3].similar_records == [] and found[4].similar_records == ["B1"]
    assert [r.rec_ord for r in records.dedup_records(keys, "first").orderBy("rec_ord").collect()] == [0, 1, 3, 4]
