"""Every query with SQL equals that SQL in DuckDB; the plans keep their shape."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, folder, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["level", "name", "correct", "total", "accuracy"] and frame.count() > 0


def test_similar_rows_against_difflib(spark, folder):
    from ledgerloom.plans import demo
    from test_matching import direct, similar

    labels = {}
    for r in demo.yearly(spark, folder).orderBy("rec_ord", "row_ord").collect():
        labels.setdefault(r.record_id, []).append(r.row_name)
    asked = {r.request_id: r for r in demo.misspelt_requests(spark, folder).collect()}
    rows = QUERIES["j3_match_rows_similar"](spark, folder).collect()
    assert len(rows) == len(asked)
    for row in rows:
        request = asked[row.request_id]
        options = labels[request.record_id]
        assert row.matched_row == (direct(request.row_identifier, options) or similar(request.row_identifier, options))


def test_scans_are_pruned(spark, folder):
    plan = QUERIES["w1_turn_numbers"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


@pytest.mark.parametrize(
    "name, most",
    [("f17_query_tables", 6), ("j1_match_columns", 6), ("j2_closest_label", 6), ("j3_match_rows_direct", 6), ("j4_get_values", 10),
     ("j8_change_requests", 10), ("t1_densify", 4), ("t2_column_types", 2), ("t3_schema", 2), ("t4_conversion_warnings", 2),
     ("t7_structure_guide", 4), ("p2_table_head", 2), ("w6_dedup_last", 1)],
)
def test_few_scans(spark, folder, name, most):
    """Scans of input files in the plan; a table of cells is derived from two of them."""
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


def test_running_sums_do_not_meet_in_one_partition(spark, folder):
    plan = QUERIES["w5_running_accuracy"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
