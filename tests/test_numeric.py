"""Literal cases for the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numeric, programs, text


def evaluate(spark, values, build, schema="v string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in frame.orderBy("i").select(build.alias("r")).collect()]


@pytest.mark.parametrize(
    "build, cases",
    [
        (
            lambda: numeric.to_float(F.col("v")),
            {
                "$1,234.50": 1234.5, "(12)": -12.0, "-4": -4.0, ".45": 0.45, "10.83%": 10.83, "1,234": 1234.0,
                "1e5": 1e5, "1d": None, "1f": None, "1_000": 1000.0, "": None, None: None, "\t7\n": 7.0,
                "$ 5": 5.0, "$(5)": -5.0, "(-5)": None, "n/a": None, "5.": 5.0, " 8　": 8.0, "--5": None,
            },
        ),
        (
            lambda: numeric.last_number(F.col("v")),
            {
                "The average was $60.94.": "60.94", "from 1,200 to 1,300": "1300", "no": None, "": None,
                "fell by -4 in 2009": "2009", "a-5": "-5", "3.": "3.",
            },
        ),
        (
            lambda: numeric.primary_number(F.col("v")),
            {
                "The weighted average exercise price per share in 2007 was $60.94.": "60.94",
                "The ratio for savings plans in 2009 is 0.1083": "0.1083",
                "costs between 2016 and 2017 is 1.0.": "1.0",
                "in 2008": "2008",
                "2008": "2008",
                "x\n -4 \n\n": "-4",
                "Final_Answer: total: 12.5\nthanks": "12.5",
                "final_answer: about 12\n": "12",
                "loss of (1,234.5) now": "-1234.5",
                "between 5 and 1,234": "1234",
                "nothing": None,
                "": None,
                None: None,
                "from 2007 with 3 shares": "2007",
                ".5": ".5",
                "a +7 b": "+7",
            },
        ),
        (
            lambda: numeric.display_number(F.col("v")),
            {" $1,234.5 ": "1234.5", "10%": "10", " about 5 ": "about 5", "(5)": "(5)", "$ 5": " 5"},
        ),
        (
            lambda: numeric.clean_numeric_string(F.col("v")),
            {" $1,234 ": "1234", "(9%)": "-9", "abc": "abc", "(": "("},
        ),
        (lambda: numeric.safe_float(F.col("v"), F.lit(7.0)), {"x": 7.0, None: 7.0, "(3)": -3.0}),
        (
            lambda: numeric.expected_format(F.col("v"), F.lit("what is the ratio?")),
            {
                "10.83%": "percentage as decimal (e.g., 0.1083 for 10.83%)",
                "$5": "currency amount as number",
                "3 million": "currency amount as number",
                "60.94": "decimal number with precision",
                "-4": "negative number",
                "12": "whole number",
                "1.5": "ratio as decimal",
                "": "ratio as decimal",
            },
        ),
    ],
)
def test_text_functions(spark, build, cases):
    assert evaluate(spark, list(cases), build()) == list(cases.values())


def test_numeric_match(spark):
    cases = {("1.0", "1"): True, ("1", "2"): False, (None, None): True, (None, "1"): False, ("a", "a"): True,
             ("a", "1"): False, ("0.1000001", "0.1"): True}
    got = evaluate(spark, list(cases), numeric.numeric_match(F.col("a"), F.col("b")), "a string, b string")
    assert got == list(cases.values())


@pytest.mark.parametrize(
    "policy, actual, expected, hit",
    [
        ("primary", "The price per share in 2007 was $60.94.", "60.94", True),
        ("primary", "The change between 2016 and 2017 is 1.0.", "-4", False),
        ("primary", "no numbers", "none either", True),
        ("primary", "", "", False),
        ("basic", "The price was $60.94.", "60.94", True),
        ("basic", "10.83%", "0.1083", False),
        ("basic", "about 1,300", "1300", True),
        ("basic", "none", "none", False),
        ("normalized", "about 1,300", "1300", False),
        ("normalized", "none", "0", True),
        ("normalized", None, "0", False),
    ],
)
def test_policies(spark, policy, actual, expected, hit):
    build = numeric.answers_match(F.col("a"), F.col("b"), policy)
    assert evaluate(spark, [(actual, expected)], build, "a string, b string") == [hit]


def test_change(spark):
    cases = {
        (10.0, 15.0, "auto"): 5.0, (-26.0, -27.0, "auto"): 1.0, (-26.0, -27.0, "simple"): 1.0,
        (-26.0, -27.0, "standard"): -1.0, (10.0, 15.0, "cost"): -5.0, (10.0, 15.0, "percentage"): 50.0,
        (0.0, 15.0, "percentage"): 0.0, (10.0, 15.0, "unheard of"): 5.0, (None, 15.0, "auto"): None,
    }
    build = numeric.change(F.col("a"), F.col("b"), F.col("k"))
    got = evaluate(spark, list(cases), build, "a double, b double, k string")
    assert [g["value"] for g in got] == list(cases.values())
    assert [g["status"] for g in got] == ["OK"] * 8 + ["VALIDATION_ERROR"]


def test_arithmetic(spark):
    cases = {
        ("subtract", 10.5, 2.5): 8.0, ("subtract", -5.0, -3.0): -2.0, ("add", 0.0, 5.0): 5.0,
        ("multiply", -5.0, -3.0): 15.0, ("divide", 10.5, 2.0): 5.25, ("greater", 10.0, 5.0): 1.0,
        ("greater", 5.0, 5.0): 0.0, ("exp", 0.0, None): 1.0, ("exp", 1.0, None): math.e,
    }
    build = programs.call(F.col("n"), F.col("a"), F.col("b"))
    got = evaluate(spark, list(cases), build, "n string, a double, b double")
    assert [g["value"] for g in got] == pytest.approx(list(cases.values()))
    failed = evaluate(spark, [("divide", 10.0, 0.0), ("power", 1.0, 2.0), ("add", 1.0, None)], build,
                      "n string, a double, b double")
    assert [g["status"] for g in failed] == ["DIV_ZERO", "UNKNOWN_FUNCTION", "BAD_ARGUMENT"]


def test_constants(spark):
    assert len(programs.CONSTANTS) == 16
    got = evaluate(spark, ["const_m1", "const_365", "const_7"], programs.constant(F.col("v")))
    assert got == [-1.0, 365.0, None]


def test_programs(spark):
    cases = {
        "subtract(9, 4), divide(#0, 4)": (1.25, "OK"),
        "206588": (206588.0, "OK"),
        "$1,234.5": (1234.5, "OK"),
        "add(const_100, 5)": (105.0, "OK"),
        "add(1,2), add(#0,#0), multiply(#1, const_m1)": (-6.0, "OK"),
        "greater(3, 2)": (1.0, "OK"),
        "exp(0)": (1.0, "OK"),
        "add(const_7, 5)": (None, "UNKNOWN_CONSTANT"),
        "divide(5, 0), add(#0, 1)": (None, "DIV_ZERO"),
        "power(1, 2)": (None, "UNKNOWN_FUNCTION"),
        "add(#1, 2)": (None, "BAD_REFERENCE"),
        "multiply(2, )": (None, "BAD_ARGUMENT"),
        "junk": (None, "UNPARSEABLE"),
    }
    got = evaluate(spark, list(cases), programs.evaluate_program(F.col("v")))
    assert [(g["value"], g["status"]) for g in got] == list(cases.values())


def test_text_arithmetic(spark):
    cases = {
        "add(5, 3)": (8.0, "OK"), "add(10, 20)": (30.0, "OK"), "27 / 12": (2.25, "OK"), "5 * -3": (-15.0, "OK"),
        "difference of 10 and 4": (6.0, "OK"), "6 times 7": (42.0, "OK"), "8 ÷ 2": (4.0, "OK"), "7": (7.0, "OK"),
        "10 over 3": (10.0, "OK"), "multiply(2,-3)": (5.0, "OK"), "none": (None, "UNABLE_TO_COMPUTE"),
        "divide(1, 0)": (None, "DIV_ZERO"),
        "2**3": (8.0, "OK"), "-(5+3)": (-8.0, "OK"), "abs(3-10)": (7.0, "OK"), "abs(-5)": (5.0, "OK"), "1+2+3": (6.0, "OK"),
        "(506.5 - 488.8) / 488.8": ((506.5 - 488.8) / 488.8, "OK"), "-2**2": (-4.0, "OK"), "2**-1": (0.5, "OK"),
        "2**3**2": (512.0, "OK"), "10/4/5": (0.5, "OK"), "8-3-2": (3.0, "OK"), "2--3": (5.0, "OK"), "((1))": (1.0, "OK"),
        "-abs(-(2))*3": (-6.0, "OK"), ".5+1.": (1.5, "OK"), "5/0": (None, "DIV_ZERO"), "(1+2": (3.0, "OK"),
        "1 2": (1.0, "OK"), "abs 5": (5.0, "OK"), "(-8)**0.5": (-8.5, "OK"),
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, e string")
    rows = programs.with_arithmetic(frame, "e", "r").orderBy("i").collect()
    assert [(r["r"]["value"], r["r"]["status"]) for r in rows] == list(cases.values())


def test_keyword_rules(spark):
    got = evaluate(spark, ["Cash and DEBT margin", "page"], text.financial_terms(F.col("v")))
    assert got == [["cash", "debt", "margin"], []]
    intents = {"what was the Increase": "analyze_change", "compute the total change": "analyze_change",
               "compute it": "calculate", "a versus b": "compare", "show": "lookup"}
    assert evaluate(spark, list(intents), text.operation(F.col("v"))) == list(intents.values())
    labels = {"Dec 31 2008": True, "Q3": True, "fiscal": True, "12008": False, "note": False, "date": False}
    assert evaluate(spark, list(labels), text.is_time_label(F.col("v"))) == list(labels.values())
    assert evaluate(spark, ["the Table", "x"], text.entities(F.col("v"))) == [["financial_table"], []]
    assert evaluate(spark, ["ab", "abc", "abcd"], text.shorten(F.col("v"), 3)) == ["ab", "abc", "abc..."]


def test_selection_check(spark):
    build = text.check_selection(F.col("q"), F.col("s"))
    cases = [
        ("change in Senior Notes?", "-26 from general debt"),
        ("debt issuance costs?", "aggregate row"),
        ("what percentage is that?", "the row"),
    ]
    got = evaluate(spark, cases, build, "q string, s string")
    assert [g["validation_status"] for g in got] == ["warnings_found", "warnings_found", "looks_good"]
    assert [len(g["suggestions"]) for g in got] == [1, 0, 1]
    assert got[2]["recommendation"] == text.PROCEED


def test_loose_pattern_equals_removing_signs_first():
    import random
    import re

    rng = random.Random(7)
    for _ in range(100_000):
        value = "".join(rng.choice("12$,.-a ") for _ in range(rng.randint(1, 14)))
        plain = re.findall(r"-?\d+\.?\d*", value.replace("$", "").replace(",", ""))
        loose = [m.replace("$", "").replace(",", "") for m in re.findall(numeric._LOOSE_NUMBER, value)]
        assert plain == loose, value


def test_a_comparison_searches_each_side_once(spark):
    frame = spark.createDataFrame([("the answer is 12", "12")], "a string, b string")
    plan = frame.select(numeric.answers_match(F.col("a"), F.col("b"), "primary").alias("hit"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("final_answer") == 2
