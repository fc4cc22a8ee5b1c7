"""Turn programs such as ``subtract(9, 4), divide(#0, 4)`` and the arithmetic they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import arithmetic
from ledgerloom.functions.numeric import SIMPLE_NUMBER, _any_of, parse_float, to_float

# The named constants programs may use.
CONSTANTS = {
    "const_100": 100,
    "const_1000": 1000,
    "const_10000": 10000,
    "const_100000": 100000,
    "const_1000000": 1000000,
    "const_m1": -1,
    "const_0": 0,
    "const_1": 1,
    "const_2": 2,
    "const_3": 3,
    "const_4": 4,
    "const_5": 5,
    "const_10": 10,
    "const_12": 12,
    "const_31": 31,
    "const_365": 365,
}

# Column arithmetic by function name; comparisons count as 1 and 0.
FUNCTIONS = {
    "subtract": lambda a, b: a - b,
    "add": lambda a, b: a + b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "greater": lambda a, b: (a > b).cast("double"),
    "exp": lambda a, b: F.exp(a),
}

# One call, and a whole program: calls separated by commas.
_CALL = r"([A-Za-z_]+)\(([^(),]*)(?:,([^(),]*))?\)"

_PROGRAM = r"^\s*[A-Za-z_]+\([^(),]*(?:,[^(),]*)?\)(?:\s*,\s*[A-Za-z_]+\([^(),]*(?:,[^(),]*)?\))*\s*\z"

# Operation keywords of free-text arithmetic, tried in this order.
TEXT_OPERATIONS = [
    ("add", ["+", "add", "plus", "sum"]),
    ("subtract", ["-", "subtract", "minus", "difference"]),
    ("multiply", ["*", "multiply", "times", "×"]),
    ("divide", ["/", "divide", "divided by", "÷"]),
]


def constant(name: Column) -> Column:
    """Value of a named constant, null when there is no such name."""
    table = F.create_map(*[F.lit(x) for k, v in CONSTANTS.items() for x in (k, float(v))])
    return F.try_element_at(table, name)


def _apply(name: Column, a: Column, b: Column) -> Column:
    """Value of a call; null for an unknown function, a missing argument or a zero divisor."""
    value = F.lit(None).cast("double")
    for function, build in FUNCTIONS.items():
        value = F.when(name == function, build(a, b)).otherwise(value)
    return value


def call(name: Column, a: Column, b: Column) -> Column:
    """struct(value, status) of one arithmetic call; division by zero is a status, not a null."""
    status = (
        F.when(~name.isin(*FUNCTIONS), "UNKNOWN_FUNCTION")
        .when(a.isNull() | (b.isNull() & (name != "exp")), "BAD_ARGUMENT")
        .when((name == "divide") & (b == 0), "DIV_ZERO")
        .otherwise("OK")
    )
    return F.struct(_apply(name, a, b).alias("value"), status.alias("status"))


def _token_number(token: Column) -> Column:
    """Number or constant an argument stands for; null for a back reference or anything else."""
    plain = parse_float(F.translate(token, "$% ", ""))
    return F.when(token.startswith("const_"), constant(token)).otherwise(plain)


def _token_reference(token: Column) -> Column:
    """k of a ``#k`` argument, else null."""
    return F.when(token.startswith("#"), token.substr(2, 9).try_cast("int"))


def evaluate_program(program: Column) -> Column:
    """struct(value, status) of a whole program; the first failing step decides the status.

    Arguments are parsed before the fold over the steps, so each is parsed once and the fold only looks up
    earlier results and computes.
    """
    names, left, right = (F.regexp_extract_all(program, F.lit(_CALL), F.lit(g)) for g in (1, 2, 3))
    tokens = F.arrays_zip(names, left, right)
    steps = F.transform(
        tokens,
        lambda t: F.struct(
            F.lower(t["0"]).alias("name"),
            F.trim(t["1"]).alias("a"),
            _token_number(F.trim(t["1"])).alias("a_number"),
            _token_reference(F.trim(t["1"])).alias("a_step"),
            F.trim(t["2"]).alias("b"),
            _token_number(F.trim(t["2"])).alias("b_number"),
            _token_reference(F.trim(t["2"])).alias("b_step"),
        ),
    )

    def run(results: Column, step: Column) -> Column:
        a = F.coalesce(step["a_number"], F.get(results, step["a_step"]))
        b = F.coalesce(step["b_number"], F.get(results, step["b_step"]))
        return F.concat(results, F.array(_apply(step["name"], a, b)))

    def reason(step: Column, position: Column) -> Column:
        """Why a step without a value failed."""

        def argument(side: str) -> Column:
            number, earlier = step[f"{side}_number"], step[f"{side}_step"]
            return (
                F.when(number.isNotNull() | ((earlier >= 0) & (earlier < position)), None)
                .when(step[side].startswith("#"), "BAD_REFERENCE")
                .when(step[side].startswith("const_"), "UNKNOWN_CONSTANT")
                .otherwise("BAD_ARGUMENT")
            )

        return F.when(~step["name"].isin(*FUNCTIONS), "UNKNOWN_FUNCTION").otherwise(
            F.coalesce(
                argument("a"),
                F.when(step["name"] != "exp", argument("b")),
                F.lit("DIV_ZERO"),
            )
        )

    start = F.array().cast("array<double>")

    def outcome(results: Column) -> Column:
        failed = F.array_min(
            F.transform(results, lambda r, i: F.when(r.isNull(), i))
        )
        return F.struct(
            F.when(failed.isNull(), F.try_element_at(results, F.lit(-1))).alias("value"),
            failed.alias("failed"),
        )

    folded = F.aggregate(steps, start, run, outcome)
    failures = F.transform(steps, reason)
    number = to_float(program)
    is_calls = program.rlike(_PROGRAM)
    # One array element stands for a local variable: the fold is evaluated once for value and status.
    return F.when(
        is_calls,
        F.get(
            F.transform(
                F.array(folded),
                lambda r: F.struct(
                    r["value"].alias("value"),
                    F.when(r["failed"].isNull(), "OK").otherwise(F.get(failures, r["failed"])).alias("status"),
                ),
            ),
            F.lit(0),
        ),
    ).otherwise(
        F.struct(
            number.alias("value"),
            F.when(number.isNotNull(), "OK").otherwise("UNPARSEABLE").alias("status"),
        )
    )


def with_arithmetic(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: struct(value, status) for arithmetic stated in symbols or words.

    A pure expression is computed as written. Where the text is none, or has no finite value, its first two numbers
    are combined by the first keyword group present.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(SIMPLE_NUMBER), F.lit(1))
    # Each step is a column of its own, so that no pattern is matched twice.
    parsed = (
        df.withColumn("_numbers", found)
        .withColumn("_tokens", arithmetic.tokens(F.col(text)))
        .withColumn("_signed", arithmetic.signed(F.col("_tokens")))
        .withColumn("_written", arithmetic.value(F.col("_signed")))
    )
    first = F.get("_numbers", F.lit(0)).try_cast("double")
    second = F.get("_numbers", F.lit(1)).try_cast("double")
    named = first
    for function, words in reversed(TEXT_OPERATIONS):
        said = _any_of([F.contains(F.lower(text), F.lit(w)) for w in words])
        named = F.when(said, FUNCTIONS[function](first, second)).otherwise(named)

    count = F.size("_numbers")
    value = F.coalesce("_written", F.when(count == 1, first).otherwise(named))
    status = (
        F.when(count == 0, "UNABLE_TO_COMPUTE").when(F.col("_value").isNull(), "DIV_ZERO").otherwise("OK")
    )
    return (
        parsed.withColumn("_value", value)
        .withColumn("_status", status)
        .withColumn(
            out,
            F.struct(
                F.when(F.col("_status") == "OK", F.col("_value")).alias("value"), F.col("_status").alias("status")
            ),
        )
        .drop("_numbers", "_tokens", "_signed", "_written", "_value", "_status")
    )
