"""Numbers inside text: parsing, extraction, comparison and change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
_LINE_SPACE = "[" + SPACE_CHARS.replace("\n", "") + "]*"

# What Python's float() reads, without inf/nan; digit groups may be joined by underscores.
FLOAT_LITERAL = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"
)
# What pandas.to_numeric() reads from a string, without inf.
PLAIN_NUMBER = r"^[ \t\n\r\x0b\f]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0b\f]*\z"

_ANSWER_LINE = (
    rf"(?md)^(?:{_LINE_SPACE}|(?=[^\n]*(?i:final_answer))[^\n]*:{_LINE_SPACE})"
    rf"([-+]?\d*\.?\d+){_LINE_SPACE}$"
)

# The extraction patterns, most specific first.
CANDIDATE_PATTERNS = [
    rf"(?:^|[{SPACE_CHARS}])(\([-+]?\d+(?:,\d{{3}})*(?:\.\d+)?\))",
    r"\$?([-+]?\d{1,3}(?:,\d{3})*\.\d+)%?",
    r"\$?([-+]?\d*\.\d+)",
    r"\$?([-+]?\d{1,3}(?:,\d{3})*)%?",
    r"([-+]?\d+)",
]
SIMPLE_NUMBER = r"(-?\d+\.?\d*)"
# The same with ``$`` and ``,`` allowed anywhere inside.
_LOOSE_NUMBER = r"(-?(?:[$,]*\d)+(?:[$,]*\.(?:[$,]*\d)*)?)"
MATCH_TOLERANCE = 1e-6


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def parse_float(text: Column) -> Column:
    """The double a numeric literal stands for, else null."""
    bare = strip(text)
    return F.when(bare.rlike(FLOAT_LITERAL), F.translate(bare, "_", "").try_cast("double"))


def parse_plain(text: Column) -> Column:
    """The double of an unformatted number, else null; no underscores, currency or commas."""
    return F.when(text.rlike(PLAIN_NUMBER), strip(text).try_cast("double"))


def _negate_parentheses(text: Column) -> Column:
    wrapped = text.startswith("(") & text.endswith(")")
    inner = text.substr(F.lit(2), F.length(text) - 2)
    return F.when(wrapped, F.concat(F.lit("-"), inner)).otherwise(text)


def clean_numeric_string(text: Column) -> Column:
    """Drop ``$ , %`` and turn ``(x)`` into ``-x``."""
    return _negate_parentheses(F.translate(strip(text), "$,%", ""))


def to_float(text: Column) -> Column:
    """A formatted amount as a double; null where it is no number. Percent signs do not scale."""
    return parse_float(clean_numeric_string(text))


def safe_float(text: Column, default: Column) -> Column:
    return F.coalesce(to_float(text), default)


def to_exact(text: Column, number: Column) -> Column:
    """The decimal behind ``number`` where that is lossless, so sums do not depend on row order."""
    exact = F.translate(clean_numeric_string(text), "_", "").try_cast("decimal(38,10)")
    return F.when(exact.cast("double") == number, exact)


def exact_sum(exact: Column, number: Column) -> Column:
    """Aggregate: sum of decimals when every value has one, else of doubles; 0 for no values."""
    total = F.when(F.count(exact) == F.count(number), F.try_sum(exact).cast("double"))
    return F.coalesce(total, F.sum(number), F.lit(0.0))


def display_number(text: Column) -> Column:
    """A bare number where the text is one, else the trimmed text."""
    bare = F.translate(strip(text), "$%,", "")
    return F.when(strip(bare).rlike(FLOAT_LITERAL), bare).otherwise(strip(text))


def _last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def last_number(text: Column) -> Column:
    """The last plain number, commas and dollar signs ignored; null when there is none.

    The signs are skipped inside the pattern and dropped from the one match, not from the whole text.
    """
    found = F.translate(_last_match(text, _LOOSE_NUMBER), "$,", "")
    return F.when(text.rlike("[0-9]"), found)


def primary_number(text: Column) -> Column:
    """The answer a text states: a number alone on its line, else the longest, decimals preferred."""
    found = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CANDIDATE_PATTERNS])
    )
    bare = F.transform(found, lambda m: _negate_parentheses(F.translate(m, ",$%", "")))
    numbers = F.filter(bare, lambda m: m.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"))

    def keep_better(held: Column, m: Column) -> Column:
        decimal = F.contains(m, F.lit("."))
        year_like = ~decimal & F.abs(m.try_cast("double")).between(1900, 2100)
        score = F.length(F.translate(m, ".-", "")) + F.when(decimal, 10).otherwise(0)
        take = ~(year_like & (held["score"] == 0)) & (score > held["score"])
        return F.when(take, F.struct(m.alias("best"), score.alias("score"))).otherwise(held)

    start = F.struct(F.lit(None).cast("string").alias("best"), F.lit(0).alias("score"))
    folded = F.aggregate(numbers, start, keep_better, lambda held: held["best"])
    return F.when(text.rlike("[0-9]"), F.coalesce(_last_match(text, _ANSWER_LINE), folded))


def numeric_match(actual: Column, expected: Column) -> Column:
    """Equal within tolerance; text compares as text, and two nulls are equal."""
    a, b = parse_float(actual), parse_float(expected)
    return (
        F.when(actual.isNull() | expected.isNull(), actual.isNull() & expected.isNull())
        .when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < MATCH_TOLERANCE)
        .otherwise(actual == expected)
    )


def answers_match(actual: Column, expected: Column, policy: str = "basic") -> Column:
    """Whether an answer is right under the ``primary``, ``basic`` or ``normalized`` policy; never null."""
    present = (F.coalesce(actual, F.lit("")) != "") & (F.coalesce(expected, F.lit("")) != "")
    if policy == "primary":
        # A comparison names its sides several times; bound to one struct, each number is searched for once.
        sides = F.struct(primary_number(actual).alias("actual"), primary_number(expected).alias("expected"))
        hit = F.get(F.transform(F.array(sides), lambda s: numeric_match(s["actual"], s["expected"])), F.lit(0))
    elif policy == "basic":
        hit = F.abs(
            last_number(actual).try_cast("double") - last_number(expected).try_cast("double")
        ) < MATCH_TOLERANCE
    elif policy == "normalized":
        left, right = (
            F.coalesce(_last_match(side, SIMPLE_NUMBER), F.lit("0")).try_cast("double")
            for side in (actual, expected)
        )
        hit = F.abs(left - right) < MATCH_TOLERANCE
    else:
        raise ValueError(f"unknown match policy: {policy}")
    return F.coalesce(present & hit, F.lit(False))


def change(old: Column, new: Column, kind: Column) -> Column:
    """struct(value, status) for the change from ``old`` to ``new``; ``kind`` picks the convention."""
    rise = new - old
    percent = F.when(old == 0, F.lit(0.0)).otherwise(F.try_divide(rise, old) * 100)
    both_negative = (old < 0) & (new < 0)
    value = (
        F.when(kind.isin("auto", "simple"), F.when(both_negative, old - new).otherwise(rise))
        .when(kind == "cost", old - new)
        .when(kind == "percentage", percent)
        .otherwise(rise)
    )
    valid = old.isNotNull() & new.isNotNull()
    return F.struct(
        F.when(valid, value).alias("value"),
        F.when(valid, F.lit("OK")).otherwise(F.lit("VALIDATION_ERROR")).alias("status"),
    )


def expected_format(answer: Column, question: Column) -> Column:
    """What kind of number an answer should be, read from the gold answer, then from the question."""
    a, q = F.lower(strip(F.coalesce(answer, F.lit("")))), F.lower(F.coalesce(question, F.lit("")))

    def says(text: Column, *words: str) -> Column:
        return _any_of([F.contains(text, F.lit(w)) for w in words])

    decimals = F.length(F.substring_index(a, ".", -1)) >= 2
    # The words looked for and the formats.
    return (
        F.when(a.endswith("%") | says(a, "percent"), "percentage as decimal (e.g., 0.1083 for 10.83%)")
        .when(a.startswith("$") | says(a, "dollar", "million"), "currency amount as number")
        .when(F.contains(a, F.lit(".")) & decimals, "decimal number with precision")
        .when(a.startswith("-"), "negative number")
        .when(a.rlike(r"^\d+\z"), "whole number")
        .when(says(q, "percent", "percentage", "rate"), "percentage as decimal")
        .when(
            says(q, "increase", "decrease", "change", "difference"),
            "change value (can be positive or negative)",
        )
        .when(says(q, "ratio", "times", "multiple"), "ratio as decimal")
        .otherwise("numeric value")
    )


def _any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
