"""Values of written arithmetic such as ``(506.5 - 488.8) / 488.8``, folded with built-in functions.

Numbers, ``+ - * / **``, parentheses, signs and ``abs(...)`` are understood, with the usual precedence: powers bind
tightest and to the right, then signs, then products, then sums. The fold holds two stacks, of values and of open
operators, and reduces as far as the next token demands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\d+\.?\d*|\.\d+"
_TOKEN = rf"(\*\*|[-+*/()]|abs|{_NUMBER})"
# How tightly operators bind; signs are written u+ and u- once they are told from sums.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "u+": 3, "u-": 3, "**": 4}


def _is_number(token: Column) -> Column:
    return token.rlike(rf"^(?:{_NUMBER})\z")


def tokens(text: Column) -> Column:
    """Tokens of an expression, null where other characters are in it."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    whole = F.array_join(found, "") == F.regexp_replace(text, r"\s", "")
    return F.when(whole & (F.size(found) > 0), found)


def signed(found: Column) -> Column:
    """The tokens with signs marked, null where they do not follow each other as in an expression."""
    opens = ("+", "-", "*", "/", "**", "(")

    def before(i: Column) -> Column:
        return F.when(i > 0, F.get(found, i - 1))

    def starts(i: Column) -> Column:
        return (i == 0) | before(i).isin(*opens)

    def fits(t: Column, i: Column) -> Column:
        after_abs = F.coalesce(before(i) == "abs", F.lit(False))
        begins = F.coalesce(starts(i), F.lit(False))
        return (
            F.when(t == "(", begins | after_abs)
            .when(t.isin("+", "-"), ~after_abs)
            .when(t.isin("*", "/", "**", ")"), ~begins & ~after_abs)
            .when(t == "abs", begins)
            .otherwise(begins & ~t.rlike(r"^0+[1-9]\d*\z"))
        )

    fitting = F.transform(found, fits)
    ends = F.coalesce((F.element_at(found, -1) == ")") | _is_number(F.element_at(found, -1)), F.lit(False))
    marked = F.transform(
        found, lambda t, i: F.when(t.isin("+", "-") & F.coalesce(starts(i), F.lit(False)), F.concat(F.lit("u"), t)).otherwise(t)
    )
    return F.when(F.forall(fitting, lambda f: f) & ends, marked)


def _top(stack: Column) -> Column:
    return F.get(stack, F.size(stack) - 1)


def _without_top(stack: Column, n: int = 1) -> Column:
    return F.slice(stack, F.lit(1), F.size(stack) - n)


def _state(values: Column, open_: Column, fine: Column) -> Column:
    return F.struct(values.alias("values"), open_.alias("open"), fine.alias("fine"))


def _reduced(state: Column) -> Column:
    """Apply the operator on top."""
    values, operator = state["values"], _top(state["open"])
    b, a = _top(values), F.get(values, F.size(values) - 2)
    two = (
        F.when(operator == "+", a + b)
        .when(operator == "-", a - b)
        .when(operator == "*", a * b)
        .when(operator == "/", F.try_divide(a, b))
        .otherwise(F.pow(a, b))
    )
    one = F.when(operator == "u-", -b).when(operator == "abs", F.abs(b)).otherwise(b)
    unary = operator.isin("u-", "u+", "abs")
    left = F.when(unary, F.concat(_without_top(values), F.array(one))).otherwise(
        F.concat(_without_top(values, 2), F.array(two))
    )
    return _state(left, _without_top(state["open"]), state["fine"])


def _reduced_while(state: Column, least: Column | None = None) -> Column:
    """Reduce while the operator on top is no parenthesis and binds at least as tightly as ``least``."""
    binds = F.create_map(*[F.lit(x) for pair in _BINDS.items() for x in pair])

    def step(s: Column, _: Column) -> Column:
        top = _top(s["open"])
        more = top.isNotNull() & (top != "(")
        if least is not None:
            more = more & (F.coalesce(F.try_element_at(binds, top), F.lit(0)) >= least)
        return F.when(more, _reduced(s)).otherwise(s)

    return F.aggregate(state["open"], state, step)


def value(marked: Column) -> Column:
    """Value of the signed tokens; null where parentheses do not match or the result is no finite number."""
    binds = F.create_map(*[F.lit(x) for pair in _BINDS.items() for x in pair])

    def closed(s: Column) -> Column:
        return F.get(
            F.transform(
                F.array(_reduced_while(s)),
                lambda r: F.when(
                    F.size(r["open"]) > 0,
                    F.get(
                        F.transform(
                            F.array(_state(r["values"], _without_top(r["open"]), r["fine"])),
                            lambda q: F.when(_top(q["open"]) == "abs", _reduced(q)).otherwise(q),
                        ),
                        F.lit(0),
                    ),
                ).otherwise(_state(r["values"], r["open"], F.lit(False))),
            ),
            F.lit(0),
        )

    def pushed(s: Column, t: Column) -> Column:
        return F.get(
            F.transform(
                F.array(
                    F.when(t.startswith("u") | (t == "**"), s).otherwise(
                        _reduced_while(s, F.try_element_at(binds, t))
                    )
                ),
                lambda r: _state(r["values"], F.concat(r["open"], F.array(t)), r["fine"]),
            ),
            F.lit(0),
        )

    def step(s: Column, t: Column) -> Column:
        return (
            F.when(_is_number(t), _state(F.concat(s["values"], F.array(t.try_cast("double"))), s["open"], s["fine"]))
            .when(t.isin("(", "abs"), _state(s["values"], F.concat(s["open"], F.array(t)), s["fine"]))
            .when(t == ")", closed(s))
            .otherwise(pushed(s, t))
        )

    def result(s: Column) -> Column:
        last = F.get(F.transform(F.array(_reduced_while(s)), lambda r: r), F.lit(0))
        out = F.get(last["values"], F.lit(0))
        whole = last["fine"] & (F.size(last["open"]) == 0) & (F.size(last["values"]) == 1)
        return F.when(whole & ~F.isnan(out) & (F.abs(out) < float("inf")), out)

    none = F.array().cast("array<double>")
    return F.aggregate(marked, _state(none, F.array().cast("array<string>"), F.lit(True)), step, result)
