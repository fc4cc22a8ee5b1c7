"""Secret scans with multipart credential linking, in built-in expressions only.

Strong kinds (assignments, access keys, long hex runs) are always reported. Weak kinds (key ids, 40-character
tokens, endpoints) are reported only when a complementary part lies within their scope: an identifier needs a
secret, a secret needs an identifier, an endpoint needs a secret. Parts of one text are joined as intervals, each with
``SCOPE`` code points on both sides: the parts of a role are ordered by start and kept in runs with the least start and
largest end of each, a candidate looks at the runs that reach it, and is compared exactly with the parts of those.

Offsets are code points of the original text, end exclusive. Matches are leftmost and do not overlap within a kind;
a weak candidate that touches a strong span is dropped. Defined results: a null text counts as empty; a text
without secrets has no spans; repeated rows are scanned one by one; an empty table gives no rows; columns other
than those kept are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` of a match must have at least ``least`` characters, or the match is dropped."""

    name: str
    pattern: str
    role: str
    strong: bool
    group: int = 0
    least: int = 1


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_PARTS = {w: _either_case(w) for w in ("access", "client", "account", "key", "id", "name", "https", "jdbc", "redis", "mongodb", "postgresql", "mysql", "amqp", "s3")}
#: Names of identifiers in any case, with or without a separator: CLIENT_ID, storageAccountName, accessKeyId.
_ID_NAMES = "(?:{access}|{client}|{account}|{key})[_-]?(?:{id}|{name}|{key}[_-]?{id})".format(**_PARTS)
_SCHEMES = "{https}?|{jdbc}:[A-Za-z]+|{redis}|{mongodb}|{postgresql}|{mysql}|{amqp}|{s3}".format(**_PARTS)
_VALUE = "[A-Za-z0-9_.@-]"
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: In the order in which spans of equal start are listed. A run of 24 or more hex digits is a whole run of hex
#: digits, and a run from AKIA on that is too short holds no longer one, so both bounds stand in the patterns.
KINDS = (
    Kind("assign", f"({_NAMES}){_GIVEN}([A-Za-z0-9+/_.=-]+)", SECRET, True, group=2, least=6),
    Kind("access", "AKIA[A-Z0-9]{16,}", IDENTIFIER, True),
    Kind("hex", "[0-9a-f]{24,}", SECRET, True),
    Kind(
        "key_id",
        # The names of the SQL check match as they do there; a value of the other forms that holds a pair is none.
        f"(?:(?:access|client|account|key)[_-](?:id|name|key_id){_GIVEN}"
        f"|{_ID_NAMES}{_GIVEN}(?!{_VALUE}*?{_ID_NAMES}{_GIVEN}{_VALUE}{{4}})){_VALUE}{{4,}}",
        IDENTIFIER,
        False,
    ),
    Kind("opaque", r"\b[A-Za-z0-9+/]{40}\b", SECRET, False),
    Kind("endpoint", rf"""(?:{_SCHEMES})://[^\x00-\x20"'<>]+""", ENDPOINT, False),
)
NEEDS = {IDENTIFIER: SECRET, SECRET: IDENTIFIER, ENDPOINT: SECRET}
#: Positions summed one after the other; running sums of n lengths take n * RUN + (n / RUN) ** 2 steps.
RUN = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: as the element of an array it is not copied into what refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.char_length(x).cast("long"))


def _running(way: Column) -> Column:
    """Running sums."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(way) / RUN).cast("int")), lambda b: _total(F.slice(way, b * RUN + 1, RUN))
    )

    def sums(before: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            block = F.floor(i / RUN).cast("int")
            return F.get(before, block) + _total(F.slice(way, block * RUN + 1, i % RUN + 1))

        return F.transform(way, at)

    return _let(
        blocks, lambda found: _let(F.transform(found, lambda x, b: _total(F.slice(found, F.lit(1), b))), sums)
    )


def _places(order: int, kind: Kind) -> Column:
    """Array of (start, kind, end) of the matches of one kind, in order."""
    pattern = F.lit(kind.pattern)
    matches = F.struct(
        _lengths(F.regexp_extract_all("_text", pattern, 0)).alias("all"),
        _lengths(F.split("_text", kind.pattern, -1)).alias("gaps"),
        _lengths(F.regexp_extract_all("_text", pattern, kind.group)).alias("held"),
    )

    def spans(m: Column) -> Column:
        n = F.size(m["all"])
        # Way from the start of the match before (or the start of the text) to the start of each match.
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(m["all"], F.lit(1), n - 1))
        way = F.zip_with(F.slice(m["gaps"], F.lit(1), n), before, lambda a, b: a + b)
        found = _let(way, _running)
        every = F.transform(
            F.arrays_zip(found.alias("start"), m["all"].alias("all"), m["held"].alias("held")),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(order).alias("kind"), (x["start"] + x["all"]).alias("end"), x["held"].alias("held")
            ),
        )
        whole = F.filter(every, lambda x: x["held"] >= kind.least)
        return F.transform(whole, lambda x: F.struct(x["start"], x["kind"], x["end"]))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.when(F.col("_text").rlike(kind.pattern), _let(matches, spans)).otherwise(none)


def _touches(x: Column, y: Column, margin: int) -> Column:
    return (y["start"] < x["end"] + margin) & (x["start"] < y["end"] + margin)


def _runs(spans: Column) -> Column:
    """Runs of ``RUN`` spans ordered by start: struct(start, end, at), the first start, largest end and place of the first."""
    places = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))
    runs = F.transform(
        places,
        lambda b: F.struct(
            F.get(spans, b * RUN)["start"].alias("start"),
            F.array_max(F.transform(F.slice(spans, b * RUN + 1, RUN), lambda s: s["end"])).alias("end"),
            (b * RUN + 1).alias("at"),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,at:int>>")
    return F.when(F.size(spans) > 0, runs).otherwise(none)


def _held(spans: Column, name: str) -> list[Column]:
    return [spans.alias(name), _runs(spans).alias(f"{name}_runs")]


def _any_near(w: Column, held: Column, name: str, margin: int) -> Column:
    """Whether one of the spans ``name`` of ``held``, which has their runs too, lies within ``margin`` of a span."""
    return F.exists(
        held[f"{name}_runs"],
        lambda r: _touches(w, r, margin) & F.exists(F.slice(held[name], r["at"], RUN), lambda s: _touches(w, s, margin)),
    )


def _of_role(parts: Column, role: str) -> Column:
    orders = [i for i, k in enumerate(KINDS) if k.role == role]
    return F.filter(parts, lambda s: s["kind"].isin(orders))


def _is_linked(w: Column, held: Column) -> Column:
    out = F.lit(False)
    for order, kind in enumerate(KINDS):
        if not kind.strong:
            out = F.when(w["kind"] == order, _any_near(w, held, NEEDS[kind.role], SCOPE)).otherwise(out)
    return out


def _with_linked(strong: Column, weak: Column) -> Column:
    """struct(strong, spans): the strong parts, and these with the weak ones that are linked."""

    def linked(own: Column) -> Column:
        parts = F.sort_array(F.concat(strong, own))
        held = F.struct(*[c for role in (IDENTIFIER, SECRET) for c in _held(_of_role(parts, role), role)])
        found = _let(held, lambda h: F.filter(own, lambda w: _is_linked(w, h)))
        return F.struct(strong.alias("strong"), F.sort_array(F.concat(strong, found)).alias("spans"))

    alone = _let(F.struct(*_held(strong, "strong")), lambda h: F.filter(weak, lambda w: ~_any_near(w, h, "strong", 0)))
    return _let(alone, linked)


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``strong`` and ``spans`` (strong and linked weak ones): arrays of (start, kind, end).

    ``kind`` is the place of the kind in ``KINDS``; both arrays are ordered by start, then kind. Keeping a column with the
    name of an output is refused with a ValueError.
    """
    if clash := set(keep) & {"strong", "spans", "_text", "_found"}:
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    df = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    places = {True: [], False: []}
    for order, kind in enumerate(KINDS):
        places[kind.strong].append(_places(order, kind))
    each = F.struct(F.sort_array(F.concat(*places[True])).alias("strong"), F.concat(*places[False]).alias("weak"))
    found = _let(each, lambda x: _with_linked(x["strong"], x["weak"]))
    return df.select(*keep, found.alias("_found")).select(*keep, "_found.strong", "_found.spans")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with ``mark`` in place of the spans (ordered by start); spans that overlap share one mark.

    The text is cut in stretches, one for each run of spans, and each stretch is rewritten on its own, so no step but the
    cutting goes through the whole text.
    """
    zero = F.lit(0).cast("bigint")

    def reached(runs: Column, upto: Column) -> Column:
        """The largest end in the runs before a place."""
        ends = F.transform(F.slice(runs, F.lit(1), upto), lambda r: r["end"])
        return F.greatest(zero, F.coalesce(F.array_max(ends), zero))

    def stretch(runs: Column, r: Column, b: Column) -> Column:
        base = reached(runs, b)
        piece = F.substr(text, (base + 1).cast("int"), (reached(runs, b + 1) - base).cast("int"))
        return F.struct(F.slice(spans, r["at"], RUN).alias("own"), base.alias("base"), piece.alias("text"))

    def rewritten(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            before = F.array_max(F.transform(F.slice(x["own"], F.lit(1), i), lambda y: y["end"]))
            at = F.greatest(x["base"], before)
            gap = F.substr(x["text"], (at - x["base"] + 1).cast("int"), (s["start"] - at).cast("int"))
            return F.when(s["start"] >= at, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

        return F.array_join(F.transform(x["own"], step), "")

    def rebuilt(runs: Column) -> Column:
        stretches = F.transform(runs, lambda r, b: stretch(runs, r, b))
        rest = F.substr(text, (reached(runs, F.size(runs)) + 1).cast("int"))
        return F.concat(F.array_join(F.transform(stretches, rewritten), ""), rest)

    whole = _let(_runs(F.col(spans)), rebuilt)
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(whole)


def listed(spans: str) -> Column:
    """The spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def count(spans: str, name: str) -> Column:
    order = [k.name for k in KINDS].index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == order)).cast("long")
