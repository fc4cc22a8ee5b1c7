"""Finding table labels and cells from approximate row and column names, in stages.

First an equality join on (record, label in lower case) answers every request that names a label outright. Only the others
are open for the second join, which brings the table's labels in bounded arrays (LABELS_PER_SLICE) for the substring
rules; and only those still without an answer meet them a third time, where built-in functions bound the similarity of
each label from lengths and letters, and the similarity function sees the labels that may reach it. A request
travels through the stages as one row, so its columns must be groupable (no maps).
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numeric import strip, to_float

LABELS_PER_SLICE = 256
_SIMILAR = T.StructType(
    [
        T.StructField("rank", T.DoubleType()),
        T.StructField("ord", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)
MIN_OVERLAP = 0.3
MIN_SIMILARITY = 0.4
MATCHERS_KEPT = 4096
RATIOS_KEPT = 16_384
_PLACED = pa.struct([("rank", pa.float64()), ("place", pa.int32())])
#: Rows that are listed for a request that finds none.
LISTED_ROWS = 10


def _axis_labels(cells: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """record_id, axis, ord, label of every cell's column and row, from one pass."""
    each = [
        F.struct(F.lit(a).alias("axis"), F.col(f"{a}_ord").alias("ord"), F.col(f"{a}_name").alias("label")) for a in axes
    ]
    return cells.select("record_id", F.inline(F.array(*each)))


def _equal_labels(cells: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """The first label of every spelling: record_id, axis, needle (lower case), _equal struct(ord, label)."""
    return _axis_labels(cells, axes).groupBy("record_id", "axis", F.lower("label").alias("needle")).agg(
        F.min(F.struct("ord", "label")).alias("_equal")
    )


def label_slices(cells: DataFrame, axes: tuple[str, ...] = ("col", "row")) -> DataFrame:
    """Labels as arrays of struct(ord, label, low): record_id, axis, slice, labels."""
    distinct = F.array_sort(F.collect_set(F.struct("ord", "label")))
    return _axis_labels(cells, axes).groupBy("record_id", "axis", F.expr(f"ord div {LABELS_PER_SLICE}").alias("slice")).agg(
        F.transform(
            distinct,
            lambda l: F.struct(
                l["ord"].alias("ord"), l["label"].alias("label"), F.lower(l["label"]).alias("low")
            ),
        ).alias("labels")
    )


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _first_containing(needle: Column) -> Column:
    """First label of a slice where either text contains the other: struct(ord, label)."""
    first = F.get(F.filter("labels", lambda l: _either_contains(l["low"], needle)), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["ord"].alias("ord"), first["label"].alias("label")))


def _closest(needle: Column) -> Column:
    """Best of a slice by length overlap; an equal label beats every other."""
    hits = F.filter("labels", lambda l: _either_contains(l["low"], needle))

    def overlap(l: Column) -> Column:
        shorter = F.least(F.length(l["low"]), F.length(needle))
        longer = F.greatest(F.length(l["low"]), F.length(needle))
        return F.when(l["low"] == needle, F.lit(2.0)).otherwise(shorter / longer)

    return F.array_min(
        F.transform(
            hits,
            lambda l: F.struct(
                (-overlap(l)).alias("rank"), l["ord"].alias("ord"), l["label"].alias("label")
            ),
        )
    )


def _meet(rows: DataFrame, slices: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the label slices of their key where ``_open`` is true, once and without labels elsewhere.

    Rows that need no labels keep their own key: a null instead would bring all of them to one task.
    """
    keys = {key: f"_{key}" for key in on}
    same = [F.col(key) == F.col(own) for key, own in keys.items()]
    return rows.join(slices.withColumnsRenamed(keys), [F.col("_open"), *same], "left").drop("_open", *keys.values())


def _names(labels: str | Column) -> Column:
    return F.transform(labels, lambda l: l["label"])


def _staged(requests: DataFrame, cells: DataFrame, needles: dict[str, dict[str, Column]], listed: int | None = None) -> DataFrame:
    """The equality and substring stages for all axes at once; columns of requests, then per axis:

    ``{axis}_equal``, ``{axis}_part``: struct(ord, label) of the equal and of the first containing label; ``{axis}_close``:
    struct(rank, ord, label) of the largest length overlap, where wanted; ``{axis}_tried``: labels of a request that has
    neither, the first ``listed``. ``needles`` has, per axis, the stripped text in lower case (``direct``) and, where
    overlaps are wanted, the text in lower case (``close``).
    """
    axes = tuple(needles)
    none = F.lit(None).cast("string")
    lookups = F.array(
        *[
            F.struct(F.lit(a).alias("axis"), n.get("direct", none).alias("needle"), n.get("close", none).alias("_close"))
            for a, n in needles.items()
        ]
    )
    names = requests.columns
    asked = requests.select("*", F.inline(lookups)).join(_equal_labels(cells, axes), ["record_id", "axis", "needle"], "left")
    # Settled by an equal label, unless overlaps come first and go by another text; an empty text finds nothing.
    settled = F.col("_equal").isNotNull() & F.coalesce(F.col("_close") == F.col("needle"), F.lit(True))
    blank = (F.coalesce("needle", F.lit("")) == "") & (F.coalesce("_close", F.lit("")) == "")
    tried = _meet(asked.withColumn("_open", ~settled & ~blank), label_slices(cells, axes), ["record_id", "axis"])
    needle = F.when(F.col("needle") != "", F.col("needle"))
    found = tried.select(
        *names, "axis", "_equal", "slice",
        F.when(F.col("_equal").isNull(), _first_containing(needle)).alias("_part"),
        F.when(F.col("_close") != "", F.when(settled, F.struct(
            F.lit(-2.0).alias("rank"), F.col("_equal.ord").alias("ord"), F.col("_equal.label").alias("label")
        )).otherwise(_closest(F.col("_close")))).alias("_near"),
        "labels",
    )

    def of(axis: str, column: Column | str) -> Column:
        return F.when(F.col("axis") == axis, F.col(column) if isinstance(column, str) else column)

    kept = F.struct(F.col("slice"), _names("labels" if listed is None else F.slice("labels", 1, listed)).alias("names"))
    columns = []
    for axis in axes:
        untold = of(axis, F.when(F.col("_part").isNull() & F.col("_equal").isNull() & F.col("labels").isNotNull(), kept))
        listing = F.flatten(F.transform(F.array_sort(F.collect_list(untold)), lambda s: s["names"]))
        columns += [
            F.min(of(axis, "_equal")).alias(f"{axis}_equal"),
            F.min(of(axis, "_part")).alias(f"{axis}_part"),
            F.min(of(axis, "_near")).alias(f"{axis}_near"),
            (listing if listed is None else F.slice(listing, 1, listed)).alias(f"{axis}_tried"),
            # Equal rows of requests come out as often as they went in.
            (F.count(of(axis, F.lit(1))) / F.greatest(F.lit(1), F.size(F.collect_set(of(axis, "slice"))))).alias(f"{axis}_times"),
        ]
    merged = found.groupBy(*names).agg(*columns)
    again = F.explode(F.sequence(F.lit(1), F.col(f"{axes[0]}_times").cast("int")))
    return merged.withColumn("_again", again).drop("_again", *[f"{a}_times" for a in axes])


def _column_needles() -> dict[str, dict[str, Column]]:
    return {"col": {"direct": F.lower(strip(F.col("column_identifier")))}}


def _row_needles(direct: bool, close: bool) -> dict[str, dict[str, Column]]:
    texts = {}
    if direct:
        texts["direct"] = F.lower(strip(F.col("row_identifier")))
    if close:
        texts["close"] = F.lower(F.col("row_identifier"))
    return {"row": texts}


def _with_columns(staged: DataFrame) -> DataFrame:
    """The columns that ``match_columns`` adds, from the outcome of the stages."""
    best = F.coalesce("col_equal", "col_part")
    return staged.withColumns(
        {
            "col_ord": best["ord"],
            "matched_column": best["label"],
            "column_match": F.when(F.col("col_equal").isNotNull(), "exact").when(F.col("col_part").isNotNull(), "partial"),
            "columns_tried": F.when(best.isNull() & (F.size("col_tried") > 0), F.col("col_tried")),
        }
    ).drop("col_equal", "col_part", "col_near", "col_tried")


def match_columns(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """(request_id, record_id, column_identifier) to the column it names: equal, else first containing.

    ``columns_tried`` lists the table's columns for a request that finds none.
    """
    return _with_columns(_staged(requests, cells, _column_needles()))


def match_column_lists(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Replace every wanted name in ``target_columns`` by the column it matches; names without one go."""
    named = requests.select(
        "request_id", "record_id", F.posexplode_outer("target_columns").alias("_pos", "column_identifier")
    )
    hit = F.when(F.col("matched_column").isNotNull(), F.struct("_pos", "matched_column"))
    return (
        match_columns(named, cells)
        .groupBy("request_id", "record_id")
        .agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
        .select(
            "request_id", "record_id", F.transform("_hits", lambda h: h["matched_column"]).alias("target_columns")
        )
    )


def closest_label(requests: DataFrame, cells: DataFrame, axis: str = "row") -> DataFrame:
    """(request_id, record_id, row_identifier) to the label with the largest length overlap above 0.3."""
    text = F.lower(F.col("row_identifier"))
    # The equality stage goes by the same text as the overlaps do.
    staged = _staged(requests, cells, {axis: {"direct": text, "close": text}})
    label = F.when(F.col(f"{axis}_near.rank") < -MIN_OVERLAP, F.col(f"{axis}_near.label"))
    return staged.select(
        *requests.columns,
        label.alias("matched_label"),
        F.when(label.isNotNull(), F.lit(0.5)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def _add_most_similar(rows: DataFrame, needle: str, possible: str, out: str) -> DataFrame:
    """Replace ``needle`` and ``possible`` (labels of a slice) by the label with the highest similarity ratio above the
    threshold, the first of equals; its rank is the negative ratio."""

    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Per text and list of labels the negative ratio and the place of the first label that is most similar."""
        # A matcher indexes its label once, and texts and labels recur across tables, so both are kept while they are few.
        matchers: dict[str, SequenceMatcher] = {}
        ratios: dict[tuple[str, str], float] = {}

        def ratio(text: str, low: str) -> float:
            matcher = matchers.get(low)
            if matcher is None:
                if len(matchers) >= MATCHERS_KEPT:
                    matchers.clear()
                matcher = matchers[low] = SequenceMatcher(None, "", low)
            matcher.set_seq1(text)
            return matcher.ratio() if matcher.quick_ratio() > MIN_SIMILARITY else 0.0

        for texts, lists in batches:
            found = []
            for text, labels in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                best, score = None, MIN_SIMILARITY
                for place, low in enumerate(labels or ()):
                    known = ratios.get((text, low))
                    if known is None:
                        if len(ratios) >= RATIOS_KEPT:
                            ratios.clear()
                        known = ratios[text, low] = ratio(text, low)
                    if known > score:
                        score, best = known, {"rank": -known, "place": place}
                found.append(best)
            yield pa.array(found, _PLACED)

    lows = F.transform(possible, lambda l: l["low"])
    placed = rows.withColumn("_placed", F.arrow_udf(compare, "rank double, place int")(F.col(needle), lows))
    label = F.get(F.col(possible), F.col("_placed.place"))
    similar = F.struct(F.col("_placed.rank").alias("rank"), label["ord"].cast("long").alias("ord"), label["label"].alias("label"))
    return placed.withColumn(out, F.when(F.col("_placed.place").isNotNull(), similar)).drop("_placed", needle, possible)


def _may_be_similar(needle: Column, low: Column) -> Column:
    """Whether the similarity of two texts can exceed the threshold: twice the letters that each has of the other, by their length."""
    total = F.length(needle) + F.length(low)

    def shared(text: Column, other: Column) -> Column:
        return F.length(text) - F.length(F.call_function("translate", text, other, F.lit("")))

    by_length = 2 * F.least(F.length(needle), F.length(low)) > MIN_SIMILARITY * total
    return by_length & (2 * F.least(shared(needle, low), shared(low, needle)) > MIN_SIMILARITY * total)


def _with_similar(staged: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``_similar`` struct(rank, ord, label) for requests whose row no rule before has found."""
    names = staged.columns
    needle = F.lower(strip(F.col("row_identifier")))
    close = F.coalesce(F.col("row_near.rank") < -MIN_OVERLAP, F.lit(False))
    open_ = F.col("row_equal").isNull() & F.col("row_part").isNull() & ~close & (needle != "")
    slices = label_slices(cells, ("row",)).drop("axis")
    tried = _meet(staged.withColumn("_open", open_), slices, ["record_id"])
    possible = F.filter("labels", lambda l: _may_be_similar(needle, l["low"]))
    bounded = tried.select(*names, "slice", needle.alias("_needle"), possible.alias("_possible"))
    best = _add_most_similar(bounded, "_needle", "_possible", "_similar")
    key = [c for c in names if c not in ("row_tried", "col_tried")]
    held = [F.first(c).alias(c) for c in names if c not in key]
    times = F.count(F.lit(1)) / F.greatest(F.lit(1), F.size(F.collect_set("slice")))
    similar = F.min(F.when(F.col("_similar.label").isNotNull(), F.col("_similar"))).alias("_similar")
    merged = best.groupBy(*key).agg(*held, similar, times.cast("int").alias("_times"))
    return merged.withColumn("_again", F.explode(F.sequence(F.lit(1), "_times"))).drop("_again", "_times")


def _with_rows(staged: DataFrame, cells: DataFrame, fuzzy: bool) -> DataFrame:
    """The columns that ``match_rows`` adds, from the outcome of the stages."""
    if fuzzy:
        staged = _with_similar(staged, cells)
    else:
        staged = staged.withColumn("_similar", F.lit(None).cast(_SIMILAR))
    close = F.coalesce(F.col("row_near.rank") < -MIN_OVERLAP, F.lit(False))
    kind = (
        F.when(close, "overlap")
        .when(F.col("row_equal").isNotNull(), "exact")
        .when(F.col("row_part").isNotNull(), "partial")
        .when(F.col("_similar").isNotNull(), "similar")
    )

    def picked(field: str) -> Column:
        return F.when(close, F.col(f"row_near.{field}")).otherwise(
            F.coalesce(F.col(f"row_equal.{field}"), F.col(f"row_part.{field}"), F.col(f"_similar.{field}"))
        )

    score = (
        F.when(kind == "similar", -F.col("_similar.rank"))
        .when(kind == "exact", F.lit(1.0))
        .when(kind == "partial", F.lit(0.8))
        .when(kind == "overlap", F.lit(0.5))
    )
    return staged.withColumns(
        {
            "row_ord": picked("ord").cast("long"),
            "matched_row": picked("label"),
            "row_match": kind,
            "row_score": score,
            "rows_tried": F.when(kind.isNull() & (F.size("row_tried") > 0), F.col("row_tried")),
        }
    ).drop("row_equal", "row_part", "row_near", "row_tried", "_similar")


def match_rows(
    requests: DataFrame,
    cells: DataFrame,
    overlap_first: bool = False,
    fuzzy: bool = True,
    listed_rows: int = LISTED_ROWS,
) -> DataFrame:
    """Row labels for (request_id, record_id, row_identifier), with how they matched and the score.

    Order of rules: equal (1.0), first containing either way (0.8), then the most similar above 0.4. With
    ``overlap_first`` the overlap rule (0.5) comes before all of these, as in a cell lookup. ``rows_tried``
    lists the first rows of the table for a request that finds none.
    """
    return _with_rows(_staged(requests, cells, _row_needles(True, overlap_first), listed_rows), cells, fuzzy)


def get_values(requests: DataFrame, cells: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Cell lookup for (request_id, record_id, row_identifier, column_identifier).

    ``cells`` must hold one table per record id; where ids repeat, take the cells of ``records.usable_records``.
    Formatted amounts come back as numbers, other values as trimmed text. ``status`` tells what was missing,
    and ``available`` the labels there were to choose from.
    """
    staged = _staged(requests, cells, _column_needles() | _row_needles(True, True))
    located = _with_rows(_with_columns(staged), cells, fuzzy)
    values = cells.select("record_id", "col_ord", F.col("row_ord").cast("long").alias("row_ord"), "raw")
    fetched = located.join(values, ["record_id", "col_ord", "row_ord"], "left")
    blank = (F.coalesce(strip(F.col("row_identifier")), F.lit("")) == "") | (
        F.coalesce(strip(F.col("column_identifier")), F.lit("")) == ""
    )
    status = (
        F.when(blank, "MISSING_IDENTIFIERS")
        .when(F.col("matched_column").isNull(), "COLUMN_NOT_FOUND")
        .when(F.col("matched_row").isNull(), "ROW_NOT_FOUND")
        .when(F.coalesce("raw", F.lit("")) == "", "NULL_VALUE")
        .otherwise("OK")
    )
    ok = F.col("status") == "OK"
    return fetched.withColumn("status", status).select(
        "request_id",
        "record_id",
        "row_identifier",
        "column_identifier",
        "matched_row",
        "matched_column",
        "row_match",
        F.when(ok, to_float(F.col("raw"))).alias("value"),
        F.when(ok, strip(F.col("raw"))).alias("value_text"),
        "status",
        F.when(F.col("status") == "COLUMN_NOT_FOUND", F.col("columns_tried"))
        .when(F.col("status") == "ROW_NOT_FOUND", F.slice("rows_tried", 1, LISTED_ROWS))
        .alias("available"),
    )
