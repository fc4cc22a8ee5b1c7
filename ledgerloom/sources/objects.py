"""The elements of the arrays of one large JSON object, read by many tasks.

A JSON text without line ends cannot be split by lines, but it can be split at every closing brace: the text source
plans ranges of the file, and each task reads the pieces between the braces of its range. Whether a brace counts depends
on what stands before it: an even number of quotes, and two open brackets around the element that it closes. Both are sums
over all pieces before, so they are found by running sums: within a range, and over the few ranges. The pieces between two
such ends are joined again to one element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = r'"([^"]*)"\s*:\s*\[\s*'
_KEYS = rf"(?:{_KEY}(?:\][\s,]*)?)*"
# Before an element: the start of the object and the arrays that begin there, some of them empty; or what parts it from the
# element before, which may be the end of one array and the start of others.
_AT_START = rf"^\s*\{{[\s,]*{_KEYS}"
_AFTER_ELEMENT = rf"^[\s,]*(?:\][\s,]*{_KEYS})?"
_ELEMENT_DEPTH = 2


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _outside(text: Column, in_string: Column) -> Column:
    """The text without its strings; escapes have gone before."""
    opened = F.when(in_string, F.regexp_replace(text, r'^[^"]*("|\z)', "")).otherwise(text)
    return F.regexp_replace(opened, r'"[^"]*("|\z)', "")


def _running(pieces: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all pieces before, in the order of the file."""
    inside = Window.partitionBy("_file", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("_file", "_range").agg(F.sum(value).alias("_total"))
    # One row per range of the file, of some 100 MB each.
    earlier = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("_file", "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return (
        pieces.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, ["_file", "_range"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before")
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between closing braces, with quotes and depth before each and the number of the element it belongs to."""
    text = spark.read.option("lineSep", "}").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_at"),
    )
    plain = text.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))
    quoted = _running(plain.withColumn("_quotes", _count(F.col("_plain"), '"')), "_quotes", "_quotes_before")
    in_string = F.col("_quotes_before") % 2 == 1
    closes = (F.col("_quotes_before") + F.col("_quotes")) % 2 == 0
    outside = _outside(F.col("_plain"), in_string)
    change = (
        _count(outside, "{") + _count(outside, "[") - _count(outside, "]") - F.when(closes, 1).otherwise(0)
    )
    deep = _running(
        quoted.withColumn("_closes", closes).withColumn("_change", change).drop("_plain", "_quotes", "_quotes_before"),
        "_change", "_depth_before",
    )
    ends = F.col("_closes") & (F.col("_depth_before") + F.col("_change") == _ELEMENT_DEPTH)
    return _running(deep.withColumn("_ends", F.when(ends, 1).otherwise(0)), "_ends", "number")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """number, key (of the first element of an array) and text of every element, and the rest after the last, as ``tail``.

    ``depth`` is what is open after the text; an object that ends leaves none, white space after it counts one less.
    """
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_range", "_at", "value"))), lambda p: p["value"]), "}"
    )
    whole = _pieces(spark, path).groupBy("_file", "number").agg(
        joined.alias("_joined"),
        F.max("_ends").alias("_ends"),
        F.min_by("_depth_before", F.struct("_range", "_at")).alias("_start"),
        F.max_by(F.col("_depth_before") + F.col("_change"), F.struct("_range", "_at")).alias("depth"),
    )
    opening = F.when(F.col("_start") == 0, F.regexp_extract("_joined", _AT_START, 0)).otherwise(
        F.regexp_extract("_joined", _AFTER_ELEMENT, 0)
    )
    keys = F.regexp_extract_all(opening, F.lit(_KEY), F.lit(1))
    return whole.select(
        F.col("_file").alias("file"),
        "number",
        F.when(F.size(keys) > 0, keys).alias("keys"),
        F.when(F.col("_ends") == 1, F.concat(F.substr("_joined", F.length(opening) + 1), F.lit("}"))).alias("text"),
        F.when(F.col("_ends") == 0, F.substr("_joined", F.length(opening) + 1)).alias("tail"),
        "depth",
    )
