"""Which short texts occur inside which longer ones, by shared substrings instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substring lengths used as join keys; a needle uses the longest that fits it.
GRAM_LENGTHS = [1, 2, 4, 8, 16]


def _grams(text: Column, length: Column) -> Column:
    """Distinct substrings of the given length; empty for a shorter text."""
    starts = F.when(
        F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, length)))


def contained_in(needles: DataFrame, hay: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every (needle row, hay row) where ``needle`` occurs in ``hay``; equal on the columns ``on``.

    Each needle is looked up through its rarest substring, so a prefix shared by all texts (``Customer#``)
    does not bring every text to every needle. A needle with a substring no text has drops out at once. A substring
    that very many texts have is split at run time (adaptive skew join), in proportion to what it holds.
    Needles should be distinct. Empty needles match every text of their ``on`` group, and only where there are such
    needles do texts have an empty substring.
    """
    on = on or []
    size = F.lit(GRAM_LENGTHS[0])
    for length in GRAM_LENGTHS[1:]:
        size = F.when(F.length("needle") >= length, F.lit(length)).otherwise(size)
    all_grams = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in GRAM_LENGTHS]), lambda n: _grams(F.col("hay"), n)
        )
    )
    some_empty = needles.agg(F.bool_or(F.col("needle") == "")).scalar()
    empty = F.when(some_empty, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    hay_grams = hay.select("*", F.explode(F.concat(all_grams, empty)).alias("_gram"))
    needle_grams = needles.select(
        *on,
        "needle",
        F.explode(
            F.when(F.col("needle") == "", F.array(F.lit(""))).otherwise(_grams(F.col("needle"), size))
        ).alias("_gram"),
    ).distinct()
    frequency = hay_grams.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_freq"))
    chosen = (
        needle_grams.join(frequency, [*on, "_gram"], "left")
        .groupBy(*on, "needle")
        .agg(F.min(F.struct(F.coalesce("_freq", F.lit(0)).alias("freq"), "_gram")).alias("_rarest"))
        .filter("_rarest.freq > 0")
        .select(*on, "needle", "_rarest._gram")
    )
    pairs = hay_grams.join(chosen, [*on, "_gram"])
    return pairs.filter(F.contains("hay", F.col("needle"))).drop("_gram")
