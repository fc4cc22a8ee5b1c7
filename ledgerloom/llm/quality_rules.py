"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Defined results: a null text counts as empty; an empty text, or one of white space only, has no words, fails
``n_words`` and gets null ratios, which fail no other rule. Repeated rows are judged one by one, an empty table
gives an empty result, and columns of the input other than those kept are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, and the symbols that are counted.
WHITE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu auf auch "
    "au avec dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "al con del el ella es las lo los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``metric`` lies below ``low`` or above ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (Rule("n_words", low=50), Rule("repeat_word_ratio", high=0.5))
RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.4),
    Rule("stop_word_ratio", low=0.02),
    Rule("duplicate_line_ratio", high=0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METRICS = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "duplicate_line_ratio", "repeat_word_ratio")


def _repeated_words(hashes: str, ranked: str) -> Column:
    """Words inside a window whose hash another window has; ``ranked`` holds (hash, position) in order."""
    seen_twice = F.filter(
        ranked,
        lambda x, i: (x["h"] == F.get(ranked, i - 1)["h"]) | (x["h"] == F.get(ranked, i + 1)["h"]),
    )
    words = F.flatten(F.transform(seen_twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return F.when(F.col(ranked).isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(words))).cast("long")


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in ``keep``, the counts and the ratios of every document.

    Three-word windows are compared by 64-bit hash inside one text, sorted with their positions, so a text of n
    words costs n log n whatever it repeats.
    """
    whole = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    trimmed = F.trim("_text", F.lit(WHITE))
    split = whole.withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    ).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    windows = split.withColumn(
        "_hashes",
        F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    )
    ranked = windows.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    counted = ranked.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_hashes", "_ranked").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(_spellings()))).alias("_n_stop"),
    )
    per_word = F.nullif(F.col("n_words"), F.lit(0))
    return counted.select(
        *keep,
        *COUNTS,
        (F.col("word_chars") / per_word).alias("mean_word_chars"),
        (F.col("n_symbols") / per_word).alias("symbol_ratio"),
        (F.col("_n_stop") / per_word).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.nullif(F.col("_n_lines"), F.lit(0))).alias("duplicate_line_ratio"),
        (F.col("n_repeat_words") / per_word).alias("repeat_word_ratio"),
    )


def _spellings() -> list[str]:
    words = dict.fromkeys(STOP_WORDS)
    return [*words, *[w.capitalize() for w in words]]


def broken(rule: Rule) -> Column:
    value = F.col(rule.metric)
    below = value < rule.low if rule.low is not None else F.lit(False)
    above = value > rule.high if rule.high is not None else F.lit(False)
    return F.coalesce(below | above, F.lit(False))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """Add ``failed_rules`` (names in table order, comma-joined) and ``kept``."""
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.metric)) for r in rules]), lambda n: n.isNotNull())
    return measured.withColumn("failed_rules", F.array_join(names, ",")).withColumn(
        "kept", F.col("failed_rules") == ""
    )
