"""Cumulative-snapshot collapse: keep the logged conversations that no longer one continues, then render them.

Each turn hashes its position, role and text to two 60-bit numbers; the running sums of these numbers over a
conversation are its turn-prefix hashes. A conversation is a snapshot when another, longer one has its full hash
among the prefixes of the same length. Snapshots go by an anti-join; of equal maximal conversations the one
with the smallest id stays.

Running sums are made in slices of positions, so a conversation that holds a third of all turns is still spread
over many tasks; everything that meets by hash is grouped first, so copies meet as one row.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their
own. A null role or text counts as empty. All rows with a null conversation id form one conversation. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_TURNS = 4_096
#: Parts to which the rows of one hash are dealt where they meet others.
SALTS = 16


def _number(name: Column, start: int) -> Column:
    """Fifteen hex digits of a digest as a decimal."""
    return F.conv(F.substring(name, start, 15), 16, 10).cast("decimal(38,0)")


def positions(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, position (1, 2, ...), role, text and ``slice`` of every turn.

    Turns of a conversation are cut by ranges of their turn number before they are ranked, and small counts carry
    the ranks over, so that only turns with one and the same number must meet in a task.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    hashed = rows.withColumn("name", F.sha2(F.concat_ws("\x00", "role", "text"), 256)).withColumn(
        "range", F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-(2**62)))
    )
    # Equal turns are counted, not listed: one row per distinct (turn, role, text) gets the rank of its first copy.
    kinds = hashed.groupBy("conv", "range", "turn", "role", "text", "name").agg(F.count(F.lit(1)).alias("held"))
    order = ["turn", "role", "text"]
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        hashed.groupBy("conv", "range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("conv").alias("conv_"), F.col("range").alias("range_"), F.sum("n").over(earlier).alias("before"))
        .filter("before > 0")
    )
    inside = Window.partitionBy("conv", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("inside", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    joined = ranked.join(
        before, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("range") == F.col("range_")), "left"
    )
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "held")))
    position = F.coalesce("before", F.lit(0)) + F.col("inside") + F.col("copy")
    return copies.select("conv", position.cast("long").alias("position"), "role", "text", "name").withColumn(
        "slice", F.floor((F.col("position") - 1) / SLICE_TURNS)
    )


def prefixes(placed: DataFrame) -> DataFrame:
    """conv, position, n (turns of the conversation) and the prefix hash up to each position."""
    mark = F.sha2(F.concat_ws(":", F.col("position").cast("string"), "name"), 256)
    marked = placed.select("conv", "position", "slice", mark.alias("mark"))
    marked = marked.select("conv", "position", "slice", _number(F.col("mark"), 1).alias("x"), _number(F.col("mark"), 16).alias("y"))
    inside = Window.partitionBy("conv", "slice").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(
        "conv", "position", "slice", F.sum("x").over(inside).alias("x"), F.sum("y").over(inside).alias("y")
    )
    whole = Window.partitionBy("conv").orderBy("slice")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    slices = (
        marked.groupBy("conv", "slice")
        .agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("position").alias("last"))
        .select(
            F.col("conv").alias("conv_"),
            F.col("slice").alias("slice_"),
            F.coalesce(F.sum("sx").over(earlier), F.lit(0)).alias("bx"),
            F.coalesce(F.sum("sy").over(earlier), F.lit(0)).alias("by"),
            F.max("last").over(every).alias("n"),
        )
    )
    joined = local.join(slices, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("slice") == F.col("slice_")))
    kind = "decimal(38,0)"
    return joined.select(
        "conv", "position", "n", (F.col("x") + F.col("bx")).cast(kind).alias("x"), (F.col("y") + F.col("by")).cast(kind).alias("y")
    )


def collapse(hashes: DataFrame) -> DataFrame:
    """conv, n_turns, ``is_snapshot`` (a longer conversation continues it) and ``kept`` of every conversation."""
    key = ["position", "x", "y"]
    finals = hashes.filter("position = n").select("conv", *key)
    inner = hashes.filter("position < n").groupBy(*key).agg(F.lit(True).alias("continued"))
    groups = finals.groupBy(*key).agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("held"))
    maximal = groups.join(inner, key, "left_anti").select(*key, "first")
    salted = maximal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = finals.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted.withColumn("is_maximal", F.lit(True)), [*key, "salt"], "left")
    kept = F.col("is_maximal") & F.col("conv").eqNullSafe(F.col("first"))
    return found.select(
        "conv",
        F.col("position").alias("n_turns"),
        F.col("is_maximal").isNull().alias("is_snapshot"),
        F.coalesce(kept, F.lit(False)).alias("kept"),
    )


def render(placed: DataFrame, collapsed: DataFrame) -> DataFrame:
    """conv, position and rendered text of each turn of the conversations that stay, in the chat layout."""
    kept = collapsed.filter("kept").select(F.col("conv").alias("conv_"))
    salted = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.withColumn("salt", F.pmod("position", F.lit(SALTS)).cast("int"))
    stays = F.col("conv").eqNullSafe(F.col("conv_")) & (dealt["salt"] == salted["salt"])
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return dealt.join(salted, stays, "left_semi").select("conv", "position", shown.alias("rendered"))
