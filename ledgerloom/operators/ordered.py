"""Ordered computations inside groups that stay parallel when one group is very large.

A window partitioned by a session puts the whole session into one task. Here a group is cut into slices by
a ``slice`` column that never decreases in the group's order; each slice is windowed on its own, and what
crosses a slice border (counts, last values, sums) travels through one small row per slice. Groups that fit
one slice pay a single shuffle plus a join against an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 65_536
#: Slices whose sums are carried on by one task.
FAN = 1 << 24


def _slice_of(position: str, slice_rows: int) -> Column:
    """Integer division, exact for every long."""
    return F.expr(f"({position}) div {slice_rows}")


def _attach(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(carried, keys, "left")


def number_rows(
    df: DataFrame,
    group: list[str],
    order: str,
    out: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``out``: 1, 2, ... inside each group by the integer column ``order``, unique in its group."""
    sliced = df.withColumn("_slice", _slice_of(order, slice_rows))
    keys = [*group, "_slice"]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.sum("_rows").over(earlier).alias("_before"))
        .filter("_before > 0")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        _attach(sliced.withColumn("_local", local), offsets, keys)
        .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_slice", "_local", "_before")
    )


def with_previous(
    numbered: DataFrame,
    group: list[str],
    number: str,
    depth: int,
    item: Column,
    out: str,
    slice_rows: int = SLICE_ROWS,
    keep_slice: bool = False,
) -> DataFrame:
    """Add ``out``: array of ``item`` over the up to ``depth`` rows before each row, oldest first.

    ``number`` must count 1, 2, ... in the group. The last ``depth`` rows of a slice are also handed to the
    next one, so no window ever spans more than ``slice_rows + depth`` rows. ``keep_slice`` leaves the column
    ``_slice`` in place, so that ``carry_forward`` can go on without another shuffle.
    """
    if depth >= slice_rows:
        raise ValueError("depth must be smaller than slice_rows")
    position = F.col(number) - 1
    home = _slice_of(f"{number} - 1", slice_rows)
    both = F.array(home, home + 1)
    handed_on = numbered.withColumn("_home", home).withColumn(
        "_slice",
        F.explode(
            F.when(position % slice_rows >= slice_rows - depth, both).otherwise(F.array(home))
        ),
    )
    recent = (
        Window.partitionBy(*group, "_slice").orderBy(number).rowsBetween(-depth, Window.currentRow - 1)
    )
    return (
        handed_on.withColumn(out, F.collect_list(item).over(recent))
        .filter("_home = _slice")
        .drop("_home", *([] if keep_slice else ["_slice"]))
    )


def carry_forward(
    numbered: DataFrame,
    group: list[str],
    number: str,
    items: dict[str, Column],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add one column per item: its latest non-null value among the rows *before* each row.

    A ``_slice`` column kept by ``with_previous`` is used, and dropped.
    """
    keys = [*group, "_slice"]
    sliced = numbered
    if "_slice" not in numbered.columns:
        sliced = numbered.withColumn("_slice", _slice_of(f"{number} - 1", slice_rows))
    for name, item in items.items():
        sliced = sliced.withColumn(f"_item_{name}", item)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last_per_slice = sliced.groupBy(*keys).agg(
        *[
            F.max_by(f"_item_{n}", F.when(F.col(f"_item_{n}").isNotNull(), F.col(number))).alias(
                f"_last_{n}"
            )
            for n in items
        ]
    )
    carried = last_per_slice.select(
        *keys,
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_carried_{n}") for n in items],
    ).filter(" OR ".join(f"_carried_{n} IS NOT NULL" for n in items))
    local = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    windowed = sliced.select(
        "*", *[F.last(f"_item_{n}", ignorenulls=True).over(local).alias(f"_local_{n}") for n in items]
    )
    return _attach(windowed, carried, keys).select(
        *[c for c in numbered.columns if c != "_slice"],
        *[F.coalesce(f"_local_{n}", f"_carried_{n}").alias(n) for n in items],
    )


def _before(sums: DataFrame, group: list[str], names: list[str], levels: int) -> DataFrame:
    """group, _slice and ``_before_{name}``: of every slice, the sums of all slices before it.

    Slices are cut in runs of ``FAN`` by their number. Each run is summed up on its own, what stands before a run is found
    in the same way from the totals of the runs, and the last level has so few rows that they meet in one place.
    """
    run = [*group, "_run"]
    by = F.pmod("_slice", F.lit(1)) if levels == 0 else _slice_of("_slice", FAN)
    cut = sums.withColumn("_run", by)
    earlier = Window.partitionBy(*run).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select(*run, "_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    if levels == 0:
        return inside.drop("_run")
    totals = cut.groupBy(*run).agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in names])
    outside = _before(totals.withColumnRenamed("_run", "_slice"), group, names, levels - 1).select(
        *group, F.col("_slice").alias("_run"), *[F.col(f"_before_{n}").alias(f"_run_{n}") for n in names]
    )
    return inside.join(outside, run).select(
        *group, "_slice", *[(F.col(f"_before_{n}") + F.col(f"_run_{n}")).alias(f"_before_{n}") for n in names]
    )


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    group: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
    levels: int = 1,
) -> DataFrame:
    """Add cumulative sums ``{out: column}`` up to and including each row, by the integer ``order``.

    Sums travel through slices of ``slice_rows``, runs of ``FAN`` slices, and so on for ``levels``; with the defaults, all
    whole numbers make at most 2 ** 23 runs, so no task meets more rows than that at the last level.
    """
    group = group or []
    keys = [*group, "_slice"]
    sliced = df.withColumn("_slice", _slice_of(order, slice_rows))
    sums = sliced.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in totals.items()])
    carried = _before(sums, group, list(totals), levels)
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    windowed = sliced.select("*", *[F.sum(c).over(local).alias(f"_local_{o}") for o, c in totals.items()])
    return _attach(windowed, carried, keys).select(
        *df.columns,
        *[
            (F.coalesce(f"_before_{o}", F.lit(0)) + F.col(f"_local_{o}")).alias(o)
            for o in totals
        ],
    )
