"""Tables that micro-batches keep up to date: a base and a bounded number of deltas, merged by key.

Each batch writes one delta, which a repeated batch overwrites. After ``EVERY`` deltas a batch also merges all of them with the
base into a new base, named after itself, and drops what the base before it replaced. So a table has at most one base
in use, the one before it for readers that still hold it, and ``EVERY`` deltas, however many batches there were, and a
batch costs what it changed, plus its share of a merge.

The merge must not depend on how rows are divided among deltas; it is also how readers see one row per key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 8
_DONE = "_SUCCESS"


@dataclass(frozen=True)
class Kind:
    """What a batch adds (from the rows that arrived and the number of the batch), and how additions are merged."""

    addition: Callable[[DataFrame, int], DataFrame]
    merged: Callable[[DataFrame], DataFrame]


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders ``name=number`` below a path, ascending."""
    system, where = _system(spark, path)
    if not system.exists(where):
        return []
    found = [s.getPath() for s in system.listStatus(where) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if exists(spark, f"{p}/{_DONE}"))


def _drop(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def _live(spark: SparkSession, path: str) -> tuple[list[str], list[int]]:
    """Folders that make up the table, and the numbers of the deltas among them."""
    bases = _numbers(spark, path, "base")
    last = bases[-1] if bases else -1
    deltas = [n for n in _numbers(spark, path, "delta") if n > last]
    return [f"{path}/base={last}"] * bool(bases) + [f"{path}/delta={n}" for n in deltas], deltas


def add(kind: Kind, arrived: DataFrame, batch: int, path: str) -> None:
    """Take in one micro-batch; to be repeated safely with the same number and rows."""
    spark = arrived.sparkSession
    if batch in _numbers(spark, path, "base"):
        return  # the batch was merged before it was recorded as done
    kind.addition(arrived, batch).write.mode("overwrite").parquet(f"{path}/delta={batch}")
    folders, deltas = _live(spark, path)
    if len(deltas) < EVERY:
        return
    kind.merged(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{path}/base={batch}")
    for number in _numbers(spark, path, "delta"):
        _drop(spark, f"{path}/delta={number}")
    for number in _numbers(spark, path, "base")[:-2]:
        _drop(spark, f"{path}/base={number}")


def read(spark: SparkSession, kind: Kind, path: str, schema: str | None = None) -> DataFrame:
    """The table as it is now: one row per key. A table that has not begun is empty if its schema is given."""
    folders, _ = _live(spark, path)
    if not folders and schema is not None:
        return spark.createDataFrame([], schema)
    return kind.merged(spark.read.parquet(*folders))


def first_by(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps, of each key, the row that is first by ``order``."""

    def merged(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        held = F.min_by(F.struct(*rest), F.col(order)).alias("_held")
        return rows.groupBy(*keys).agg(held).select(*keys, "_held.*").select(*rows.columns)

    return merged
