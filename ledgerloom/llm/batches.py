"""Passing columns through Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows and bytes that Spark hands to a Python worker at once; a single longer text still comes whole.
ROWS_AT_ONCE = 1_000
BYTES_AT_ONCE = 4 << 20
#: Bytes of text on which array work is done at once; a single longer text still is one slice.
SLICE_BYTES = 512 << 10


def pass_through(
    rows: DataFrame,
    outputs: T.StructType,
    work: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]],
    drop: tuple[str, ...] = (),
    sliced_by: tuple[str, ...] = (),
) -> DataFrame:
    """Apply ``work`` to every Arrow batch and add its columns to those of ``rows``; no shuffle.

    ``work`` sees all columns of ``rows`` and returns one value per row for each output. ``drop`` names columns
    that are not handed on; a kept column with the name of an output is refused with a ValueError. With ``sliced_by``, ``work`` gets slices of a batch in which these text columns have at most
    ``SLICE_BYTES`` bytes together, so that its arrays stay small whatever the batches are.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_AT_ONCE))
    kept = [f for f in rows.schema if f.name not in drop]
    schema = T.StructType([*kept, *outputs])
    names = [f.name for f in kept]
    if clash := set(names) & set(outputs.names):
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_type

    added = [(f.name, to_arrow_type(f.dataType)) for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, sliced_by) for b in batches):
            if not batch.num_rows:
                continue
            found = work(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for name, kind in added:
                values = found[name]
                columns.append(values if isinstance(values, pa.Array) else pa.array(values, type=kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[n for n, _ in added]])

    return rows.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, names: tuple[str, ...], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of one row or of at most ``most`` bytes in the named columns."""
    total = np.zeros(batch.num_rows + 1, np.int64)
    for name in names:
        total += joined(batch, name)[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(total, total[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column; null gives none."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def joined(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column in one array, and where each row starts in it (one more entry ends the last)."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
