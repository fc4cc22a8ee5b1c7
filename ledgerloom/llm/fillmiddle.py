"""Fill-in-middle: texts cut in prefix, middle and suffix, and put together in another order.

A text is cut between units: words with the white space before them (white space at the end is a unit of its own), or
characters. Every byte becomes a symbol, its character class and whether it is white space right after a word, and a
wavelet matrix is made of the symbols of many texts. Ranks of the classes that begin a unit add up to the number of
units; bisection on these ranks finds the two cuts; ranks of continuation bytes turn byte places into code points.

Which units, and whether and how a text is rearranged, depends on draws from a keyed digest of its id. Texts that are
empty or contain a mark, and those not drawn, stay plain. The original text is rebuilt from output and form.

Defined results: a null text is empty; a null id has the draws of the key alone; repeated rows get equal results; an
empty table gives no rows. Columns that are not kept are not read; keeping a column with the name of an output is
refused with a ValueError. Memory is about six bytes per byte of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import joined, pass_through
from ledgerloom.llm.wavelet import WaveletMatrix

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are rearranged, and of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

BITS = 4
# Symbols. The last three are white space right after a byte of a word, where a unit of words begins.
LOWER, UPPER, DIGIT, MARK, LEAD, CONTINUATION, BLANK, BREAK, TAB, BLANK_AFTER, BREAK_AFTER, TAB_AFTER = range(12)
AFTER = BLANK_AFTER - BLANK
#: Symbols that begin a unit, except the first of a text.
UNITS = {
    "words": (BLANK_AFTER, BREAK_AFTER, TAB_AFTER),
    "characters": tuple(s for s in range(12) if s != CONTINUATION),
}

MADE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def _classes() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A] = LOWER, UPPER, DIGIT
    table[0x80:0xC0], table[0xC0:] = CONTINUATION, LEAD
    table[0x20], table[0x09], table[0x0A:0x0E] = BLANK, TAB, BREAK
    return table


CLASSES = _classes()


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The symbol of every byte of joined texts."""
    out = CLASSES[data]
    if len(out) > 1:
        after = (out[1:] >= BLANK) & (out[:-1] < BLANK)
        starts = offsets[(offsets > 0) & (offsets < len(data))]
        after[starts - 1] = False
        out[1:][after] += np.uint8(AFTER)
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, units: str):
    """Units of each text, and bytes and code points before the cuts at ``first`` and ``second`` modulo units + 1."""
    matrix = WaveletMatrix(symbols(data, offsets), BITS)
    begins = UNITS[units]
    start, end = offsets[:-1], offsets[1:]
    some = end > start
    inner = np.where(some, start + 1, start)
    n = some + matrix.count(begins, inner, end)
    drawn = np.sort(np.column_stack([first % (n + 1), second % (n + 1)]), axis=1)
    places, points = [], []
    for k in drawn.T:
        at = np.where(k == 0, start, end)
        inside = np.flatnonzero((k > 0) & (k < n))
        at[inside] = matrix.locate(begins, inner[inside], end[inside], k[inside])
        places.append(at)
        points.append(at - start - matrix.rank(CONTINUATION, start, at))
    return n, places, points


def fill_in_middle(
    docs: DataFrame,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    key: str = "42",
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    units: str = "words",
) -> DataFrame:
    """``keep`` and the columns of ``MADE``: units, form (plain, psm or spm), code points of the parts, and the new text."""
    if clash := set(keep) & {*MADE.names, "_text", "_draws"}:
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"), draws.alias("_draws"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = joined(batch, "_text")
        numbers = batch.column(batch.schema.get_field_index("_draws")).flatten()
        draw = np.asarray(numbers, np.int64).reshape(-1, 4)
        n, places, points = cuts(data, offsets, draw[:, 0], draw[:, 1], units)
        whole = memoryview(data).cast("B") if len(data) else memoryview(b"")
        form, output = [], []
        bounds = np.column_stack([offsets[:-1], *places, offsets[1:]]).tolist()
        for (a, b, c, d), (_, _, h, order) in zip(bounds, draw.tolist(), strict=True):
            body = bytes(whole[a:d])
            if h % 100 >= rate or not body or any(x in body for x in marks):
                form.append("plain")
                output.append(body)
                continue
            prefix, middle, suffix = body[: b - a], body[b - a : c - a], body[c - a :]
            if order % 100 < suffix_first:
                form.append("spm")
                output.append(b"".join((s, suffix, p, prefix, m, middle)))
            else:
                form.append("psm")
                output.append(b"".join((p, prefix, s, suffix, m, middle)))
        plain = np.array([f == "plain" for f in form], bool)
        return {
            "n": n,
            "form": form,
            "prefix_chars": pa.array(points[0], mask=plain),
            "middle_chars": pa.array(points[1] - points[0], mask=plain),
            "output": pa.array(output, pa.string()),
        }

    return pass_through(rows, MADE, work, drop=("_text", "_draws"), sliced_by=("_text",))


def restored(output: str, form: str) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
