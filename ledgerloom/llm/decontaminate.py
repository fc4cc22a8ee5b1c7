"""Benchmark decontamination: one Aho-Corasick scan of each text for all windows of the test items.

Texts and items are normalised alike: A-Z in lower case, words are runs of digits, letters and bytes beyond
ASCII, joined by single spaces. A window is 13 consecutive words of an item, or the whole of a shorter one. Every
occurrence of a window marks its words in the text; marked words map back to code-point offsets of the original.

Defined results: a null text or item has no words; an item without words, or without an id, has no windows; items
repeated with one id count once, items of different ids with equal texts count each; repeated documents are
scanned one by one; empty tables give no rows, or no hits. Only the columns named are read or handed on.

The automaton grows with the benchmark, not with the corpus. Items are dealt into blocks of at most
``BLOCK_BYTES`` of text, each block has its own automaton, and the texts pass through the blocks one after the
other, so a benchmark of any size is matched in full and one automaton is in a worker's hands at a time per block.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import pass_through, texts

WINDOW = 13
#: Text of benchmark items whose automaton is built at once; about 100 bytes of memory per byte.
BLOCK_BYTES = 1 << 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The windows of an item, each with a space before, between and after its words."""
    if not words:
        return set()
    last = max(len(words) - size, 0)
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(last + 1)}


def automaton(items: list[tuple[str, bytes]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    """Matches every window; the value of a match is (words in the window, ids of the items that have it)."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(normalised(text), size):
            owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    built = ahocorasick.Automaton()
    for window, ids in owners.items():
        built.add_word(window.decode("latin-1"), (window.count(b" ") - 1, sorted(ids)))
    built.make_automaton()
    return built


def scan(text: bytes, built: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """Number of words, and (first word, word after the last, item ids) of every occurrence."""
    words = normalised(text)
    found: list[tuple[int, int, list[str]]] = []
    if built is None or not words:
        return len(words), found
    flat = b" " + b" ".join(words) + b" "
    ends = None
    for end, (length, ids) in built.iter(flat.decode("latin-1")):
        if ends is None:  # place of the space after each word
            ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)[1:]
        after = int(np.searchsorted(ends, end)) + 1
        found.append((after - length, after, ids))
    return len(words), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets, in the original text, of spans of words."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    data = np.frombuffer(text, np.uint8)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(before[places[a][0]]), int(before[places[b - 1][1]])) for a, b in spans]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SCANNED = T.StructType(
    [T.StructField("_spans", _SPANS), T.StructField("_ids", T.ArrayType(T.StringType()))]
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", _SPANS),
    ]
)


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], type=kind)


def item_blocks(items: DataFrame, item_id: str, text: str) -> list[list[tuple[str, bytes]]]:
    """Items with an id and a text, dealt into blocks of bounded size in the order of their ids."""
    rows = (
        items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
        .filter("item IS NOT NULL AND text IS NOT NULL")
        .orderBy("item", "text")
    )
    blocks: list[list[tuple[str, bytes]]] = []
    room = 0
    for row in rows.toLocalIterator():
        size = len(row.text)
        if not blocks or room < size:
            blocks.append([])
            room = max(BLOCK_BYTES, size)
        blocks[-1].append((row.item, bytes(row.text)))
        room -= size
    return blocks


def find_contamination(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", size: int = WINDOW
) -> DataFrame:
    """``keep`` and, per document, the columns of ``FOUND`` and ``contaminated``.

    ``spans`` holds the marked parts of the original text as code-point offsets, end exclusive.
    """
    rows = docs.select(
        *keep,
        F.col(text).cast("binary").alias("_text"),
        F.array().cast(_SPANS).alias("_spans"),
        F.array().cast("array<string>").alias("_ids"),
    )
    blocks = item_blocks(items, item_id, text) or [[]]
    for block in blocks[:-1]:
        rows = _through_block(rows, block, size)
    done = _through_block(rows, blocks[-1], size, last=True)
    return done.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _through_block(rows: DataFrame, block: list[tuple[str, bytes]], size: int, last: bool = False) -> DataFrame:
    """Add what the windows of one block of items find in each text; the last block also sums it up."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    built: list = []

    def search(batch: pa.RecordBatch) -> dict:
        if not built:
            built.append(automaton(shared.value, size))
        out: dict[str, list] = {n: [] for n in (FOUND if last else _SCANNED).names}
        before = batch.select(["_spans", "_ids"]).to_pydict()
        for data, spans, ids in zip(texts(batch, "_text"), before["_spans"], before["_ids"], strict=True):
            n_words, found = scan(data, built[0])
            spans = [(s["start"], s["end"]) for s in spans]
            if found:
                spans = merged(spans + [(a, b) for a, b, _ in found])
                ids = sorted({*ids, *(i for _, _, x in found for i in x)})
            if last:
                out["n_words"].append(n_words)
                out["n_hit"].append(sum(b - a for a, b in spans))
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                out["item_ids"].append(ids)
                out["spans"].append(original_offsets(data, spans) if spans else [])
            else:
                out["_spans"].append(spans)
                out["_ids"].append(ids)
        for name in {"_spans", "spans"} & out.keys():
            out[name] = _spans(out[name])
        return out

    if last:
        return pass_through(rows, FOUND, search, drop=("_text", "_spans", "_ids"))
    renamed = rows.withColumnsRenamed({"_spans": "_spans_before", "_ids": "_ids_before"})

    def search_more(batch: pa.RecordBatch) -> dict:
        return search(batch.rename_columns([c.removesuffix("_before") for c in batch.schema.names]))

    return pass_through(renamed, _SCANNED, search_more, drop=("_spans_before", "_ids_before"))
