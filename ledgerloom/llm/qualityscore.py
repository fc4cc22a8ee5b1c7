"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of every text are computed in one pass and stored. They are standardised, mapped to cosines of
random projections (which approximate a Gaussian kernel), and fitted by normal equations that each partition sums
for itself. At most ``FIT_ROWS`` labelled rows are used: four fifths for the ridge, one fifth for calibration.

Defined results: a null or empty text has zero statistics and is scored like any other; repeated rows get equal
scores; a null id is never learned from; without usable labels every score is 0.5; an empty table gives no rows.
Columns other than text and those kept are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import joined, pass_through
from ledgerloom.llm.labelled import Calibration, calibrate, draw, sample, stored
from ledgerloom.llm.words import Words, hash_of, lower_ascii, per_text

#: Bound on the labelled rows that the model is fitted on.
FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1.0
#: Width of the kernel per square root of the number of statistics.
WIDTH = 1.0
SEED = 7
STATISTICS = (
    "log_words",
    "log_bytes",
    "mean_word_bytes",
    "symbol_rate",
    "upper_rate",
    "digit_rate",
    "mark_rate",
    "shout_rate",
    "line_rate",
    "wide_rate",
    "distinct_rate",
    "repeat_rate",
    "function_word_rate",
)
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "a and are as at by for from in is it of on or that the this to was with das dem den der des die ein eine "
    "für im ist mit nicht sich und von zu au dans de du elle en est et la le les par pas pour que qui sur un une "
    "al con del el las lo los no para por se su una y"
).split()
SYMBOLS = b"#*$%&|<>"


def _is(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(data: np.ndarray, offsets: np.ndarray, function_words: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in ``STATISTICS``."""
    lower = lower_ascii(data)
    white = _is(data, b" \t\n\x0b\x0c\r")
    words = Words(lower, offsets, ~white)
    n_bytes, n_words = np.diff(offsets), np.diff(words.cuts)
    letters = ((lower >= 0x61) & (lower <= 0x7A)) | (data >= 0x80)
    upper = (data >= 0x41) & (data <= 0x5A)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    same = np.zeros(len(text_of), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (text_of[1:] == text_of[:-1])
    order = np.lexsort((words.hash, text_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    count = lambda flags: per_text(flags, offsets)
    by_word = lambda flags: per_text(flags, words.cuts)
    columns = [
        np.log1p(n_words),
        np.log1p(n_bytes),
        _rate(by_word(words.end - words.start), n_words),
        _rate(count(_is(data, SYMBOLS)), n_words),
        _rate(count(upper), count(letters)),
        _rate(count((data >= 0x30) & (data <= 0x39)), n_bytes),
        _rate(count(_is(data, b".,;:'\"()-")), n_words),
        _rate(count(_is(data, b"!?")), n_words),
        _rate(count(data == 0x0A), n_words),
        _rate(count(data >= 0x80), n_bytes),
        _rate(per_text(fresh, words.cuts), n_words),
        _rate(by_word(same), n_words),
        _rate(by_word(np.isin(words.hash, function_words)), n_words),
    ]
    return np.column_stack(columns).astype(np.float64)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``stats`` (array of doubles) of every document."""
    known = np.array([hash_of(w) for w in FUNCTION_WORDS], np.uint64)

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = joined(batch, "_text")
        found = statistics(data, offsets, known)
        sizes = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
        return {"stats": pa.ListArray.from_arrays(pa.array(sizes), pa.array(found.ravel()))}

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return pass_through(rows, T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType()))]), work, drop=("_text",), sliced_by=("_text",))


class Kernel:
    """Standardises statistics and maps them to random Fourier features, the last of which is constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draws = np.random.default_rng(SEED)
        n = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = draws.normal(size=(n, FEATURES)) / (WIDTH * np.sqrt(n))
        self.shift = draws.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.cos(scaled @ self.turn + self.shift) * np.sqrt(2 / FEATURES)
        return np.column_stack([waves, np.ones(len(stats))])


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, calibration: Calibration | None = None):
        self.kernel, self.weights, self.calibration = kernel, weights, calibration

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel(stats) @ self.weights


def _standards(rows: DataFrame, n: int) -> Kernel:
    each = [F.avg(F.col("stats")[i]) for i in range(n)] + [F.stddev_pop(F.col("stats")[i]) for i in range(n)]
    found = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(each)]).first()
    return Kernel(np.array(found[:n], float), np.array(found[n:], float))


def _ridge(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Solve the normal equations; every partition sends its own sums, which Spark adds up by cell."""

    def sums(batches):
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = kernel(matrix(batch, "stats"))
                y = np.asarray(batch.column(batch.schema.get_field_index("label")), np.float64)
                total += z.T @ np.column_stack([z, y])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    cells = rows.select("stats", "label").mapInArrow(sums, "i long, j long, v double").groupBy("i", "j")
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, j, v in cells.agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):
        total[int(i), int(j)] = v
    left, right = total[:, :-1], total[:, -1]
    penalty = RIDGE * np.eye(len(left))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(left + penalty, right)


def raw_scores(rows: DataFrame, model: Model, out: str = "raw") -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        raw = model.raw(matrix(batch, "stats"))
        return {out: model.calibration(raw) if model.calibration else raw}

    return pass_through(rows, T.StructType([T.StructField(out, T.DoubleType())]), work, drop=("stats",))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str, label: str, learn: Column) -> Model | None:
    """Fit on labelled rows for which ``learn`` (over the columns of ``labels``) holds; None without any."""
    chosen = sample(labels, doc_id, label, learn, FIT_ROWS, "quality")
    rows = stored(stats.join(chosen, "doc_id").select("doc_id", "stats", "label"), "quality-fit")
    if rows.isEmpty():
        return None
    calibrating = draw("doc_id", "quality-calibration") < 0.2
    kernel = _standards(rows, len(STATISTICS))
    model = Model(kernel, _ridge(rows.filter(~calibrating), kernel))
    return Model(kernel, model.weights, calibrate(raw_scores(rows.filter(calibrating), model)))


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """doc_id and ``score`` (0 to 1, higher: label 1 likelier) of every document."""
    stats = stored(measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "quality-stats")
    model = fit(stats, labels, doc_id, label, learn)
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    return raw_scores(stats, model, "score")
