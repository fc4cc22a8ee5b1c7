"""Toxicity: gradient-boosted trees over dense features of each text, with isotonic calibration.

A lexicon of whole words and word beginnings is weighed by how much more often they stand in toxic texts of a
bounded sample of labelled rows; a few common insults belong to it from the start. Features are the densities of
lexicon words, how near they stand to second-person words, capitals, punctuation, and signs of obfuscation (digits
or symbols inside words, stretched letters, words that are in the lexicon only after undoing look-alikes). Trees and
calibration are Spark ML models fitted on the features of the sample; every text is measured and scored in one pass, by
slices of a batch, and a long text by segments, so memory does not grow with texts unless a single word does.

At most ``FIT_ROWS`` labelled rows are used: all of them for the lexicon, three quarters for the trees, one quarter
for the calibration.

Defined results: a null or empty text has zero features and is scored like any other; repeated rows get equal
scores; a null id is never learned from; with labels of one kind only, or none, every score is 0.5 times the
share of toxic labels; an empty table gives no rows. Columns other than text and those kept are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import SLICE_BYTES, joined, pass_through, slices
from ledgerloom.llm.labelled import calibrate, draw, sample, stored
from ledgerloom.llm.words import Words, hash_of, lower_ascii, per_text, per_word

#: Bound on the labelled rows that the lexicon and the models are fitted on.
FIT_ROWS = 16_000
#: Entries of the learned lexicon, and the toxic texts of the sample that an entry must stand in.
LEXICON = 512
SUPPORT = 4
#: Least weight (log of how many times likelier in toxic texts) of an entry.
LEAST_WEIGHT = 1.0
#: Lengths in bytes of the word beginnings looked at; 0 stands for the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8, 9, 10)
#: Occurrences in one text that count.
MOST_COUNTED = 3
#: Words on either side in which a second-person word is near.
NEAR = 3
TREES, DEPTH = 30, 4

# Common insults, second-person words, and look-alikes of letters.
INSULTS = "clown disgusting dumb fool garbage idiot loser moron pathetic scum stupid trash ugly worthless".split()
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted su sus"
).split()
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = (
    "weight_density",
    "hit_density",
    "log_hits",
    "log_strong_hits",
    "strong_density",
    "insult_density",
    "near_you",
    "you_density",
    "capitals",
    "all_capitals",
    "marks",
    "punctuation",
    "symbols",
    "mixed_words",
    "stretched",
    "hidden_hits",
    "log_words",
)


def _is(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters in lower case."""
    lower = lower_ascii(data)
    return Words(lower, offsets, _letters(lower))


def _keys(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words that have a beginning of ``length`` bytes, and its hash; all words whole for 0."""
    if length == 0:
        return np.arange(len(words.start)), words.hash
    long = np.flatnonzero(words.end - words.start >= length)
    return long, words.hashes(words.start[long], words.start[long] + length)


def _weights(words: Words, lexicon: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The largest weight of the lexicon entries that each word has."""
    out = np.zeros(len(words.start))
    for length, (hashes, weights) in lexicon.items():
        at, keys = _keys(words, length)
        place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        hit = hashes[place] == keys
        out[at[hit]] = np.maximum(out[at[hit]], weights[place[hit]])
    return out


def sums(data: np.ndarray, offsets: np.ndarray, lexicon: dict, insults: np.ndarray, you: np.ndarray):
    """One row of sums per text (bytes, tokens and words that have a property), and strong, you and text of each word.

    Only few of the arrays are held at once; all work is inside tokens.
    """
    count = lambda flags: per_text(flags, offsets)
    tokens = Words(data, offsets, ~_is(data, b" \t\n\x0b\x0c\r"))
    columns = {"tokens": np.diff(tokens.cuts)}
    del tokens
    upper = (data >= 0x41) & (data <= 0x5A)
    ascii_letter = upper | ((data >= 0x61) & (data <= 0x7A))
    columns |= {"upper": count(upper), "letters": count(ascii_letter)}
    for name, chars in (("marks", b"!?"), ("punctuation", b".,;:'\"()-"), ("symbols", b"#*$%&|<>@")):
        columns[name] = count(_is(data, chars))
    words = plain_words(data, offsets)
    # Inside a token: a digit or symbol between two letters, and three equal letters in a row.
    odd = np.zeros(len(data), bool)
    stretched = np.zeros(len(data), bool)
    if len(data) > 2:
        joint = _is(data, b"0123456789@$!*#.-_")
        odd[1:-1] = joint[1:-1] & ascii_letter[:-2] & ascii_letter[2:]
        lower = words.data
        stretched[2:] = ascii_letter[2:] & (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2])
    columns |= {"odd": count(odd), "stretched": count(stretched)}
    del odd, stretched, ascii_letter
    by_word = lambda flags: per_text(flags, words.cuts)
    weight = _weights(words, lexicon)
    insult = np.isin(words.hash, insults)
    weight[insult] = np.maximum(weight[insult], 5.0)
    is_you = np.isin(words.hash, you)
    shouted = per_word(upper, words) >= np.maximum(words.end - words.start, 3)
    columns |= {
        "words": np.diff(words.cuts), "weight": by_word(weight), "hits": by_word(weight > 0), "strong": by_word(weight >= 2.5),
        "insults": by_word(insult), "you": by_word(is_you), "shouted": by_word(shouted),
    }
    swapped = np.arange(256, dtype=np.uint8)
    for sign, letter in LOOK_ALIKES.items():
        swapped[ord(sign)] = ord(letter)
    undone = swapped[words.data]
    revealed = Words(undone, offsets, _letters(undone))
    columns["hidden"] = per_text(np.isin(revealed.hash, insults), revealed.cuts)
    text_of = np.repeat(np.arange(len(offsets) - 1), columns["words"])
    return columns, weight >= 2.5, is_you, text_of


def _segments(data: np.ndarray) -> list[int]:
    """Places at which a long text is cut: before white space, or at its end, about ``SLICE_BYTES`` apart."""
    bounds = [0]
    while len(data) - bounds[-1] > SLICE_BYTES:
        at = bounds[-1] + SLICE_BYTES
        white = np.flatnonzero(_is(data[at : at + SLICE_BYTES], b" \t\n\x0b\x0c\r"))
        while not len(white) and at + SLICE_BYTES < len(data):
            at += SLICE_BYTES
            white = np.flatnonzero(_is(data[at : at + SLICE_BYTES], b" \t\n\x0b\x0c\r"))
        if not len(white):
            break
        bounds.append(at + int(white[0]))
    return [*bounds, len(data)]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: dict, insults: np.ndarray, you: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``. A long text alone is gone through in segments."""
    if len(offsets) == 2 and len(data) > SLICE_BYTES:
        bounds = _segments(data)
        parts = [sums(data[a:b], np.array([0, b - a]), lexicon, insults, you) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        found = {name: sum(p[0][name] for p in parts) for name in parts[0][0]}
        strong, is_you, text_of = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    else:
        found, strong, is_you, text_of = sums(data, offsets, lexicon, insults, you)
    near = np.zeros(len(strong), bool)
    for k in range(1, NEAR + 1):
        same = text_of[k:] == text_of[:-k]
        near[k:] |= is_you[:-k] & same
        near[:-k] |= is_you[k:] & same
    near_you = np.bincount(text_of[strong & near], minlength=len(offsets) - 1)
    rate = lambda part, whole: part / np.maximum(whole, 1)
    n_words, n_tokens = found["words"], found["tokens"]
    columns = [
        rate(found["weight"], n_words),
        rate(found["hits"], n_words),
        np.log1p(found["hits"]),
        np.log1p(found["strong"]),
        rate(found["strong"], n_words),
        rate(found["insults"], n_words),
        rate(near_you, n_words),
        rate(found["you"], n_words),
        rate(found["upper"], found["letters"]),
        rate(found["shouted"], n_words),
        rate(found["marks"], n_tokens),
        rate(found["punctuation"], n_tokens),
        rate(found["symbols"], n_tokens),
        rate(found["odd"], n_tokens),
        rate(found["stretched"], n_tokens),
        np.maximum(found["hidden"] - found["insults"], 0),
        np.log1p(n_tokens),
    ]
    return np.column_stack(columns).astype(np.float64)


def learn_lexicon(texts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Entries by length of beginning, from (text, label) rows of the bounded sample: sorted hashes and weights.

    Only the best ``LEXICON`` entries leave the executors.
    """

    def tally(batches):
        for batch in chain.from_iterable(slices(b, ("text",)) for b in batches):
            data, offsets = joined(batch, "text")
            labels = np.asarray(batch.column(batch.schema.get_field_index("label")), np.float64)
            words = plain_words(data, offsets)
            text_of = np.repeat(np.arange(len(labels)), np.diff(words.cuts))
            for length in BEGINNINGS:
                at, keys = _keys(words, length)
                pairs = np.rec.fromarrays([keys, text_of[at]], names="key,text")
                found, times = np.unique(pairs, return_counts=True)
                toxic = labels[found.text] > 0.5
                times = np.minimum(times, MOST_COUNTED)
                keys, place = np.unique(found.key, return_inverse=True)
                sums = [
                    np.bincount(place, weights=w, minlength=len(keys)).astype(np.float64)
                    for w in (times * toxic, times * ~toxic, toxic.astype(float))
                ]
                columns = [pa.array(np.full(len(keys), length, np.int64)), pa.array(keys.view(np.int64)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "key", "toxic", "clean", "texts"])

    rows = texts.select(F.col("text").cast("binary").alias("text"), "label")
    totals = rows.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("every")).first()
    if not totals.every:
        return {}
    odds = (totals.every - totals.toxic + 1.0) / (totals.toxic + 1.0)
    schema = "length long, key long, toxic double, clean double, texts double"
    entries = (
        rows.mapInArrow(tally, schema)
        .groupBy("length", "key")
        .agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "texts")])
        .filter(F.col("texts") >= SUPPORT)
        .withColumn("weight", F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit(odds)))
        .filter(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "length", "key")
        .limit(LEXICON)
    )
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found = entries.select("length", "key", "weight").toPandas()
    for length, part in found.groupby("length"):
        keys = part.key.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out[int(length)] = (keys[order], np.minimum(part.weight.to_numpy()[order], 8.0))
    return out


def measured(docs: DataFrame, lexicon: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``features`` (array of doubles) of every document."""
    insults, you = (np.array([hash_of(w) for w in x], np.uint64) for x in (INSULTS, SECOND_PERSON))

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = joined(batch, "_text")
        found = features(data, offsets, lexicon, insults, you)
        sizes = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
        return {"features": pa.ListArray.from_arrays(pa.array(sizes), pa.array(found.ravel()))}

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
    return pass_through(rows, schema, work, drop=("_text",), sliced_by=("_text",))


class Model:
    """The lexicon, the trees and the calibration; without trees every score is ``flat``."""

    def __init__(self, lexicon: dict, trees=None, calibration=None, flat: float = 0.5):
        self.lexicon, self.trees, self.calibration, self.flat = lexicon, trees, calibration, flat

    def raw(self, rows: DataFrame) -> DataFrame:
        """Replace ``features`` by ``raw``."""
        vectors = rows.withColumn("_vector", array_to_vector("features")).drop("features")
        margin = vector_to_array("_margin")[1].alias("raw")
        return self.trees.transform(vectors).select(*[c for c in rows.columns if c != "features"], margin)

    def score(self, rows: DataFrame) -> DataFrame:
        """Replace ``features`` by ``score``."""
        if self.trees is None:
            return rows.drop("features").withColumn("score", F.lit(self.flat))
        return self.calibration.applied(self.raw(rows), "raw", "score")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows for which ``learn`` (over the columns of ``labels``) holds."""
    chosen = sample(labels, doc_id, label, learn, FIT_ROWS, "toxicity")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The sample has at most about FIT_ROWS short rows, so it may be sent to every task.
    rows = stored(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    counts = rows.agg(F.count(F.lit(1)).alias("every"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("toxic")).first()
    if not 0 < counts.toxic < counts.every:
        return Model({}, flat=0.5 * counts.toxic / max(1, counts.every))
    lexicon = learn_lexicon(rows)
    known = stored(measured(rows, lexicon, ["doc_id", "label"]), "toxicity-fit")
    calibrating = draw("doc_id", "toxicity-calibration") < 0.25
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH,
        stepSize=0.2, seed=1,
    )
    trees.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    fitted = trees.fit(
        known.filter(~calibrating).select(array_to_vector("features").alias("_vector"), "label").coalesce(8)
    )
    model = Model(lexicon, fitted)
    model.calibration = calibrate(model.raw(known.filter(calibrating)))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: toxic likelier) of every document."""
    return model.score(measured(docs, model.lexicon, keep, text))
