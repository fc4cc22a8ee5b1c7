"""Held-out accuracy of the two classifiers, word hashes, and defined results on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import qualityscore, queries, toxicity
from ledgerloom.llm.labelled import Calibration, calibrate, fold
from ledgerloom.llm.batches import slices
from ledgerloom.llm.words import Words, hash_of, lower_latin, per_text, per_word

ODD = [(1, ""), (2, None), (3, " \n\t"), (4, "word " * 30_000), (5, "you idiot!!! " * 10), (None, "a b"), (5, "you idiot!!! " * 10)]


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def held_out_accuracy(spark, sf, query, label):
    scored = query(spark, sf)
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    joined = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity_held_out(spark, sf):
    assert held_out_accuracy(spark, sf, queries.op3_toxicity, "toxic") >= 0.93


def test_quality_held_out(spark, sf):
    assert held_out_accuracy(spark, sf, queries.op10_quality_score, "quality") >= 0.95


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "c", 0.5) for i, t in ODD], "doc_id long, text string, features string, score double")


def test_odd_rows_and_labels(spark, sf, odd):
    docs = odd
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 1), (1, 0, 1), (5, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    every = F.lit(True)
    model = toxicity.fit(docs, labels, every)
    scores = toxicity.score(docs.drop("score"), model, ["doc_id"]).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id == 5}) == 1
    graded = qualityscore.score(docs, labels, every).collect()
    assert len(graded) == len(ODD) and all(0 <= r.score <= 1 for r in graded)


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    every = F.lit(True)
    model = toxicity.fit(odd, none, every)
    assert {r.score for r in toxicity.score(odd.drop("score"), model, ["doc_id"]).collect()} == {0.0}
    assert {r.score for r in qualityscore.score(odd, none, every).collect()} == {0.5}
    assert toxicity.score(odd.limit(0).drop("score"), model, ["doc_id"]).count() == 0
    assert qualityscore.score(odd.limit(0), none, every).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(str(r.id).encode()) % 5 for r in rows]


def test_calibration_never_falls(spark):
    draw = np.random.default_rng(1)
    raw = draw.normal(size=500)
    label = (draw.random(500) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    fitted = calibrate(spark.createDataFrame([(float(a), float(b)) for a, b in zip(raw, label, strict=True)], "raw double, label double"))
    out = fitted(np.linspace(-4, 4, 200))
    assert (np.diff(out) >= 0).all() and 0 <= out[0] < 0.2 and 0.8 < out[-1] <= 1
    assert Calibration((0.0,), (0.5,))(np.array([-9.0, 9.0])).round(2).tolist() == [0.5, 0.5]


def test_words_and_hashes():
    texts = ["Ab cd", "", " x", "ÉÈ ab", "cd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    low = lower_latin(data)
    words = Words(low, offsets, data != 0x20)
    found = [bytes(low[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)]
    assert found == ["ab", "cd", "x", "éè", "ab", "cd"] and words.cuts.tolist() == [0, 2, 2, 3, 5, 6]
    assert words.hash.tolist() == [hash_of(w) for w in found]
    far = np.frombuffer(b"q" * 200_000 + b" ab", np.uint8)
    late = Words(far, np.array([0, len(far)]), far != 0x20)
    assert int(late.hash[1]) == hash_of("ab")


def test_sums_per_text_and_word():
    flags = np.array([1, 0, 1, 1, 0, 1], bool)
    assert per_text(flags, np.array([0, 0, 3, 3, 6, 6])).tolist() == [0, 2, 0, 2, 0]
    assert per_text(flags, np.array([0, 2])).tolist() == [1] and per_text(flags[:0], np.array([0, 0])).tolist() == [0]
    data = np.frombuffer(b"ab c de", np.uint8)
    words = Words(data, np.array([0, 4, 7]), data != 0x20)
    assert per_word(data == ord("e"), words).tolist() == [0, 0, 1] and per_word(data > 0x61, words).tolist() == [1, 1, 2]


def test_long_text_in_segments_and_little_memory():
    """A long text has the features that it has at once, and costs little more than its bytes."""
    import tracemalloc

    insults, you = (np.array([hash_of(w) for w in x], np.uint64) for x in (toxicity.INSULTS, toxicity.SECOND_PERSON))
    lexicon = {0: (np.sort(insults), np.linspace(1, 4, len(insults)))}
    data = np.frombuffer(("Are you an idiot? m0ron, YOU said; so gooood. " * 400_000).encode()[: 16 << 20], np.uint8)
    offsets = np.array([0, len(data)])
    tracemalloc.start()
    long = toxicity.features(data, offsets, lexicon, insults, you)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    part = data[: 2 << 20]
    cut = toxicity.features(part, np.array([0, len(part)]), lexicon, insults, you)
    twice = toxicity.features(np.concatenate([part, part[:7]]), np.array([0, len(part), len(part) + 7]), lexicon, insults, you)
    assert np.allclose(cut[0], twice[0], rtol=1e-12) and long.shape == (1, len(toxicity.FEATURES))


def test_slices_of_a_batch():
    import pyarrow as pa

    batch = pa.record_batch({"a": ["xx", None, "y" * 9, "", "zzz", "w"], "n": [0, 1, 2, 3, 4, 5]})
    parts = [x.column("n").to_pylist() for x in slices(batch, ("a",), most=4)]
    assert parts == [[0, 1], [2], [3, 4, 5]]
    assert [x.num_rows for x in slices(batch, ())] == [6]
