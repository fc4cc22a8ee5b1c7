"""Bounded samples of labelled rows, and isotonic calibration; shared by the classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder

_SPREAD = 1 << 30


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def draw(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(_SPREAD)) / _SPREAD


def sample(labels: DataFrame, doc_id: str, label: str, learn: Column, rows: int, seed: str) -> DataFrame:
    """(doc_id, label) of about ``rows`` of the labelled rows that may be learned from, fewer if there are fewer.

    A null id or label is no label; of several labels of one id the highest counts.
    """
    usable = (
        labels.filter(learn & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("double").alias("label"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    return usable.filter(draw("doc_id", seed) < share)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: made once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Calibration:
    """A non-decreasing map from raw scores to shares of positive labels, linear between its points."""

    at: tuple[float, ...]
    share: tuple[float, ...]
    #: Weight of the raw score's rank in the result, so that raw scores keep their order where the map is flat.
    slope: float = 1e-3
    #: The fitted Spark model with these points; none where there was nothing to fit.
    model: IsotonicRegressionModel | None = None

    def __reduce__(self):
        return Calibration, (self.at, self.share, self.slope)  # tasks need the points only

    def applied(self, rows: DataFrame, raw: str, out: str) -> DataFrame:
        """Replace the column ``raw`` by the calibrated ``out``, without leaving the JVM."""
        flat = F.lit(self.share[0])
        if self.model is not None:
            rows = self.model.setFeaturesCol(raw).setPredictionCol("_flat").transform(rows)
            flat = F.col("_flat")
        lifted = (1 - self.slope) * flat + self.slope / (1 + F.exp(-F.least(F.greatest(F.col(raw), F.lit(-30.0)), F.lit(30.0))))
        bounded = F.least(F.greatest(lifted, F.lit(0.0)), F.lit(1.0))
        return rows.withColumn(out, bounded).drop(raw, "_flat")

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        flat = np.interp(raw, self.at, self.share)
        return np.clip((1 - self.slope) * flat + self.slope / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)


def calibrate(scored: DataFrame, raw: str = "raw", label: str = "label") -> Calibration:
    """Isotonic regression of the label on the raw score, over a bounded sample; 0.5 throughout without rows.

    One positive and one negative row are added at the ends, so that no score is more certain than the sample.
    """
    rows = scored.select(F.col(label).cast("double").alias("label"), F.col(raw).cast("double").alias("raw"))
    ends = rows.agg(F.min("raw").alias("low"), F.max("raw").alias("high")).first()
    if ends.low is None:
        return Calibration((0.0,), (0.5,))
    spark = rows.sparkSession
    added = spark.createDataFrame([(1.0, ends.low), (0.0, ends.high)], rows.schema)
    weighted = rows.unionByName(added).groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(weighted)
    return Calibration(tuple(model.boundaries.toArray().tolist()), tuple(model.predictions.toArray().tolist()), model=model)
