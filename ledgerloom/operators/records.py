"""Records: listing, lookup, duplicates, quality and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.containment import contained_in
from ledgerloom.operators.tables import axis_labels

def _split_order() -> Column:
    return F.when(F.col("split") == "train", 0).otherwise(1)


def list_records(records: DataFrame, split: str | None = None, limit: int | None = 10) -> DataFrame:
    """Record ids, train before dev, in file order; the first ``limit`` when one is given."""
    chosen = records.filter(F.col("split") == split) if split else records
    listed = chosen.select("split", "rec_ord", "record_id").orderBy(_split_order(), "rec_ord")
    return listed if limit is None else listed.limit(limit)


def listing_counts(records: DataFrame, limit: int = 10) -> DataFrame:
    """Per split and over both: how many records there are, and how many a listing leaves out."""
    counted = records.groupingSets([["split"], []], "split").agg(
        F.count(F.lit(1)).alias("total"), F.grouping("split").alias("_all")
    )
    return counted.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"),
        "total",
        F.greatest(F.col("total") - limit, F.lit(0)).alias("remaining"),
    )


def dedup_records(records: DataFrame, keep: str = "last") -> DataFrame:
    """One record per id: the last (cache rule) or the first (scan rule).

    Each task keeps its own best copy before the shuffle, so an id with very many copies never meets in one task.
    """
    pick = F.max_by if keep == "last" else F.min_by
    kept = records.groupBy("record_id").agg(pick(F.struct(*records.columns), "rec_ord").alias("_kept"))
    return kept.select("_kept.*")


def usable_records(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Records with an id and a table, last copy of each id: what lookups see."""
    with_table = cells.select("rec_ord").distinct()
    kept = records.filter(F.col("record_id") != "").join(with_table, "rec_ord", "left_semi")
    return dedup_records(kept.select(*records.columns), "last")


def lookup_records(requests: DataFrame, usable: DataFrame, similar: int = 5) -> DataFrame:
    """Answer ``(request_id, record_id)`` requests from usable records.

    Misses carry up to ``similar`` ids that contain the request, ignoring case, and the number of ids there
    are. Similar ids are found through shared substrings, never by comparing every miss with every id.
    """
    ids = usable.select("record_id", "split", "rec_ord")
    answered = requests.join(ids, "record_id", "left")
    missing = (
        answered.filter(F.col("rec_ord").isNull())
        .select(F.lower("record_id").alias("needle"))
        .distinct()
    )
    hay = usable.select(
        F.lower("record_id").alias("hay"),
        F.col("record_id").alias("similar_id"),
        _split_order().alias("_split_ord"),
        F.col("rec_ord").alias("_ord"),
    )
    rank = Window.partitionBy("needle").orderBy("_split_ord", "_ord")
    top = (
        contained_in(missing, hay)
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= similar)
        .groupBy("needle")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "similar_id"))).alias("_top"))
        .select("needle", F.transform("_top", lambda s: s["similar_id"]).alias("similar_records"))
    )
    available = ids.agg(F.count(F.lit(1))).scalar()
    return (
        # Every row has a needle, so the answered ones do not pile up under one null key.
        answered.withColumn("needle", F.lower("record_id"))
        .join(top, "needle", "left")
        .select(
            "request_id",
            "record_id",
            F.when(F.col("rec_ord").isNull(), "NOT_FOUND").otherwise("OK").alias("status"),
            "split",
            "rec_ord",
            F.when(F.col("rec_ord").isNull(), available).alias("available_count"),
            F.when(
                F.col("rec_ord").isNull(),
                F.coalesce("similar_records", F.array().cast("array<string>")),
            ).alias("similar_records"),
        )
    )


def quality_issues(records: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per problem: empty id, no table, a column named twice in one table."""
    blank = records.filter(F.coalesce("record_id", F.lit("")) == "").select(
        "rec_ord", "record_id", F.lit("EMPTY_ID").alias("issue"), F.lit(None).cast("string").alias("detail")
    )
    named = records.filter(F.col("record_id") != "")
    empty = named.join(cells.select("rec_ord").distinct(), "rec_ord", "left_anti").select(
        "rec_ord", "record_id", F.lit("NO_TABLE").alias("issue"), F.lit(None).cast("string").alias("detail")
    )
    doubled = (
        cells.select("rec_ord", "record_id", "col_ord", "col_name")
        .distinct()
        .groupBy("rec_ord", "record_id", "col_name")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(
            "rec_ord",
            "record_id",
            F.lit("DUPLICATE_COLUMN").alias("issue"),
            F.col("col_name").alias("detail"),
        )
    )
    return blank.unionByName(empty).unionByName(doubled)


def first_records(records: DataFrame, count: int | None) -> DataFrame:
    """The first ``count`` records, train before dev; all of them for None."""
    if count is None:
        return records
    return records.orderBy(_split_order(), "rec_ord").limit(count)


def corpus_counts(records: DataFrame) -> DataFrame:
    """Number of records in train, dev and both."""
    return records.agg(
        F.count_if(F.col("split") == "train").alias("train_records"),
        F.count_if(F.col("split") == "dev").alias("dev_records"),
        F.count(F.lit(1)).alias("total_records"),
    )


def column_type_histogram(
    records: DataFrame, schema: DataFrame, sample: int | None = None
) -> DataFrame:
    """How many columns of each type the first ``sample`` records have; None covers the whole corpus."""
    if sample is None:
        chosen = schema
    else:
        chosen = schema.join(first_records(records.select("split", "rec_ord"), sample), "rec_ord", "left_semi")
    return chosen.groupBy("column_type").agg(F.count(F.lit(1)).alias("columns"))


def table_shapes(records: DataFrame, cells: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows and columns of the tables of the first ``sample`` records that have one; None covers the whole corpus."""
    wanted = cells
    if sample is not None:
        chosen = first_records(records.select("split", "rec_ord"), sample)
        wanted = cells.join(chosen, "rec_ord", "left_semi")
    return (
        axis_labels(wanted)
        .groupBy("rec_ord", "record_id")
        .agg(
            F.count_if(F.col("axis") == "row").alias("row_count"),
            F.count_if(F.col("axis") == "col").alias("column_count"),
        )
    )
