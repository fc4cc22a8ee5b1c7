"""Reading record corpora and normalising them into records, cells and turns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import number_rows
from ledgerloom.sources.objects import elements

RECORD_FIELDS = (
    "id STRING, "
    "doc STRUCT<pre_text: STRING, post_text: STRING, table: MAP<STRING, MAP<STRING, STRING>>>, "
    "dialogue STRUCT<conv_questions: ARRAY<STRING>, conv_answers: ARRAY<STRING>, "
    "turn_program: ARRAY<STRING>, executed_answers: ARRAY<STRING>, qa_split: ARRAY<BOOLEAN>>, "
    "features MAP<STRING, STRING>"
)
LINE_SCHEMA = f"split STRING, rec_ord BIGINT, {RECORD_FIELDS}"
_COLUMN_SPAN = 1 << 32


class CorpusError(Exception):
    """The corpus cannot be read or lacks what it must have."""


class Corpus(NamedTuple):
    records: DataFrame
    cells: DataFrame
    turns: DataFrame


def read_corpus(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Records of a corpus: split, rec_ord, id, doc, dialogue, features.

    ``object``: one JSON object with ``train`` and ``dev``, read by as many tasks as the file has ranges. ``lines`` (one
    JSON record per line) and ``parquet`` have ``split`` and ``rec_ord``.
    """
    try:
        if layout == "object":
            return _from_object(elements(spark, path), path)
        if layout == "lines":
            return spark.read.schema(LINE_SCHEMA).option("mode", "FAILFAST").json(path)
        if layout == "parquet":
            return spark.read.parquet(path)
    except AnalysisException as error:
        raise CorpusError(f"cannot read corpus {path}: {error}") from error
    raise CorpusError(f"unknown corpus layout: {layout}")


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records from a column of JSON texts, one record each; malformed text fails the job."""
    parsed = F.from_json(column, LINE_SCHEMA, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("_record")).select("_record.*")


def _is_incomplete(record: Column) -> Column:
    """Whether a record lacks a required part; only ``features`` may be missing."""
    required = ["id", "doc.pre_text", "doc.post_text", "doc.table"] + [
        f"dialogue.{name}"
        for name in ("conv_questions", "conv_answers", "turn_program", "executed_answers", "qa_split")
    ]
    missing = F.lit(False)
    for path in required:
        part = record
        for name in path.split("."):
            part = part[name]
        missing = missing | part.isNull()
    return missing


def malformed_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no complete record, one issue row each; for auditing before ``parse_records``."""
    parsed = F.from_json(
        column, f"{LINE_SCHEMA}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    )
    read = lines.select(parsed.alias("_record"))
    broken = F.col("_record._broken").isNotNull() | _is_incomplete(F.col("_record"))
    return read.filter(broken).select(
        F.col("_record.rec_ord").alias("rec_ord"),
        F.col("_record.id").alias("record_id"),
        F.lit("VALIDATION_FAILED").alias("issue"),
        F.col("_record._broken").alias("detail"),
    )


def _from_object(found: DataFrame, path: str) -> DataFrame:
    """Records of the elements of one object; its form is checked first, and each record as it is parsed."""
    first = {k: F.min(F.when(F.array_contains("keys", k), F.col("number"))).alias(k) for k in ("train", "dev")}
    last = F.max_by(F.struct("tail", "depth", "text"), "number").alias("last")
    record = F.from_json("text", RECORD_FIELDS, {"mode": "PERMISSIVE"})
    # Without its parts a record is incomplete, and so is a text that is no record.
    broken = F.count_if(F.col("text").isNotNull() & F.coalesce(_is_incomplete(record), F.lit(True))).alias("incomplete")
    check = found.agg(
        F.countDistinct("file").alias("files"), *first.values(), last, broken,
        F.count_if(F.col("text").isNotNull() & ~F.col("text").startswith("{")).alias("stray"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"),
        F.count("keys").alias("openings"), F.max("number").alias("elements"),
    ).first()
    if not check["files"]:
        raise CorpusError(f"corpus {path} is empty")
    if check["files"] > 1:
        raise CorpusError(f"corpus {path} is not one JSON object")
    tail, depth = check["last"]["tail"], check["last"]["depth"]
    ended = tail is not None and (depth == 0 or (depth == -1 and tail.rstrip().endswith("}")))
    if not ended or check["stray"] or tail.rstrip(" \t\r\n}").strip("] ,\t\r\n"):
        raise CorpusError(f"corpus {path} is not valid JSON of the expected shape")
    missing = [k for k in ("train", "dev") if check[k] is None]
    if missing:
        raise CorpusError(f"corpus {path} lacks required keys: {missing}")
    if check["keys"] != ["dev", "train"]:
        raise CorpusError(f"corpus {path} has arrays beside train and dev: {check['keys']}")
    if check["incomplete"]:
        raise CorpusError(f"corpus {path} holds records without their required parts")
    # An array that begins at the same element as another is empty if it is named before it, or nothing follows.
    train, dev, count = check["train"], check["dev"], check["elements"]
    at = F.col("number")
    if train == dev:
        order = found.filter(at == train).select("keys").first()["keys"]
        empty = order[0]
        in_dev = F.lit(empty == "train")
        train_size = 0 if empty == "train" else count
    else:
        in_dev = (at >= dev) if train < dev else (at < train)
        train_size = dev if train < dev else count - train
    position = F.when(in_dev, at - (dev if dev > train else 0) + train_size).otherwise(at - (train if train > dev else 0))
    parsed = F.from_json("text", RECORD_FIELDS, {"mode": "FAILFAST"})
    return found.filter("text IS NOT NULL").select(
        F.when(in_dev, "dev").otherwise("train").alias("split"), position.cast("bigint").alias("rec_ord"), parsed.alias("_record")
    ).select("split", "rec_ord", "_record.*")


def normalize(corpus: DataFrame) -> Corpus:
    """Records, cells and turns of a corpus.

    Column order is the order in the file. Row order is the order in which labels first appear, column by
    column.
    """
    return Corpus(normalize_records(corpus), normalize_cells(corpus), normalize_turns(corpus))


def normalize_records(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "split",
        "rec_ord",
        F.col("id").alias("record_id"),
        F.col("doc.pre_text").alias("pre_text"),
        F.col("doc.post_text").alias("post_text"),
        "features",
    )


def normalize_cells(corpus: DataFrame) -> DataFrame:
    """One row per value; row labels are numbered as they first appear, column by column."""
    columns = F.map_entries("doc.table")
    first = F.get(F.flatten(F.transform(columns, lambda c: F.map_keys(c["value"]))), F.lit(0))
    # A column without any value keeps its place through one empty cell.
    empty = F.create_map("_first", F.lit(None).cast("string"))
    values = F.when(F.size("_column.value") > 0, F.col("_column.value")).otherwise(empty)
    base = ["split", "rec_ord", "record_id", "col_ord", "col_name"]
    cells = (
        corpus.select("split", "rec_ord", F.col("id").alias("record_id"), columns.alias("_columns"), first.alias("_first"))
        .filter(F.col("_first").isNotNull())
        .select("split", "rec_ord", "record_id", "_first", F.posexplode("_columns").alias("col_ord", "_column"))
        .select("split", "rec_ord", "record_id", "col_ord", F.col("_column.key").alias("col_name"), values.alias("_values"))
        .select(*base, F.posexplode("_values").alias("_pos", "row_name", "raw"))
    )
    key = ["rec_ord", "record_id"]
    seen = cells.groupBy(*key, "row_name").agg(
        F.min(F.col("col_ord").cast("long") * _COLUMN_SPAN + F.col("_pos")).alias("_seen")
    )
    order = number_rows(seen, key, "_seen", "_number").select(
        *key, "row_name", (F.col("_number") - 1).cast("int").alias("row_ord")
    )
    return cells.join(order, [*key, "row_name"]).select(*base, "row_ord", "row_name", "raw")


def normalize_turns(corpus: DataFrame) -> DataFrame:
    """One row per question that has an answer, numbered from 1; other lists may be shorter."""
    lists = corpus.select(
        "split",
        "rec_ord",
        F.col("id").alias("record_id"),
        F.coalesce(F.lower(F.try_element_at("features", F.lit("has_type2_question"))) == "true", F.lit(False))
        .alias("is_hybrid"),
        F.col("dialogue.conv_questions").alias("question"),
        F.col("dialogue.conv_answers").alias("answer"),
        F.col("dialogue.turn_program").alias("program"),
        F.col("dialogue.executed_answers").alias("executed_answer"),
        F.col("dialogue.qa_split").alias("qa_split"),
    ).withColumn("_turns", F.least(F.size("question"), F.size("answer")))
    zipped = lists.select(
        "split", "rec_ord", "record_id", "is_hybrid", "_turns",
        F.posexplode(F.arrays_zip("question", "answer", "program", "executed_answer", "qa_split"))
        .alias("_pos", "_turn"),
    ).filter("_pos < _turns")
    return zipped.select(
        "split", "rec_ord", "record_id", (F.col("_pos") + 1).alias("turn"), "_turn.*", "is_hybrid"
    )
