"""WARC archives as Spark text files: writing segmented records, and reassembling them.

Writing: each payload becomes an HTTP response in chunked transfer framing. A block longer than ``segment_bytes``
is cut; its first segment is the ``response`` record with ``WARC-Segment-Number: 1``, the others are
``continuation`` records that name their origin, the last with the total length. Of records with equal payloads
of at least ``revisit_bytes`` bytes, those with the smallest id are responses and the others revisits.

Reading: files are split at the version line, so Spark reads large archives in parallel. Chunks are cut so that no
block holds that line, and a url or id that ends in it is escaped (``Mark-Escaped``). Continuations are grouped by origin and ordered by segment number; the total length,
the chunk framing and the payload digest are verified. Records that are whole in one segment are not shuffled.

Defined results: a null payload is empty. A null id or url is archived as an absent field and comes back null. Rows
that repeat an id, url and payload share one record id: their segments are stored once per row and reassembled
once, and ``copies`` counts them; ``read`` gives one row per copy. Where an id is null among equal payloads it is
a revisit of the smallest id, and if all are null all are responses. Faulty records keep a row with a ``status``
other than ``ok`` and a null payload. An empty table gives an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import pass_through, texts
from ledgerloom.session import shared_folder

VERSION = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
SEGMENT_BYTES = 32 << 10
REVISIT_BYTES = 100
#: Payload bytes in one HTTP chunk.
CHUNK_BYTES = 8 << 10
#: Parts of a join to which the rows of one key are dealt.
SALTS = 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    """Chunked framing; a chunk also ends inside every version mark, so that the framed bytes hold none."""
    line = VERSION.strip().encode()
    out = []
    start = 0
    while start < len(payload):
        end = min(start + CHUNK_BYTES, len(payload))
        at = payload.find(line, start, end + len(line) - 1)
        if at >= 0:
            end = min(end, at + 4)
        out.append(b"%x\r\n%b\r\n" % (end - start, payload[start:end]))
        start = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None where the head or the framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(chunk)
        at = end + 4 + size


def _record_id(*parts: Column) -> Column:
    name = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    pieces = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _fields(values: dict[str, Column]) -> Column:
    """Header lines of the fields that are not null."""
    lines = [F.concat(F.lit(f"{name}: "), v.cast("string"), F.lit("\r\n")) for name, v in values.items()]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def _unmarked(value: Column) -> Column:
    """A value that does not end in the version mark: its last digit is percent-encoded."""
    return F.regexp_replace(value.cast("string"), r"WARC/1\.1\z", "WARC/1.%31")


def write(
    pages: DataFrame,
    path: str,
    record: str,
    url: str,
    payload: str,
    segment_bytes: int = SEGMENT_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write an archive folder; each task writes one file of records. The payload column is string or binary."""
    rows = pages.select(
        F.col(record).alias("id"),
        F.regexp_replace(F.col(url).cast("string"), "[\r\n]", " ").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("payload_bytes"))
    typed = _with_firsts(rows, revisit_bytes)

    def cut(batch: pa.RecordBatch) -> dict:
        revisits = batch.column(batch.schema.get_field_index("later")).to_pylist()
        out = []
        for body, later in zip(texts(batch, "payload"), revisits, strict=True):
            block = b"" if later else HTTP_HEAD + chunked(body)
            out.append([block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)] or [b""])
        return {"segments": out}

    segments = T.StructType([T.StructField("segments", T.ArrayType(T.BinaryType()))])
    framed = pass_through(typed, segments, cut, drop=("payload",))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    each = framed.select(
        "*", F.size("segments").alias("n"), total.alias("total"), F.posexplode("segments").alias("at", "block")
    )
    key = [F.col("id"), F.col("url"), F.col("digest")]
    number = F.when(F.col("n") > 1, F.col("at") + 1)
    head = F.col("at") == 0
    ends = {n: F.col(n).cast("string").endswith(VERSION.strip()) for n in ("id", "url")}
    escaped = F.concat_ws(" ", *[F.when(e, F.lit(n)) for n, e in ends.items()])
    fields = {
        "WARC-Type": F.when(~head, "continuation").when(F.col("later"), "revisit").otherwise("response"),
        "WARC-Record-ID": F.when(head, _record_id(*key)).otherwise(_record_id(*key, F.col("at") + 1)),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": _unmarked(F.col("url")),
        "Page-ID": F.when(head, _unmarked(F.col("id"))),
        "Mark-Escaped": F.when(escaped != "", escaped),
        "WARC-Payload-Digest": F.when(head, F.concat(F.lit("sha256:"), "digest")),
        "WARC-Refers-To": F.when(
            head & F.col("later"), _record_id(F.col("first.id"), F.col("first.url"), F.col("digest"))
        ),
        "WARC-Segment-Number": number,
        "WARC-Segment-Origin-ID": F.when(~head, _record_id(*key)),
        "WARC-Segment-Total-Length": F.when(~head & (F.col("at") == F.col("n") - 1), F.col("total")),
        "Content-Type": F.when(head & ~F.col("later"), "application/http; msgtype=response"),
        "Content-Length": F.octet_length("block"),
    }
    text = F.concat(F.lit(VERSION), _fields(fields), F.lit("\r\n"))
    records = each.select(F.concat(text.cast("binary"), "block").cast("string").alias("value"))
    records.write.option("lineSep", BREAK).text(path)


def _with_firsts(rows: DataFrame, revisit_bytes: int) -> DataFrame:
    """Add ``first`` (id and url of the response among equal payloads held more than once) and ``later``.

    The repeated digests are written first, so that Spark knows their size and sends payloads through a shuffle
    only where they are too many to send along; the join is salted, so a payload that many pages share is dealt
    out.
    """
    repeated = (
        rows.filter(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"),
            F.count(F.lit(1)).alias("held"),
        )
        .filter("held > 1 AND first IS NOT NULL")
        .drop("held")
    )
    path = shared_folder(rows.sparkSession, "warc-repeated")
    repeated.write.parquet(path)
    known = rows.sparkSession.read.schema(repeated.schema).parquet(path)
    joined = salted_left(rows, known, "digest", F.xxhash64("id", "url"))
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first.id")))
    return joined.withColumn("later", F.coalesce(later, F.lit(False)))


def salted_left(left: DataFrame, right: DataFrame, key: str, dealt_by: Column) -> DataFrame:
    """Left join on ``key``, unique in ``right``; the rows of one key are dealt to ``SALTS`` parts of the join."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.withColumn("_salt", F.pmod(dealt_by, F.lit(SALTS)).cast("int")).join(
        right.withColumn("_salt", salts), [key, "_salt"], "left"
    ).drop("_salt")


_HEADER = {
    "type": "warc-type",
    "record_id": "warc-record-id",
    "id": "page-id",
    "url": "warc-target-uri",
    "digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "segment": "warc-segment-number",
    "origin": "warc-segment-origin-id",
    "total": "warc-segment-total-length",
}
RECORD = T.StructType(
    [T.StructField(n, T.LongType() if n in ("segment", "total") else T.StringType()) for n in _HEADER]
    + [T.StructField("block", T.BinaryType()), T.StructField("whole", T.BooleanType())]
)


def parse(record: bytes) -> dict:
    """Header fields, block, and whether the block has the length that the header states."""
    head, found, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    out: dict = {n: fields.get(f) for n, f in _HEADER.items()}
    for n in fields.get("mark-escaped", "").split():
        if n in ("id", "url") and (out[n] or "").endswith("%31"):
            out[n] = out[n].removesuffix("%31") + "1"
    for n in ("segment", "total"):
        out[n] = int(out[n]) if (out[n] or "").isdecimal() else None
    stated = fields.get("content-length", "")
    length = int(stated) if stated.isdecimal() else -1
    out["whole"] = bool(found) and 0 <= length and rest[length:] == BREAK.encode()
    out["block"] = rest[:length] if out["whole"] else None
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record (columns of ``RECORD``), continuations included."""
    lines = spark.read.option("lineSep", VERSION).text(path).filter("value <> ''")

    def work(batch: pa.RecordBatch) -> dict:
        found = [parse(x) for x in texts(batch, "value")]
        return {n: [f[n] for f in found] for n in RECORD.names}

    return pass_through(lines.select(F.col("value").cast("binary").alias("value")), RECORD, work, drop=("value",))


PAYLOAD = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("status", T.StringType())])


def _judged(rows: DataFrame) -> DataFrame:
    """Decode ``blocks`` (in order; null where segments are missing or broken) and verify the payload digest."""

    def work(batch: pa.RecordBatch) -> dict:
        found = batch.select(["blocks", "fault"]).to_pydict()
        payloads, status = [], []
        for blocks, fault in zip(found["blocks"], found["fault"], strict=True):
            payload = None if fault else unchunked(b"".join(blocks))
            payloads.append(payload)
            status.append(fault or ("BAD_FRAMING" if payload is None else "ok"))
        return {"payload": payloads, "status": status}

    done = pass_through(rows, PAYLOAD, work, drop=("blocks", "fault"))
    actual = F.sha2("payload", 256)
    stated = F.substring_index("digest", ":", -1)
    wrong = (F.col("status") == "ok") & F.col("digest").startswith("sha256:") & (actual != stated)
    return done.select(
        "record_id",
        "id",
        "url",
        "copies",
        F.when(~F.coalesce(wrong, F.lit(False)), F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        actual.alias("payload_digest"),
        F.when(wrong, "BAD_DIGEST").otherwise(F.col("status")).alias("status"),
    )


def reassemble(records: DataFrame) -> DataFrame:
    """The responses: record_id, id, url, copies, payload, payload_bytes, payload_digest and status."""
    responses = records.filter("type = 'response'")
    fault = F.when(~F.col("whole"), "BAD_LENGTH")
    alone = responses.filter("segment IS NULL").select(
        "record_id", "id", "url", "digest", F.lit(1).cast("long").alias("copies"),
        F.array("block").alias("blocks"), fault.alias("fault"),
    )
    parts = records.filter("segment IS NOT NULL AND type IN ('response', 'continuation')").select(
        F.coalesce("origin", "record_id").alias("record_id"), "id", "url", "digest", "type", "segment", "block", "total",
    )
    grouped = parts.groupBy("record_id").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("id").alias("id"),
        F.max(F.when(F.col("type") == "response", F.col("url"))).alias("url"),
        F.max("digest").alias("digest"),
        F.sum(F.when(F.col("type") == "response", 1).otherwise(0)).alias("copies"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    numbered = F.forall(F.transform("parts", lambda x, i: x["segment"] == i + 1), lambda right: right)
    broken = F.exists("parts", lambda x: x["block"].isNull())
    segmented = grouped.select(
        "record_id", "id", "url", "digest", F.greatest("copies", F.lit(1)).cast("long").alias("copies"),
        F.transform("parts", lambda x: x["block"]).alias("blocks"),
        F.when(broken, "BAD_LENGTH")
        .when((F.col("copies") == 0) | ~numbered | F.col("total").isNull(), "MISSING_SEGMENT")
        .when(length != F.col("total"), "BAD_TOTAL_LENGTH")
        .alias("fault"),
    )
    return _judged(alone.unionByName(segmented))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: id, url, record_type, payload_bytes, payload_digest, refers_to and status.

    Revisits take length and digest from the response they refer to; one that refers to none is ``DANGLING``.
    """
    records = read_records(spark, path)
    responses = reassemble(records).drop("payload")
    folder = shared_folder(spark, "warc-responses")
    responses.write.parquet(folder)
    stored = spark.read.schema(responses.schema).parquet(folder)
    facts = ["payload_bytes", "payload_digest", "status"]
    targets = stored.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.first("id").alias("_id"), *[F.first(f).alias(f) for f in facts]
    )
    revisits = records.filter("type = 'revisit'").select("id", "url", "refers_to")
    resolved = salted_left(revisits, targets, "refers_to", F.xxhash64("id", "url")).select(
        "id", "url", F.lit("revisit").alias("record_type"), F.col("_id").alias("refers_to"),
        "payload_bytes", "payload_digest", F.coalesce("status", F.lit("DANGLING")).alias("status"),
    )
    copies = stored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    firsts = copies.select(
        "id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), *facts
    )
    return firsts.unionByName(resolved)
