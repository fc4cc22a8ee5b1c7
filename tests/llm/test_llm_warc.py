"""Archives come back as they were written; broken ones are reported."""

import hashlib

import pytest

from ledgerloom.llm import warc
from ledgerloom.session import shared_folder

PAGES = [
    (1, "http://a/1", b"<p>" + b"x" * 5000 + b"</p>"),
    (2, "http://a/2", b"<p>" + b"x" * 5000 + b"</p>"),
    (3, "http://a/3\r\nX: y", b"short"),
    (4, "http://a/4", b"short"),
    (5, None, None),
    (6, "http://a/6", bytes(range(256)) * 20 + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9 + b"WARC/1.1"),
    (None, "http://a/7", b"<p>" + b"x" * 5000 + b"</p>"),
    (8, "http://a/8", b"\r\n\r\n0\r\n\r\n" * 300),
    (9, "http://a/9", b"y" * 4000),
    (9, "http://a/9", b"y" * 4000),
    (10, "http://a/10", b"y" * 4000),
    (11, "http://a/11", b"z" * 99),
    (12, "http://a/12", b"z" * 99),
    (13, "http://a/13", "grüße 中文".encode() * 700),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, p, "c") for i, u, p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html binary, digest string")


@pytest.mark.parametrize("segment", [37, 1000, 1 << 20])
def test_round_trip(spark, pages, segment):
    path = shared_folder(spark, "warc-test")
    warc.write(pages, path, "page_id", "url", "html", segment_bytes=segment)
    records = warc.read_records(spark, path)
    assert records.filter("NOT whole").count() == 0
    if segment < 5000:
        assert records.filter("type = 'continuation'").count() > 10
    whole = warc.reassemble(records).collect()
    assert {r.status for r in whole} == {"ok"}
    held = {bytes(p or b"") for _, _, p in PAGES}
    assert {bytes(r.payload) for r in whole} == held
    expected = []
    for i, _, body in PAGES:
        body = body or b""
        same = [j for j, _, b in PAGES if (b or b"") == body and j is not None]
        later = len(body) >= 100 and bool(same) and (i is None or i > min(same))
        expected.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", str(min(same)) if later else None))
    found = [(str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_empty_table(spark, pages):
    path = shared_folder(spark, "warc-test")
    warc.write(pages.limit(0), path, "page_id", "url", "html")
    assert warc.read(spark, path).count() == 0


def test_faults_are_reported(spark, pages):
    path = shared_folder(spark, "warc-test")
    warc.write(pages.filter("page_id IN (1, 6, 8)"), path, "page_id", "url", "html", segment_bytes=1000)
    records = warc.read_records(spark, path)
    status = lambda df: {r.id: r.status for r in warc.reassemble(df).collect()}
    assert status(records) == {"1": "ok", "6": "ok", "8": "ok"}
    assert status(records.filter("NOT (segment = 3)" " OR segment IS NULL"))["1"] == "MISSING_SEGMENT"
    last = records.filter("total IS NULL OR type = 'response'")
    assert set(status(last).values()) == {"MISSING_SEGMENT"}
    wrong = records.replace({records.filter("digest IS NOT NULL AND id = '8'").first().digest: "sha256:0"}, subset=["digest"])
    assert status(wrong)["8"] == "BAD_DIGEST"
    orphans = records.filter("type = 'continuation'")
    assert {r.status for r in warc.reassemble(orphans).collect()} == {"MISSING_SEGMENT"}
    assert warc.unchunked(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n") is None
    assert warc.unchunked(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab\r\n") is None
    assert warc.unchunked(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_dangling_revisit(spark, pages):
    path = shared_folder(spark, "warc-test")
    warc.write(pages.filter("page_id IN (9, 10)"), path, "page_id", "url", "html")
    text = spark.read.option("lineSep", warc.VERSION).text(path).filter("value LIKE 'WARC-Type: revisit%'")
    lone = shared_folder(spark, "warc-test")
    text.selectExpr("concat('WARC/1.1\r\n', trim(TRAILING '\r\n' FROM value)) AS value").write.option("lineSep", "\r\n\r\n\r\n\r\n").text(lone)
    assert [r.status for r in warc.read(spark, lone).collect()] == ["DANGLING"]


def test_url_or_id_that_ends_in_the_version_mark(spark):
    body = b"<p>" + b"q" * 3000
    rows = [("1", "http://a/WARC/1.1", body), ("2", "http://a/WARC/1.%31", b"other"), ("WARC/1.1", "http://b/WARC/1.1", body)]
    path = shared_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html binary"), path, "page_id", "url", "html", segment_bytes=1000)
    found = {(r.id, r.url, r.payload_bytes, r.status) for r in warc.read(spark, path).collect()}
    assert found == {(i, u, len(b), "ok") for i, u, b in rows}
