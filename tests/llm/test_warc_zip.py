import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlake.llm import warc_zip as W
from feedlake.llm.registry import op3_warc_zip


def brute(rows, smallest=0):
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == body]
        best = max(same, key=lambda p: (p is not None, p or 0))
        response = page_id == best or len(body) < smallest
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else best))
    return sorted(out, key=repr)


def digests(records):
    found = records.select(W.page_id_of(F.col("record_id")).alias("p"), "payload_bytes", "payload_digest", "record_type", W.page_id_of(F.col("refers_to")).alias("r"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


ROWS = [
    (1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "only"), (5, "", "x" * 2_000_000),
    (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "x" * 2_000_000), (-8, "u", "only"), (9, "u", "a\x00b"),
]


@pytest.mark.parametrize("smallest,package_bytes", [(0, W.PACKAGE_BYTES), (5, 300)])
def test_odd_rows(spark, smallest, package_bytes):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, path string")
    assert digests(W.round_trip(df, smallest, package_bytes)) == brute([(r[0], r[2]) for r in ROWS], smallest)


def test_repeated_rows_have_one_response(spark):
    df = spark.createDataFrame([(4, "u", "same")] * 30, "page_id bigint, url string, html string")
    rows = W.round_trip(df).collect()
    assert [sum(r.record_type == k for r in rows) for k in ("response", "revisit")] == [1, 29]


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_payloads_come_back(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    got = W.read_packages(spark, W.write_packages(df, W.new_path(spark, "warc-test"))).where("record_type = 'response'").collect()
    assert sorted({bytes(r.payload) for r in got}) == sorted({(r[2] or "").encode() for r in ROWS})


def package(wide, index, monkeypatch, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = b"PK\x05\x06 in a comment"
        packed = [W.gzip.compress(W.record(f"urn:page:{i}", "response", None, b"%d" % i * 50, None)) for i in range(40)]
        z.writestr("archive/é.warc.gz", b"".join(packed))
        if index:
            at = 0
            lines = []
            for i, p in enumerate(packed):
                lines.append('k 2024 {"offset": "%d", "length": %d, "filename": "é.warc.gz"}\n' % (at, len(p)))
                at += len(p)
            z.writestr("indexes/index.cdxj", "".join(lines))
    return pa.BufferReader(out.getvalue()), out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("index", [False, True])
def test_directories_and_ranges(wide, index, monkeypatch):
    f, data = package(wide, index, monkeypatch)
    assert (b"PK\x06\x06" in data) == wide
    ranges = sorted(W.indexed_ranges(f, W.directory(f)))
    assert [W.parsed(W.gzip.decompress(data[a : a + n]))["payload"] for a, n in ranges] == [b"%d" % i * 50 for i in range(40)]


def test_what_cannot_be_read_is_said(monkeypatch):
    f, _ = package(False, True, monkeypatch, zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(W.indexed_ranges(f, W.directory(f)))
    with pytest.raises(ValueError, match="end record"):
        W.directory(pa.BufferReader(b"no package"))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op3_warc_zip(spark, sf).collect()), key=repr) == brute(rows)
