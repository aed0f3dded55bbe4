"""Archives that others wrote: compressed members, all types of records, segments, what is broken."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from nestfold.llm import warc
from nestfold.llm.tables import texts


def record(kind, name, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": "2020-05-05T05:05:05Z", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"


def http(body, *fields):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two archives, one of gzip members, that no writer of this library made."""
    at = tmp_path_factory.mktemp("foreign")
    long = http(warc.chunked(b"0123456789" * 50, 64), b"Transfer-Encoding: chunked")
    parts = [long[:100], long[100:300], long[300:]]
    some = [
        record("warcinfo", "info", b"software: hand\r\n", Content_Type="application/warc-fields"),
        record("request", "ask", b"GET / HTTP/1.1\r\nHost: example.org\r\n\r\n", WARC_Target_URI="http://example.org/", Content_Type="application/http; msgtype=request"),
        record("response", "plain", http(b"<p>one</p>", b"Content-Type: text/html"), WARC_Target_URI="http://example.org/", Content_Type=HTTP),
        record("response", "packed", http(gzip.compress(b"two " * 40), b"content-encoding: GZIP"), Content_Type=HTTP),
        record("response", "deflated", http(zlib.compress(b"three"), b"Content-Encoding: deflate"), Content_Type=HTTP),
        record("resource", "file", b"\x00\xff\r\n\r\nWARC/1.0\r\n", Content_Type="image/x"),
        record("metadata", "note", b"", Content_Type="application/warc-fields"),
        record("response", "long", parts[0], WARC_Segment_Number=1, Content_Type=HTTP),
        record("continuation", "long3", parts[2], WARC_Segment_Origin_ID="<urn:uuid:long>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(long)),
        record("response", "holed", b"ab", WARC_Segment_Number=1),
        record("continuation", "holed3", b"ef", WARC_Segment_Origin_ID="<urn:uuid:holed>", WARC_Segment_Number=3, WARC_Segment_Total_Length=6),
        record("continuation", "lost2", b"ef", WARC_Segment_Origin_ID="<urn:uuid:lost>", WARC_Segment_Number=2, WARC_Segment_Total_Length=6),
        record("response", "chunks", http(b"5\r\nabc\r\n0\r\n\r\n", b"Transfer-Encoding: chunked"), Content_Type=HTTP),
    ]
    more = [record("continuation", "long2", parts[1], WARC_Segment_Origin_ID="<urn:uuid:long>", WARC_Segment_Number=2), record("revisit", "again", b"", WARC_Refers_To="<urn:uuid:plain>", WARC_Target_URI="http://example.org/\r\n  folded")]
    (at / "a.warc").write_bytes(b"".join(some))
    (at / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, more)) + bytes(7))
    return str(at)


def test_records_of_all_types(spark, folder):
    rows = {r["record_id"][10:-1]: r for r in warc.archive(spark, folder).collect()}
    assert len(rows) == 15 and {r["type"] for r in rows.values()} == {"warcinfo", "request", "response", "resource", "metadata", "continuation", "revisit"}
    assert rows["again"]["target_uri"] == "http://example.org/ folded" and rows["again"]["file"].endswith("b.warc.gz") and rows["again"]["place"] == 1
    assert rows["file"]["block"] == b"\x00\xff\r\n\r\nWARC/1.0\r\n" and rows["plain"]["headers"]["content-type"] == HTTP
    assert warc.read(spark, folder).count() == 0  # none names a page


def test_foreign_segments_are_put_together(spark, folder):
    found = {r["record_id"][10:-1]: r for r in warc.assembled(warc.archive(spark, folder)).collect()}
    assert {k: bytes(r["payload"]) for k, r in found.items() if r["problem"] is None} == {
        "info": b"software: hand\r\n", "ask": b"", "plain": b"<p>one</p>", "packed": b"two " * 40, "deflated": b"three", "file": b"\x00\xff\r\n\r\nWARC/1.0\r\n", "note": b"", "again": b"", "long": b"0123456789" * 50,
    }
    assert {k: r["problem"].split(":")[0] for k, r in found.items() if r["problem"]} == {"holed": "segments [1, 3] are there", "lost2": "continuations without their first record", "chunks": "broken framing"}


def test_own_and_foreign_archives_side_by_side(spark, folder, tmp_path):
    pages = spark.createDataFrame([(i, f"<b>{i}</b>" * 300) for i in range(30)] + [(99, None)], "page_id long, html string")
    path = str(tmp_path / "own")
    warc.write(warc.payloads(texts(pages, "page_id", "html")), path, segment=500, records_per_file=9)
    with open(f"{path}/foreign.warc.gz", "wb") as f, open(f"{folder}/b.warc.gz", "rb") as other:
        f.write(other.read())
    back = warc.reassembled(warc.read(spark, path, "*"))
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect()} == {r["page_id"]: r["html"] or "" for r in pages.collect()}
    whole = warc.assembled(warc.archive(spark, path)).where("headers['x-page-id'] IS NOT NULL")
    assert whole.where("problem IS NULL").count() == 31 and whole.agg(F.sum(F.octet_length("payload"))).first()[0] == sum(len(r["html"] or "") for r in pages.collect())


@pytest.mark.parametrize("broken", [b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", b"no archive", gzip.compress(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-9]])
def test_a_broken_archive_is_named(spark, tmp_path, broken):
    (tmp_path / "bad.warc").write_bytes(broken)
    with pytest.raises(Exception, match="bad.warc"):
        warc.archive(spark, str(tmp_path)).collect()
