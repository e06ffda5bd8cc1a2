import gzip
import uuid

import pytest

from cytoloom.llm import warc

ROWS = [(1, "http://a/", "x" * 1200), (2, None, "x" * 1200), (2, None, "x" * 1200), (3, "http://b c", None), (4, "http://d", ""), (5, "u", "small"), (6, "u", "small"), (7, "v", "é" * 900), (None, "w", "x" * 1200)]


def convert(spark, rows, tmp_path, file_bytes=2000):
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_arcs(df, f"{folder}/arc", file_bytes=file_bytes)
    warc.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc")
    return warc.with_referents(warc.read_warcs(spark, f"{folder}/warc"))


def test_round_trip_with_nulls_and_copies(spark, tmp_path):
    rows = convert(spark, ROWS, tmp_path).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"]) for r in rows) == sorted((i or 0, len((h or "").encode())) for i, _, h in ROWS)
    large = [r for r in rows if r["payload_bytes"] == 1200]
    assert sum(r["record_type"] == "response" for r in large) == 1 and len(large) == 4
    assert {r["refers_to"] for r in large if r["record_type"] == "revisit"} == {2}
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in rows if r["payload_bytes"] < 1000)


def test_no_pages(spark, tmp_path):
    assert convert(spark, [], tmp_path).count() == 0


def test_records_without_length_and_blocks_that_are_not_http(spark, tmp_path):
    """Copies of an HTTP message that states no length or a wrong one, and of a block that is no HTTP message."""
    folder = f"{tmp_path}/arc"
    bodies = [b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"y" * 2000] * 2
    bodies += [b"HTTP/1.0 200 OK\r\nContent-Length: 7\r\nX-Page-Id: none\r\n\r\n" + b"z" * 1500] * 2 + [b"plain block " * 200] * 2
    data = warc.arc_start("f.arc", 1, "20260102030405")
    for k, block in enumerate(bodies):
        data += warc.arc_line({"URL": f"http://x/{k}", "IP-address": "1.2.3.4", "Archive-date": "20260102030405", "Content-type": "text/html"}, 1, block) + block + b"\n"
    warc.write_file(f"file://{folder}", "f.arc.gz", gzip.compress(data))
    warc.arc_to_warc(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    rows = warc.with_referents(warc.read_warcs(spark, f"file://{tmp_path}/warc")).collect()
    assert sorted(r["payload_bytes"] for r in rows) == [1500, 1500, 2000, 2000, 2400, 2400]
    assert sorted(r["record_type"] for r in rows) == ["resource", "response", "response", "revisit", "revisit", "revisit"]
    ids = {r["record_id"] for r in rows if r["record_type"] != "revisit"}
    assert all(r["refers_to_id"] in ids for r in rows if r["record_type"] == "revisit")


def test_members_and_plain_files():
    data = b"".join(warc.packed(bytes([65 + k]) * 1000) for k in range(50))
    assert warc.unpacked(data) == gzip.decompress(data) and warc.unpacked(b"plain") == b"plain"


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(version):
    block = warc.http_block(9, b"body")
    data = warc.arc_start("f.arc", version, "20260102030405") + warc.arc_line({"URL": "http://x", "IP-address": "1.2.3.4", "Archive-date": "20260102030405", "Content-type": "text/html"}, version, block) + block + b"\n"
    ((place, fields, found),) = warc.parse_arc(data)
    assert found == block and fields["URL"] == "http://x" and len(fields) == len(warc.ARC_FIELDS[version])
    record = warc.warc_record("f.arc", place, fields, found, None)
    ((headers, body),) = warc.parse_warc(record)
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2026-01-02T03:04:05Z" and body == block
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(data.replace(b"http://x 1.2.3.4", b"http://x")))
