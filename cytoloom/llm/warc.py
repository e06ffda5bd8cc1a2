"""Legacy web archives to WARC: write ARC files, parse them by version, and convert their records.

An ARC file begins with a version block that names its version and the fields of its header lines; version 1 lines have five
fields, version 2 lines ten, and the last is the length of what follows. The converter reads lines and lengths by that version
and makes the equivalent WARC records: a name-based UUID, an ISO timestamp, the type by content, SHA-1 digests.
Of records with equal payloads of ``min_revisit`` bytes or more one is a response and the others are revisits of it.

Scale: archives are files of about ``file_bytes`` in the shared folder, each written by one task under a temporary name and then
renamed, so a task that runs again writes the same file again. Which record is the response comes from an aggregation of digests;
payloads are never shuffled. Decisions reach
a converting task by file name, and it reads the file from the shared folder.

Defined results
---------------
* Null bodies have an empty payload. Null addresses are written as ``-``; white space in addresses is percent-encoded.
* The response is the record with the largest number in the id header (absent ones are smallest), then the latest date, then the last place in the archives; so
  of repeated rows exactly one is the response.
* An empty table gives no archives and no records. Blocks that aren't HTTP messages are resources, and their copies revisit the
  resource; HTTP messages may lack a Content-Length or state a wrong one. A page number that isn't a number counts as absent.
* A header line without the fields of its version, or a length beyond the end of the file, raises ValueError with the place.
* Payloads are written and read whole, however long. Columns of pages beyond those that are read are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The fields of ARC header lines by version, and names of the WARC format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
#: A field of our own: a revisit has no payload, and its HTTP header may lack the length or state a wrong one.
PAYLOAD_BYTES = "WARC-X-Payload-Length"


def packed(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:
        return file.read()


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write under a temporary name in the shared folder, then rename; a later attempt replaces an earlier one."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")
    return name


def read_file(folder: str, name: str) -> bytes:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()


# ARC


def address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else "-"


def arc_start(name: str, version: int, date: str) -> bytes:
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 cytoloom\n{fields}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_line(values, version, body) + body + b"\n"


def arc_line(values: dict[str, str], version: int, body: bytes) -> bytes:
    values = {f: "-" for f in ARC_FIELDS[version]} | values | {"Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = f"{ID_HEADER}: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def write_arcs(pages: DataFrame, folder: str, date: str = "20260101000000", versions: tuple[int, ...] = (1, 2), file_bytes: int = 16 << 20) -> DataFrame:
    """(name, records): the ARC files written from rows of page_id, url and html; tasks take the versions in turn."""

    def run(batches):
        part, number, data, size, records = TaskContext.get().partitionId(), 0, [], 0, 0
        version = versions[part % len(versions)]
        name = lambda: f"part-{part:06d}-{number:06d}.arc.gz"
        done: list[tuple[str, int]] = []

        def close():
            nonlocal number, data, size, records
            if records:
                done.append((write_file(folder, name(), packed(arc_start(name(), version, date)) + b"".join(data)), records))
                number, data, size, records = number + 1, [], 0, 0

        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                block = http_block(page, (html or "").encode())
                values = {"URL": address(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Filename": name(), "Offset": str(size)}
                data.append(packed(arc_line(values, version, block) + block + b"\n"))
                size, records = size + len(block), records + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["name", "records"])

    return materialize(pages.select("page_id", "url", "html").mapInArrow(run, "name string, records long"))


def parse_arc(data: bytes):
    """(place, header fields, block) of each record after the version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split(" ")
        if not version:
            lines = data[end + 1 :].split(b"\n", 2) if end >= 0 else [b""]
            head = lines[0].split(b" ")[0]
            if not values[0].startswith("filedesc:") or head not in (b"1", b"2"):
                raise ValueError("no version block at the beginning of an ARC file")
            version = int(head)
        fields = ARC_FIELDS[version]
        # The version block's own line may be short, as files of version 2 often begin with a line of version 1.
        names = ARC_FIELDS[1] if at == 0 and len(values) == len(ARC_FIELDS[1]) else fields
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC {version} header line at byte {at}")
        record = dict(zip(names, values))
        start, length = end + 1, int(values[-1])
        if start + length > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        if at:
            yield at, record, data[start : start + length]
        at = start + length


# WARC


def payload_of(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(HTTP headers, the header part, payload); a block that isn't an HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    cut = block.find(b"\r\n\r\n")
    cut = len(block) if cut < 0 else cut + 4
    lines = block[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, block[:cut], block[cut:]


def page_number(http: dict[str, str]) -> int | None:
    page = http.get(ID_HEADER.lower(), "")
    return int(page) if re.fullmatch(r"-?\d{1,19}", page) else None


def digest_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, place: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{place}/{url}')}>"


def warc_record(name: str, place: int, arc: dict[str, str], block: bytes, original: dict | None) -> bytes:
    """The WARC record for an ARC record; original (id, url, date) makes it a revisit of that one."""
    _, head, payload = payload_of(block)
    http = bool(head)
    fields = {"WARC-Type": "response" if http else "resource", "WARC-Record-ID": record_id(name, place, arc["URL"]), "WARC-Date": iso_date(arc["Archive-date"])}
    fields |= {"WARC-Target-URI": arc["URL"], "WARC-IP-Address": arc["IP-address"], "WARC-Payload-Digest": digest_text(payload)}
    fields[PAYLOAD_BYTES] = str(len(payload))
    fields["Content-Type"] = "application/http; msgtype=response" if http else arc["Content-type"]
    if original:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original["record_id"]}
        fields |= {"WARC-Refers-To-Target-URI": original["url"], "WARC-Refers-To-Date": original["date"]}
        block = head
    fields |= {"WARC-Block-Digest": digest_text(block), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes):
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(headers["content-length"])
        if at > len(data):
            raise ValueError(f"the record at byte {end} is cut off")
        yield headers, data[start:at]
        at += 4


# Spark


def archives(spark, folder: str, pattern: str) -> DataFrame:
    """(name, content) of the files in a folder; none if nothing was written there."""
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "name string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


INDEX = "name string, place long, page_id long, record_id string, url string, date string, payload_bytes long, digest string"


def index_arcs(spark, folder: str) -> DataFrame:
    """One row per ARC record: where it is, its WARC id, its payload's length and digest."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, arc, block in parse_arc(unpacked(content)):
                    http, _, payload = payload_of(block)
                    page = page_number(http)
                    rows.append((name, place, page, record_id(name, place, arc["URL"]), arc["URL"], iso_date(arc["Archive-date"]), len(payload), digest_text(payload)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[x.split()[0] for x in INDEX.split(", ")])

    return archives(spark, folder, "*.arc.gz").mapInArrow(run, INDEX)


def arc_to_warc(spark, arc_folder: str, warc_folder: str, min_revisit: int = 1000, max_tasks: int = 20_000) -> DataFrame:
    """(name, records): the WARC files written, one for each ARC file in arc_folder."""
    index = materialize(index_arcs(spark, arc_folder))
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "date", "name", "place")
    large = index.where(F.col("payload_bytes") >= min_revisit)
    best = large.groupBy("digest").agg(F.max_by(F.struct("record_id", "url", "date"), rank).alias("original"), F.count("*").alias("copies"))
    revisits = large.join(best.where("copies > 1"), "digest").where(F.col("record_id") != F.col("original.record_id"))
    orders = revisits.groupBy("name").agg(F.collect_list(F.struct("place", "original.*")).alias("orders")).withColumnRenamed("name", "o_name")
    files = archives(spark, arc_folder, "*.arc.gz").select("name")
    files = files.join(orders, files["name"] == orders["o_name"], "left").select("name", "orders")
    # A row here stands for a whole file, which sizes in bytes don't tell: each file is a task of its own.
    files = files.repartition(max(1, min(max_tasks, files.count())), "name")

    def run(frames):
        for f in frames:
            done = []
            for name, own in zip(f["name"], f["orders"]):
                content = read_file(arc_folder, name)
                known = {x["place"]: x for x in (own if own is not None else ())}
                records = [packed(warc_record(name, place, arc, block, known.get(place))) for place, arc, block in parse_arc(unpacked(content))]
                start = "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                data = packed(start.format(record_id(name, 0, "warcinfo")).encode()) + b"".join(records)
                done.append((write_file(warc_folder, name.replace(".arc", ".warc"), data), len(records)))
            yield pd.DataFrame(done, columns=["name", "records"])

    return materialize(files.mapInPandas(run, "name string, records long"))


RECORDS = "record_id string, record_type string, target_uri string, warc_date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def read_warcs(spark, folder: str) -> DataFrame:
    """One row per response, resource or revisit. Length and digest are those of the full payload, which a revisit's headers tell."""

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                for headers, block in parse_warc(unpacked(content)):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = payload_of(block)
                    page = page_number(http)
                    if kind == "revisit":
                        size = headers.get(PAYLOAD_BYTES.lower()) or http.get("content-length")
                        size, digest = int(size) if size and size.isdigit() else None, base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers["warc-date"], page, size, digest, headers.get("warc-refers-to")))
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return archives(spark, folder, "*.warc.gz").mapInArrow(run, RECORDS)


def with_referents(records: DataFrame) -> DataFrame:
    """records with refers_to, the page_id of the record that each revisit refers to."""
    heads = records.where(F.col("record_type") != "revisit").select(F.col("record_id").alias("h_id"), F.col("page_id").alias("refers_to"))
    return records.join(heads, records["refers_to_id"] == heads["h_id"], "left").drop("h_id")
