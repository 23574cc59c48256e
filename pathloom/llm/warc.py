"""WARC archives: records are written in segments and read back whole.

A response record holds an HTTP message whose body is the payload in chunked transfer framing. A block over SEGMENT
bytes goes on in continuation records, which name the first record, their number and, the last one, the total length.
Reading groups the segments of a record, orders them by number, checks the total length and decodes the framing.
Each record is a gzip member of its own, so that readers can seek to it, and each file begins with a ``warcinfo`` record.
The text sink writes them: a member ends with its record's length in four bytes, the last of which is zero, as records
are far under 16 MB; that zero is the sink's line separator. The files' names end in ``.txt``, as the sink has it.
A record's id follows from its page, address and payload, so that revisits can name the response that they refer to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, new_path, saved, spread_join, table, utf8

#: Bytes of a record's block.
SEGMENT = 1 << 16
#: Bytes of a chunk of the transfer framing.
CHUNK = 1 << 13
#: Records of a file with its ``warcinfo``, so that a file is 64 MB at most before compression.
FILE_RECORDS = 1000
#: Records, or on reading files, that Python gets at a time.
BATCH_ROWS = 256
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 100

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def chunked(payload: bytes, size: int = CHUNK) -> Iterator[bytes]:
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        yield b"%x\r\n%s\r\n" % (len(part), part)
    yield b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        at = end + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        if not size:
            return b"".join(out) if at + 2 == len(body) else None
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    return None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record_id(*parts) -> str:
    """The id of the record with these properties."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(parts))}>"


_DATE = ("WARC-Date", "1970-01-01T00:00:00Z")


def info_record(instance: str) -> bytes:
    """The record at the start of a file."""
    fields = b"software: pathloom\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", instance)), _DATE, ("Content-Type", "application/warc-fields")], fields)


def page_records(page, url, payload: bytes, refers_to, refers_url, instance: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response in one or more segments, or a revisit of the page ``refers_to``.

    Rows alike in page, address and payload are records alike, under one id; ``instance`` keeps their segments apart.
    """
    uri, hashed = _uri(url), hashlib.sha256(payload).hexdigest()
    common = [("WARC-Target-URI", uri), _DATE, ("WARC-Payload-Digest", "sha256:" + hashed), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        origin = [("WARC-Refers-To", record_id("response", refers_to, _uri(refers_url), hashed)), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", _DATE[1])]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id("revisit", page, uri, hashed)), *common, ("WARC-Profile", profile), *origin], http)
        return
    name = record_id("response", page, uri, hashed)
    block = http + b"".join(chunked(payload))
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)
        return
    for number, i in enumerate(range(0, len(block), segment), 1):
        own = [("WARC-Segment-Number", number), ("X-Instance", instance)]
        if number == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *own], block[:segment])
            continue
        own += [("WARC-Record-ID", record_id("continuation", name, number)), ("WARC-Segment-Origin-ID", name), _DATE]
        own += [("WARC-Segment-Total-Length", len(block))] if i + segment >= len(block) else []
        yield record([("WARC-Type", "continuation"), *own], block[i : i + segment])


def member(data: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is zero."""
    packed = zlib.compress(data, 6, 31)
    if packed[-1]:
        raise ValueError(f"a record of {len(data)} bytes is too long for a file")
    return packed[:-1]


def _write(segment: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, made = TaskContext.get().partitionId(), 0, 0
        out, held = [], 0
        for batch in rows:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "refers_url"))
            for page, url, refers, of, payload in zip(*columns, utf8(batch.column("html"))):
                row += 1
                for x in page_records(page, url, payload or b"", refers, of, f"{part}.{row}", segment):
                    if made % FILE_RECORDS == 0:  # the sink begins a file here
                        out.append(member(info_record(f"{part}.{made}")))
                        made += 1
                    out.append(member(x))
                    made += 1
                    held += len(out[-1])
                    if held >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to, refers_url)`` of the pages whose payload has a smaller page, and that page's least url."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    keyed = keyed.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).drop("size")
    first = keyed.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("of"), F.max("page_id").alias("last")).where("of.page_id < last")
    first = first.select("digest", F.col("of.page_id").alias("refers_to"), F.col("of.url").alias("refers_url"))
    return keyed.select("page_id", "digest").join(first, "digest").where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write a record for each row of ``pages(page_id, url, html, ...)`` to WARC files in the folder ``path``."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    rows = pages.join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", "refers_url")
    records = rows.mapInArrow(_write(segment), "value binary").select(F.col("value").cast("string"))
    with arrow_rows(pages.sparkSession, BATCH_ROWS):
        records.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "page_id": "X-Page-ID", "refers_to": "WARC-Refers-To", "origin": "WARC-Segment-Origin-ID", "number": "WARC-Segment-Number", "total": "WARC-Segment-Total-Length", "instance": "X-Instance"}
_NUMBERS = ("page_id", "number", "total")
_RECORD = pa.schema([(n, pa.int64() if n in _NUMBERS else pa.string()) for n in _HEADERS] + [("block", pa.binary())])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file or of a part of one, uncompressed."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not ended at its length")
        yield headers, data[end + 4 : stop]
        at = stop + 4


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of a file's gzip members; a file that is not compressed is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("the last gzip member is cut off")
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(out)


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out) if out else [[]] * len(_RECORD), _RECORD)], schema=_RECORD)

    for batch in rows:
        for i in range(batch.num_rows):
            out, held = [], 0
            for part in members(batch.column("content")[i].as_py()):
                for headers, block in parse(part):
                    if headers["WARC-Type"] not in ("response", "revisit", "continuation"):
                        continue
                    values = (headers.get(h) for h in _HEADERS.values())
                    out.append((*(int(v) if v is not None and n in _NUMBERS else v for n, v in zip(_HEADERS, values)), block))
                    held += len(block)
                    if held >= 1 << 23:
                        yield made(out)
                        out, held = [], 0
            yield made(out)


def _payload(block: bytes | None, total: int | None) -> bytes | None:
    if block is None or total is not None and total != len(block):
        return None
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_WHOLE = ("record_type", "record_id", "target_uri", "page_id", "refers_to", "digest")
_READ = pa.schema([*(_RECORD.field(n) for n in _WHOLE), ("payload", pa.binary()), ("complete", pa.bool_())])


def _decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        payloads, complete = [], []
        for kind, parts, digest in zip(*(batch.column(c).to_pylist() for c in ("record_type", "parts", "digest"))):
            whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and (len(parts) == 1 or parts[-1]["total"] is not None)
            payload = _payload(b"".join(p["block"] for p in parts), parts[-1]["total"]) if whole else None
            payloads.append(payload if kind == "response" else None)
            good = payload is not None and (kind == "revisit" or digest in (None, "sha256:" + hashlib.sha256(payload).hexdigest()))
            complete.append(whole and (good or kind == "revisit"))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _WHOLE), pa.array(payloads, pa.binary()), pa.array(complete)], schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_type, record_id, target_uri, page_id, refers_to, digest, payload, complete)`` of each response and revisit.

    ``refers_to`` is a record's id. Files may be compressed, as a whole or record by record. Segments come back as one record. ``complete`` is false, and the payload null, where a segment or the total length
    is missing or wrong, the framing is broken or the payload has another digest; a continuation without its first
    record is left out. Revisits have no payload.
    """
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else str(f.type)}" for f in _RECORD)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_read, kinds)
    part = F.struct(F.coalesce("number", F.lit(1)).cast("long").alias("number"), "total", "block")
    single = records.where("number is null").withColumn("parts", F.array(part)).select(*_WHOLE, "parts")
    # Segments are grouped record by record, so that a group is as large as the row it makes.
    group = records.where("number is not null").groupBy(F.coalesce("origin", "record_id").alias("own_id"), "instance")
    first = [F.max(F.when(F.col("number") == 1, F.col(n))).alias(n) for n in _WHOLE]
    joined = group.agg(*first, F.array_sort(F.collect_list(part)).alias("parts")).where("record_id is not null").select(*_WHOLE, "parts")
    whole = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else str(f.type)}" for f in _READ)
    return single.unionByName(joined).mapInArrow(_decode, whole)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, complete)``.

    A revisit's ``refers_to`` is the page of the response that its record names, and its length that response's.
    ``complete`` is false for damaged records, and for revisits whose response is damaged, missing or another payload's.
    """
    records = read_archives(spark, path)
    named = F.substring_index("digest", ":", -1)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(named)
    columns = ("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "complete")
    with arrow_rows(spark, BATCH_ROWS):
        index = saved(records.select(*columns), "warc-index")
    full = index.where("record_type = 'response'")
    of = full.where("complete").select(F.col("record_id").alias("of"), F.col("page_id").alias("of_page"), "payload_bytes", F.col("payload_digest").alias("of_digest"))
    again = index.where("record_type = 'revisit'").drop("payload_bytes").withColumnRenamed("refers_to", "of")
    again = spread_join(again, of.dropDuplicates(["of"]), "of", "record_id", "left")
    good = F.col("complete") & F.coalesce(F.col("of_digest") == F.col("payload_digest"), F.lit(False))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    full = full.select(*columns, F.lit(None).cast("long").alias("refers_to"), "complete")
    return full.unionByName(again.select(*columns, F.col("of_page").alias("refers_to"), good.alias("complete")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; rows that repeat a page_id with one payload are alike; a null page_id is a response.

    A record that doesn't come back whole is an error.
    """
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    index = archive_index(spark, path)
    kind = F.when(F.col("complete"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("a damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return index.withColumn("record_type", kind.cast("string")).drop("complete")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": f"""
with p as (select page_id, sha256(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select d, min(page_id) as first from p where n >= {LEAST_REVISIT} group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when p.page_id > f.first then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= {LEAST_REVISIT}"""
}
