"""WARC archives: writing with payload deduplication and segments, and reading back.

A payload longer than a segment is cut into one first record and continuations, which name the first
record (WARC-Segment-Origin-ID), their number, and at the end the total length. Records lie in any
order, in any archive of a folder. The reader groups continuations by origin, orders them by number,
verifies the total length, and only then decodes the chunked transfer framing of the HTTP message.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.llm.tables import small_batches
from nestfold.storage import written

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, for URLs
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD = "record_id string, type string, page_id long, refers_to long, origin string, number int, total long, digest string, declared long, block binary"


def record_id(page_id: int, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{number}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + END


def _line(url: str | None) -> str:
    """A url that does not end the header line that it is in."""
    return quote(url, safe="".join(chr(i) for i in range(33, 127))) if url else ""


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """The chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def records_of(page_id: int, payload: bytes, refers_to: int | None, segment: int, url: str | None = None) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it needs. Without a url, ``page:<id>`` stands for it."""
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url) or f"page:{page_id}"), ("X-Page-Id", page_id), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to)], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        kind = [("WARC-Type", "response"), ("WARC-Payload-Digest", digest)] if n == 1 else [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", record_id(page_id))]
        numbered = [("WARC-Segment-Number", n)] if len(parts) > 1 else []
        total = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) > 1 else []
        yield _record([*kind, ("WARC-Record-ID", record_id(page_id, n)), *common, *numbered, *total], part)


def members(data: bytes) -> Iterator[bytes]:
    """An archive's bytes without compression: each gzip member in turn, or all as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at == len(data):
                raise ValueError("a gzip member breaks off")
            piece = view[at : at + (1 << 16)]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)
        while at < len(data) and not data[at]:  # padding may follow a member
            at += 1


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, compressed member by member or not; lengths alone say where a record ends.

    Header names are in lower case; of a repeated name the values are joined by a comma, and a line that begins with
    white space goes on the one before. Headers are UTF-8; bytes that are not are read as Latin-1.
    """
    for whole in members(data):
        at = 0
        while at < len(whole):
            end = whole.find(END, at)
            head = whole[at:end] if end >= 0 else b""
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {at}")
            try:
                lines = head.decode().split("\r\n")
            except UnicodeDecodeError:
                lines = head.decode("latin-1").split("\r\n")
            headers: dict[str, str] = {}
            name = ""
            for line in lines[1:]:
                if line[:1] in (" ", "\t") and name:
                    headers[name] += " " + line.strip()
                    continue
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
            start, size = end + len(END), int(headers["content-length"])
            if whole[start + size : start + size + 4] != END:
                raise ValueError(f"the record at byte {at} has not the length it states")
            yield headers, whole[start : start + size]
            at = start + size + len(END)


def payloads(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, html, refers_to): who repeats whom. Equal payloads of ``least`` bytes or more refer to the smallest page_id.

    One row for each page_id that is not null (of repeated ids the smallest html); null html is empty.
    The digests of repeated payloads are a table of their own, so that a payload that a third of
    the pages share meets it in a join whose partitions Spark can split. A column url is kept.
    """
    rows = pages.withColumn("_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = F.octet_length("html") >= least
    seen = rows.where(long).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    seen = written(seen.select("_digest", "_first"), "warc-seen")
    found = rows.join(seen, "_digest", "left")
    more = ["url"] if "url" in pages.columns else []
    return found.select("page_id", "html", F.when(F.col("_first") < F.col("page_id"), F.col("_first")).alias("refers_to"), *more)


def write(rows: DataFrame, path: str, segment: int = 64 << 10, records_per_file: int = 1000) -> None:
    """Write (page_id, html, refers_to, and url if there) as archives of up to ``records_per_file`` records under ``path``.

    The records go out through Spark's own text writer, from the tasks that make them, so ``path``
    may be in any store that Spark writes to, and a retried task replaces its files. Each record is
    a row. A page's continuations may be in another archive than the record they continue.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            urls = batch["url"] if "url" in batch else [None] * len(batch)
            for p, html, r, url in zip(batch["page_id"], batch["html"], batch["refers_to"], urls, strict=True):
                for x in records_of(int(p), html.encode(), None if pd.isna(r) else int(r), segment, url):
                    out.append(x[:-1])
                    size += len(x)
                if size > 4 << 20:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            yield pd.DataFrame({"record": out})

    small_batches(rows.sparkSession)
    made = rows.mapInPandas(records, "record binary")
    # the writer ends each row with the newline that was taken off above; the cast leaves the bytes as they are
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def archive(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(file, place, record_id, type, target_uri, date, headers, block) of every record of the archives under ``path``.

    Any WARC archives, plain or of gzip members, with records of any type: warcinfo, request, response,
    resource, metadata, revisit, conversion, continuation. An archive that breaks a rule raises, with
    its name. A task holds one archive at a time.
    """
    kinds = {"file": pa.string(), "place": pa.int32(), "record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                try:
                    for place, (h, block) in enumerate(parse(content)):
                        rows.append((file, place, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), [*h.items()], block))
                        held += len(block) + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(records, "file string, place int, record_id string, type string, target_uri string, date string, headers map<string,string>, block binary")


def read(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Every record under ``path`` that names a page, one row each (see ``write``); other records, as of foreign archives, are passed over."""
    h = lambda name: F.col("headers")[name]
    own = archive(spark, path, names).where(h("x-page-id").isNotNull())
    return own.select(
        "record_id", "type", h("x-page-id").cast("long").alias("page_id"), h("x-refers-to-page-id").cast("long").alias("refers_to"), F.coalesce(h("warc-segment-origin-id"), "record_id").alias("origin"),
        h("warc-segment-number").cast("int").alias("number"), h("warc-segment-total-length").cast("long").alias("total"), F.regexp_replace(h("warc-payload-digest"), "^sha256:", "").alias("digest"), h("x-payload-length").cast("long").alias("declared"), "block",
    )


def entity(block: bytes, content_type: str | None) -> bytes:
    """The payload of a record's block: the body of an HTTP message without chunks and content coding, or the block itself.

    Codings other than gzip and deflate are left as they are.
    """
    if not (content_type or "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        body = unchunked(body)
    coding = fields.get(b"content-encoding", b"")
    if coding in (b"gzip", b"x-gzip"):
        return b"".join(members(body))
    return zlib.decompress(body) if coding == b"deflate" and body[:1] == b"\x78" else body


def assembled(records: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, date, headers, block, payload, problem) of ``archive``: segments together in one row, in the place of their first record.

    Continuations are grouped by the record that they name, put in the order of their numbers, and
    held against the total length. problem says what is wrong: a segment that is missing or repeated,
    another total length, a continuation without its first record, broken framing; it is null if
    nothing is. Groups are as large as one record's block.
    """
    h = lambda name: F.col("headers")[name]
    part = records.withColumns({"_origin": F.coalesce(h("warc-segment-origin-id"), "record_id"), "_number": h("warc-segment-number").cast("int"), "_total": h("warc-segment-total-length").cast("long")})
    out = "record_id string, type string, target_uri string, date string, headers map<string,string>, block binary, payload binary, problem string"
    named = [c.split()[0] for c in out.split(", ")]

    def finished(row: dict, block: bytes, problem: str | None) -> dict:
        payload = None
        if not problem:
            try:
                payload = entity(block, dict(row["headers"]).get("content-type"))
            except (ValueError, zlib.error) as e:
                problem = f"broken framing: {e}"
        return {k: row[k] for k in named[:5]} | {"block": block, "payload": payload, "problem": problem}

    def table(rows: list[dict]) -> pa.Table:
        kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(), pa.string()]
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in zip(named, kinds, strict=True)], named)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from table([finished(r, r["block"], None) for r in b.to_pylist()]).to_batches()

    def joined(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: r["_number"] or 0)
        block, first, problem = b"".join(r["block"] for r in parts), parts[0], None
        numbers = [r["_number"] for r in parts]
        if first["type"] == "continuation":
            problem = "continuations without their first record"
        elif numbers != list(range(1, len(parts) + 1)):
            problem = f"segments {numbers} are there"
        elif parts[-1]["_total"] != len(block):
            problem = f"{len(block)} bytes, the last segment states {parts[-1]['_total']}"
        return table([finished(first, block, problem)])

    alone = (F.col("type") != "continuation") & F.col("_number").isNull()
    one = part.where(F.coalesce(alone, F.lit(True))).select(*named[:6]).mapInArrow(single, out)
    return one.unionByName(part.where(~alone).groupBy("_origin").applyInArrow(joined, out))


def reassembled(records: DataFrame) -> DataFrame:
    """One row per page: page_id, record_type, refers_to, payload, payload_bytes, payload_digest.

    Whole records go straight on. Segments are gathered by origin, whose size a single payload
    bounds. Raises if segments are missing, lengths disagree, or a payload has not its digest.
    A revisit has no payload; its length and digest are those it states.
    """
    out = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def whole(block: bytes, digest: str, declared: int) -> bytes:
        head, _, body = block.partition(END)
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload has not the length or the digest that its record states")
        return payload

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [None if t == "revisit" else whole(k, d, n) for t, k, d, n in zip(b["type"], b["block"], b["digest"], b["declared"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "record_type": b["type"], "refers_to": b["refers_to"].astype("Int64"), "payload": made, "payload_bytes": b["declared"], "payload_digest": b["digest"]})

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("number")
        block, first = b"".join(b["block"]), b.iloc[0]
        if list(b["number"]) != list(range(1, len(b) + 1)) or len(block) != b["total"].iloc[-1]:
            raise ValueError(f"segments of {first['origin']} are missing or have not their total length")
        payload = whole(block, first["digest"], first["declared"])
        return pd.DataFrame({"page_id": [first["page_id"]], "record_type": ["response"], "refers_to": pd.array([None], "Int64"), "payload": [payload], "payload_bytes": [len(payload)], "payload_digest": [hashlib.sha256(payload).hexdigest()]})

    one = records.where("number IS NULL").mapInPandas(single, out)
    many = records.where("number IS NOT NULL").groupBy("origin").applyInPandas(joined, out)
    return one.unionByName(many)
