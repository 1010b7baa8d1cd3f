"""WARC archives: writing with segmentation and revisits, and reassembly of segments on reading.

Writing. A page is an HTTP response in chunked transfer framing. Of pages with equal payloads one is
a response, the others are revisits that refer to it. A record's block beyond ``segment_bytes`` goes on in
continuation records, which name the first record's id as their origin and carry segment numbers;
the last one has the total length. Every record is a gzip member of its own, and a file is members one after
the other, as any WARC reader expects. Spark's text writer stores them: it ends each value with a
separator, and the last byte of a member is the top byte of its length, zero below 2**24 bytes, so
values go without that byte and the separator is it. Files hold a fixed number of such values, so their
size is bounded wherever large pages meet.

Reading. A task parses whole files. Records without segment numbers are decoded there and then. Segments
are grouped by their origin, ordered by number, checked against the total length, joined, and
freed from their chunk framing. What doesn't fit stays in the result with a word in ``problem``. Only
segments and the keys of revisits are shuffled; archives are parsed once for each of the two kinds.
"""
from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, table

#: bytes of members in a value, and values in a file
_VALUE, _VALUES = 2_000_000, 12
#: bytes that a member's decompression is given at once
_FED = 16_384
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def framed(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), chunk_bytes):
        part = payload[k : k + chunk_bytes]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes | None:
    """The payload within chunked framing, without chunk extensions and trailers; None if the framing is broken."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2
    return None


def payload_of(block: bytes) -> tuple[bytes, str | None]:
    """The payload of an HTTP message, and what is wrong with it."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return block, "no HTTP head"
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    if "chunked" not in fields.get("transfer-encoding", "").lower():
        return body, None
    found = unframed(body)
    return (body, "chunk framing") if found is None else (found, None)


def _fields(lines: list[bytes]):
    """Header fields, names in lower case; a line that begins with a blank goes on with the one before."""
    name, value = None, ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t"):
            value += " " + text.strip()
            continue
        if name is not None:
            yield name, value
        name, _, value = text.partition(":")
        name, value = name.strip().lower(), value.strip()
    if name is not None:
        yield name, value


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"WARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (sha1_base32(block).encode(), len(block)), block, b"\r\n\r\n"])


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = 1_000_000, chunk_bytes: int = 16_384, date: str | None = None) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to gzip files in ``folder``.

    Null html is an empty payload; empty payloads are equal to each other like any other. Of rows with
    equal payloads that with the smallest page_id is the response, a null one counting as the largest; of
    rows that share it too, one is. Null urls have no target, blanks and control characters within them are
    percent-encoded. A null page_id has no Page-ID field. Further columns are ignored; an empty table
    gives a folder without records. A page of any length is one row and as many segments as it takes.
    """
    if not 0 < segment_bytes <= 15_000_000 or chunk_bytes < 1:
        raise ValueError("segments must stay below 15 MB, chunks above 0 bytes")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    store = uuid.uuid4()
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    # the row's number tells rows with one page_id apart; written down, so that it stays the same
    rows = materialise(rows.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id()), "pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url"))
    firsts = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("many")).filter("many > 1").select(F.col("digest").alias("of"), F.col("first.row").alias("first"), F.col("first.url").alias("first_url"))
    firsts = materialise(firsts, "firsts")  # now its size is known: if it is small it is broadcast, else both sides are shuffled by digest
    laid = rows.join(firsts, F.col("digest") == F.col("of"), "left").select("row", "page_id", "url", "payload", F.when(F.col("first") != F.col("row"), F.col("first")).alias("first"), "first_url")
    name = lambda row, k: f"<urn:uuid:{uuid.uuid5(store, f'{row}/{k}')}>"
    clean = lambda url: None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)

    def records(row, page_id, url, payload, first, first_url):
        fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name(row, 1)), ("WARC-Date", date), ("WARC-Target-URI", clean(url)), ("Page-ID", page_id),
                  ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
        if first is not None:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(first, 1)), ("WARC-Refers-To-Target-URI", clean(first_url)), ("WARC-Refers-To-Date", date)]
            yield _record(fields, _HTTP)
            return
        block = _HTTP + framed(payload, chunk_bytes)
        if len(block) <= segment_bytes:
            yield _record(fields, block)
            return
        yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
        last = -(-len(block) // segment_bytes)
        for k in range(2, last + 1):
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", name(row, k)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name(row, 1)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == last else None)]
            yield _record(fields, block[(k - 1) * segment_bytes : k * segment_bytes])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row, page_id, url, payload, first, first_url = (batch.column(c)[k].as_py() for c in range(6))
                for record in records(row, page_id, url, payload, first, first_url):
                    held.append(gzip.compress(record, 6, mtime=0))
                    size += len(held[-1])
                    if size > _VALUE:
                        yield value(held)
                        held, size = [], 0
        if held:
            yield value(held)

    def value(members):
        data = b"".join(members)
        if data[-1]:
            raise ValueError("a record is too long for its member")
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    laid.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", _VALUES).text(folder)
    discard(rows, firsts)


def parsed(data: bytes):
    """Yield the fields and block of each record of an archive, gzip members or plain, and what is wrong with it."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":  # plain to the end
            yield from _plain(data[at:])
            return
        member, parts = zlib.decompressobj(31), []
        try:
            while not member.eof and at < len(data):  # a little at a time: what is left over is copied
                parts.append(member.decompress(data[at : at + _FED]))
                at += _FED
        except zlib.error:
            yield {}, b"", "broken member"
            return
        if not member.eof:
            yield from _plain(b"".join(parts), "truncated")
            return
        yield from _plain(b"".join(parts))
        at = min(at, len(data)) - len(member.unused_data)


def _plain(text: bytes, wrong: str | None = None):
    at = 0
    while at < len(text):
        while text[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(text):
            return
        end = text.find(b"\r\n\r\n", at)
        if text[at : at + 5] != b"WARC/" or end < 0:
            yield {}, b"", wrong or "no record head"
            return
        fields = dict(_fields(text[at:end].split(b"\r\n")[1:]))
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            yield fields, b"", "no length"
            return
        block = text[end + 4 : end + 4 + int(size)]
        yield fields, block, wrong or ("truncated" if len(block) < int(size) else None)
        at = end + 4 + int(size)


_SEGMENT = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to_id string, declared string, problem string, segment int, total long, block binary"
_RECORD = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to_id string, declared string, n_segments int, payload_bytes long, payload_digest string, problem string, payload binary"


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch("[0-9]{1,18}", x) else None


def _head(fields: dict) -> list:
    page = fields.get("page-id")
    declared = fields.get("warc-payload-digest", "")
    return [fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), int(page) if page and re.fullmatch("-?[0-9]{1,18}", page) else None,
            fields.get("warc-refers-to"), declared[5:].upper() if declared.lower().startswith("sha1:") else None]


def _decoded(head: list, block: bytes, problem: str | None, segments: int, keep: bool) -> tuple:
    """A row of _RECORD: revisits have no payload, responses that of the HTTP message, others their block."""
    declared = head[6]
    if head[1] == "revisit" or problem in ("segment missing", "segments differ", "no record head", "broken member"):
        return (*head, segments, None, None, problem, None)
    payload, wrong = payload_of(block) if head[1] == "response" else (block, None)
    digest = sha1_base32(payload)
    if declared is not None and declared != digest and head[1] == "response":
        wrong = wrong or "payload digest differs"
    return (*head, segments, len(payload), digest, problem or wrong, payload if keep else None)


def _types(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def assembled(numbers: list[int | None], totals: list[int | None], blocks: list[bytes]) -> tuple[bytes, int, str | None]:
    """The block whose segments these are, how many there are, and what is wrong: segments may come in any order, and more than once if they are alike."""
    different: dict[int | None, bytes] = {}
    for n, b in zip(numbers, blocks):
        if different.setdefault(n, b) != b:
            return b"", len(different), "segments differ"
    total = {t for t in totals if t is not None}
    if None in different or sorted(different) != [*range(1, len(different) + 1)] or not total:
        return b"", len(different), "segment missing"
    block = b"".join(different[n] for n in sorted(different))
    return block, len(different), None if total == {len(block)} else "length differs"


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``folder``: record_id, record_type, target_uri, date, page_id, refers_to_id,
    declared (payload digest), n_segments, payload_bytes, payload_digest, problem, payload (null unless ``payloads``).

    Continuations are part of their origin's record; those whose first segment is missing are a row of type continuation.
    ``problem`` is null for a record that is whole, else one of: broken member, no record head, no length, truncated, block
    digest differs, segment missing, segments differ, length differs, no HTTP head, chunk framing, payload digest differs.
    A file is read by one task, and a record is one row; both must fit a task's memory.
    """
    segment, record = _types(_SEGMENT), _types(_RECORD)

    def parse(batches, segments: bool):
        schema = segment if segments else record
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for fields, block, problem in parsed(batch.column(0)[k].as_buffer().to_pybytes()):
                    if ("warc-segment-number" in fields) != segments:
                        continue
                    declared = fields.get("warc-block-digest", "")
                    if not problem and declared.lower().startswith("sha1:") and declared[5:].upper() != sha1_base32(block):
                        problem = "block digest differs"
                    head = _head(fields)
                    if segments:
                        head[0] = fields.get("warc-segment-origin-id") or head[0]
                        rows.append((*head, problem, _number(fields["warc-segment-number"]), _number(fields.get("warc-segment-total-length")), block))
                        size += len(block)
                    else:
                        rows.append(_decoded(head, block, problem, 1, payloads))
                        size += len(block) if payloads else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.astype(object).where(group.notna(), None).itertuples(index=False, name=None))
        rows.sort(key=lambda r: (r[8] is None, r[8] or 0, r[1] == "continuation"))
        number = lambda x: None if x is None else int(x)
        block, n, wrong = assembled([number(r[8]) for r in rows], [number(r[9]) for r in rows], [bytes(r[10] or b"") for r in rows])
        head = [*rows[0][:4], number(rows[0][4]), *rows[0][5:7]]
        made = _decoded(head, block, next((r[7] for r in rows if r[7]), None) or wrong, n, payloads)
        out = pd.DataFrame([made], columns=record.names)
        return out.assign(**{c: pd.array(out[c], "Int64") for c in ("page_id", "payload_bytes")})

    files = spark.read.format("binaryFile").load(folder).select("content")
    whole = files.mapInArrow(lambda b: parse(b, False), _RECORD)
    parts = files.mapInArrow(lambda b: parse(b, True), _SEGMENT)
    return whole.unionByName(parts.groupBy("record_id").applyInPandas(join, _RECORD))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem for every response and revisit.

    A revisit has its response's payload, and that one's page_id in ``refers_to``; where the response is
    missing or has another digest than the revisit says, ``problem`` tells. ``records`` is read twice: give a stored table.
    """
    own = records.filter("record_type = 'response'")
    said = own.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"), F.lit(True).alias("there"))
    again = records.filter("record_type = 'revisit'").join(said, F.col("refers_to_id") == F.col("of"), "left")
    wrong = F.coalesce("problem", F.when(F.col("there").isNull(), F.lit("response missing")).when(F.col("declared") != F.col("d"), F.lit("payload digest differs")))
    again = again.select("page_id", F.col("n").alias("payload_bytes"), F.coalesce("d", "declared").alias("payload_digest"), "record_type", "refers_to", wrong.alias("problem"))
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem").unionByName(again)


def op11_query(spark, sf_dir):
    folder = f"{shared_dir(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages"), folder, segment_bytes=16_384, chunk_bytes=4_096)
    return resolved(materialise(read_records(spark, folder, payloads=False), "records"))


OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, h, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, row_number() OVER same AS k, first_value(page_id) OVER same AS first_id,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest
  FROM p WINDOW same AS (PARTITION BY h ORDER BY page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM d
"""
