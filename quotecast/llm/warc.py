"""WARC archives: written from pages, read back, and assembled to one row per capture."""

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from quotecast.llm.tables import written
from quotecast.llm.urls import parts

MARK = b"WARC/1."  # what every record starts with, up to the minor version
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRIMARY = ("response", "revisit", "resource")
COMPANIONS = ("request", "metadata")
RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "content_type string, stated_digest string, payload_bytes long, payload_digest string, payload binary"
)


def sha1_base32(data):
    """Column: SHA-1 of a binary in base32, upper case."""
    told = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(told, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind, own, row):
    """Column: a record id that depends on the record's kind, its content and its row."""
    h = F.sha2(F.concat_ws(":", F.lit(kind), own, row.cast("string")), 256)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind, record_id, uri, date, content_type, block, **headers):
    """Column: one WARC record without the last line end, which the text writer adds."""
    named = [F.concat(F.lit(f"WARC-{k.replace('_', '-')}: "), v) for k, v in headers.items()]
    return F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),  # concat_ws leaves out what is null
        *named,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
        F.concat(block, F.lit("\r\n")),
    )


def write_archives(pages, path, id_col="page_id", url_col="url", html_col="html", min_bytes=0, date=DATE):
    """Write a request, a response or revisit, and a metadata record for each row of pages.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of
    at least ``min_bytes`` bytes the one with the largest (id, url) becomes a response
    (null is smallest, of rows equal in both the last one), the others become revisits
    that refer to it; rows with smaller payloads are all responses. Requests and
    metadata name their response or revisit in WARC-Concurrent-To. Metadata records
    hold id and url as JSON, so both come back as they were; in the headers, white
    space and control characters of a URL become %20, and a null URL has no header.

    Records are string columns; Spark's text writer and its commit protocol write
    them as gzipped archives, one a task. Payloads are shuffled once, with rows equal
    in all three columns combined map-side; everything else is decided on narrow
    rows in a table of the shared folder. Extra columns are not read. No rows: no records.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    told = F.to_json(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    key = F.sha2(payload.cast("binary"), 256)
    own = F.sha2(F.concat(key, F.lit(":"), told), 256)
    narrow = written(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        told.alias("told"), key.alias("key"), own.alias("own"),
        sha1_base32(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    ))
    best = (
        narrow.where(F.col("bytes") >= min_bytes).groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url", "row", "own")).alias("best"))
        .where("n > 1").select("key", "best")
    )
    first = F.col("best").isNull() | (F.col("best.row") == F.col("row")) | (F.col("bytes") < min_bytes)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    decided = written(narrow.join(best, "key", "left").select(
        "row", "own", "told", "digest", "bytes", uri.alias("uri"),
        _urn("capture", F.col("own"), F.col("row")).alias("record_id"),
        F.when(~first, _urn("capture", F.col("best.own"), F.col("best.row"))).alias("refers_to"),
    ))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    asked = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^.*?://[^/?#]*([^#]*)", 1)
    request = F.concat(
        F.lit("GET "), F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), asked)),
        F.lit(" HTTP/1.1\r\nHost: "), parts(F.col("uri"))[0], F.lit("\r\n\r\n"))
    message = "application/http; msgtype="
    small = decided.select(F.explode(F.array(
        _record("request", _urn("request", F.col("own"), F.col("row")), F.col("uri"), date, message + "request", request,
                Concurrent_To=F.col("record_id")),
        _record("metadata", _urn("metadata", F.col("own"), F.col("row")), F.col("uri"), date, "application/json", F.col("told"),
                Concurrent_To=F.col("record_id")),
        F.when(F.col("refers_to").isNotNull(), _record(
            "revisit", F.col("record_id"), F.col("uri"), date, message + "response", http, Payload_Digest=digest,
            Profile=F.lit(PROFILE), Refers_To=F.col("refers_to"))),
    )).alias("value")).where("value is not null")
    payloads = pages.select(own.alias("own"), payload.alias("payload")).groupBy("own").agg(F.first("payload").alias("payload"))
    responses = decided.where("refers_to is null").join(payloads, "own").select(_record(
        "response", F.col("record_id"), F.col("uri"), date, message + "response", F.concat(http, F.col("payload")),
        Payload_Digest=digest).alias("value"))
    small.unionByName(responses).write.text(path, compression="gzip", lineSep="\r\n")


def _whole(pieces):
    """(head, block) of every record, from an archive's pieces between version marks.

    A piece ends at a mark, which a payload or a header may hold as well: the head's
    Content-Length tells whether the record goes on behind it.
    """
    now, held, size, need, cut = None, [], 0, None, 0
    for file, start, piece in pieces:
        if file != now:
            if held:
                raise ValueError(f"{now} ends inside a record")
            if start or piece.strip():
                raise ValueError(f"{file} does not start with a record: archives are gzipped and read whole")
            now = file
            continue
        held += [MARK, piece] if held else [piece]
        size += len(piece) + (len(MARK) if len(held) > 1 else 0)
        if need is None:
            data = b"".join(held)
            held, cut = [data], data.find(b"\r\n\r\n")
            if cut < 0:
                continue
            length = [v for k, v in _fields(data[:cut]) if k == "content-length"]
            if not length:
                raise ValueError(f"{file} holds a record without Content-Length")
            need = cut + 4 + int(length[0])
        if size < need + 4:
            continue
        data = b"".join(held)
        if data[need:].strip():
            raise ValueError(f"{file} holds a record longer than its Content-Length")
        yield data[:cut], data[cut + 4 : need]
        held, size, need = [], 0, None
    if held:
        raise ValueError(f"{now} ends inside a record")


def _fields(head):
    """Header lines after the version, as (lower-case name, value)."""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        yield name.strip().lower(), value.strip()


def records_of(stream, payloads):
    """Rows of ``RECORD`` from batches of (file, start, value) in archive order."""

    def pieces():
        for batch in stream:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")))

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    text = pa.string()
    schema = pa.schema([
        ("record_id", text), ("type", text), ("concurrent_to", pa.list_(text)), ("refers_to", text), ("target_uri", text),
        ("date", text), ("content_type", text), ("stated_digest", text), ("payload_bytes", pa.int64()),
        ("payload_digest", text), ("payload", pa.binary())])
    rows, size = [], 0
    for head, block in _whole(pieces()):
        fields, concurrent = {}, []
        for k, v in _fields(head):
            if k == "warc-concurrent-to":
                concurrent.append(v)
            fields[k] = v
        kind, content = fields.get("warc-type"), fields.get("content-type")
        payload = block
        if content and content.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        wanted = kind in payloads
        rows.append({
            "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": concurrent,
            "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "content_type": content, "stated_digest": (fields.get("warc-payload-digest") or "").partition(":")[2] or None,
            "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "payload": payload if wanted else None,
        })
        size += len(payload) if wanted else 200
        if size > 1 << 22:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def read_records(spark, path, payloads=(*PRIMARY, *COMPANIONS)):
    """A row for each record of gzipped archives (.gz), columns of ``RECORD``.

    Spark's text reader decompresses each archive as a stream and cuts it at version
    marks; tasks hold one record at a time. Payloads are a message's body for HTTP
    records, else the block; only those of the types in ``payloads`` are returned,
    sizes and digests of all. A broken archive raises.
    """
    raw = spark.read.text(path, lineSep=MARK.decode()).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(lambda s: records_of(s, payloads), RECORD)


def captures(records):
    """One nested row per capture: record_id, capture (struct), requests and metadata (arrays of structs).

    A capture is a response, revisit or resource record. Requests and metadata
    belong to the capture they name in WARC-Concurrent-To, or to the one that names
    them. A companion of several captures is in each; one without a capture among
    the records stands in a row of its own target with a null capture. Rows are joined by
    record id; arrays are ordered by record id and hold one transaction. Record ids are
    unique, so rows repeated with one record id count once. Records of other types are left out.
    ``records`` is read three times: write it first where reading means parsing archives.
    """
    whole = F.struct(*records.columns)
    primary = records.where(F.col("type").isin(*PRIMARY)).select("record_id", "concurrent_to", whole.alias("capture"))
    primary = primary.dropDuplicates(["record_id"])
    others = records.where(F.col("type").isin(*COMPANIONS)).dropDuplicates(["record_id"])
    named = primary.select(F.explode("concurrent_to").alias("_named"), F.col("record_id").alias("_by"))
    found = others.join(named, F.col("record_id") == F.col("_named"), "left").select(
        F.explode(F.array_distinct(F.when(F.col("_by").isNotNull(), F.array("_by")).otherwise(
            F.when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("record_id"))))).alias("record_id"),
        "type", whole.alias("record"))

    def of(kind):
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("record"))))

    companions = found.groupBy("record_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast(companions.schema["requests"].dataType)
    return primary.drop("concurrent_to").join(companions, "record_id", "full").select(
        "record_id", "capture", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))
