"""WARC archives: written from a table of pages, read back as records, assembled into captures.

A page becomes a transaction of three records: the request, the response (or a
revisit, where another page's response holds an equal payload) and metadata
with the page's own fields as JSON.  Request and metadata name the response in
WARC-Concurrent-To, a revisit names the earlier response in WARC-Refers-To.
Each record is a gzip member of its own.  Files have names of their task's
attempt, and only files of committed tasks are in the manifest.

Reading goes the other way: archives to records, records to captures by joins
through the concurrent-to identifiers, one nested row per capture.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import attach, scratch_path, ship, stage

VERSION = "WARC/1.1"
#: Fixed value of the format: the profile of revisits by equal payload digest.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins a new file.
ROLL = 64 << 20
#: Payload bytes of one Arrow batch of records, about.
SLICE = 4 << 20
#: Record types that stand for a capture.
CAPTURES = ("response", "revisit", "resource")
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, declared_digest string, payload_digest string, payload_bytes long, head string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(run: str, row: int, kind: str) -> str:
    """An identifier that a repeated attempt gives again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{run}:{row}:{kind}'.encode()).digest(), version=4)}>"


def record_bytes(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: header lines (None is left out), the block, and the two line ends that close it."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _safe_uri(url: str | None) -> str | None:
    """The URL with white space, control and non-ASCII characters escaped, so that it stays on its line."""
    return None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def transaction(run: str, row: int, first: int | None, page_id: int | None, url: str | None, payload: bytes, date: str) -> list[bytes]:
    """Request, response or revisit, and metadata of one page; ``first`` is the row that holds the payload, if another."""
    own, uri, digest = record_id(run, row, "response"), _safe_uri(url), "sha1:" + base32_sha1(payload)
    host, _, path = (uri or "").partition("#")[0].rpartition("://")[2].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    if first is None:
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", own)]
        answer += payload
    else:
        kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(run, first, "response"))]
    said = json.dumps({"page_id": page_id, "url": url}).encode()
    return [
        record_bytes([("WARC-Type", "request"), ("WARC-Record-ID", record_id(run, row, "request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")], request),
        record_bytes([*kind, ("WARC-Payload-Digest", digest), *common, ("Content-Type", "application/http; msgtype=response")], answer),
        record_bytes([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(run, row, "metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/json")], said),
    ]


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> str:
    """Writes every page's transaction to gzip'd archives; returns the folder, whose ``manifest`` names them.

    Of pages with equal payloads (html in UTF-8, null is empty) of at least
    ``least`` bytes, the one with the largest page_id has the response, the
    others revisit it; of rows that share this id too, one is picked.  Null ids
    are below all others.  Payloads are equal when length and sha256 are.
    Repeated rows are all written; an empty table writes an empty manifest.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    run, date = uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload")).alias("same"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "warc_rows")
    shared = rows.where(F.octet_length("payload") >= least) if least else rows
    firsts = shared.groupBy("same").agg(F.count("*").alias("pages"), F.max(F.struct("page_id", "row"))["row"].alias("first")).where("pages > 1")
    firsts = stage(firsts, "warc_firsts")
    joined = attach(rows, firsts, "same", "pages").select("page_id", "url", "payload", "row", F.when(F.col("first") != F.col("row"), F.col("first")).alias("first"))

    @K.tidy
    def write(batches):
        files, path = arrow_fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        out, done = None, []

        def close():
            out.close()
            return {"file": name, "records": records, "bytes": size}

        for batch in batches:
            ids, urls, texts, at, firsts = batch.columns
            for k in range(len(batch)):
                if out is None:
                    name, records, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                for raw in transaction(run, at[k].as_py(), firsts[k].as_py(), ids[k].as_py(), urls[k].as_py(), texts[k].as_py(), date):
                    packed = _member(raw)
                    out.write(packed)
                    records, size = records + 1, size + len(packed)
                if size >= ROLL:
                    done.append(close())
                    out = None
        if out is not None:
            done.append(close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    joined.mapInArrow(write, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return folder


def parse_records(source: io.BufferedIOBase):
    """(header fields, block) of every record of an uncompressed stream.

    Field names are lower-case; a repeated field has a list of values.  A
    record that is cut off or has no valid header ends the stream.
    """
    while True:
        line = source.readline(1 << 16)
        while line in (b"\r\n", b"\n"):
            line = source.readline(1 << 16)
        if not line.startswith(b"WARC/"):
            return
        fields: dict[str, list[str]] = {}
        last = None
        while True:
            line = source.readline(1 << 20)
            if not line:
                return
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not text:
                break
            if text[0] in " \t" and last:  # a folded line goes on
                fields[last][-1] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields.setdefault(last, []).append(value.strip())
        size = (fields.get("content-length") or [""])[0]
        if not size.isdigit():
            return
        block = source.read(int(size))
        if len(block) < int(size):
            return
        yield fields, block


def _record(fields: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    one = lambda name: (fields.get(name) or [None])[0]
    head, payload, kind = b"", block, one("warc-type")
    if (one("content-type") or "").lower().startswith("application/http"):
        head, end, payload = block.partition(b"\r\n\r\n")
        if not end:
            head, payload = block, b""
    if kind == "metadata":
        head = block
    declared = one("warc-payload-digest")
    return {
        "record_id": one("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"),
        "declared_digest": declared, "payload_digest": base32_sha1(payload), "payload_bytes": len(payload), "head": head.decode("utf-8", "replace"), "payload": payload if payloads else None,
    }


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that the column ``file`` names (gzip'd or not), payloads left out on request.

    ``head`` holds the HTTP header of requests and responses, and the text of
    metadata.  Payloads are digested as they lie in the archive; transfer and
    content encodings aren't undone.  An unreadable rest of a file is left out.
    """
    ship(archives.sparkSession)
    form = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("declared_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("head", pa.string()), ("payload", pa.binary())])

    @K.tidy
    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = arrow_fs.FileSystem.from_uri(name)
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    plain = io.BufferedReader(raw, 1 << 20)
                    source = gzip.GzipFile(fileobj=plain) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
                    rows, held = [], 0
                    try:
                        for fields, block in parse_records(source):
                            rows.append(_record(fields, block, payloads))
                            held += len(block)
                            if held >= SLICE or len(rows) >= 1000:
                                yield pa.RecordBatch.from_pylist(rows, form)
                                rows, held = [], 0
                    except (EOFError, gzip.BadGzipFile, zlib.error):
                        pass  # a cut-off archive: what came before counts
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, form)

    return archives.select(F.col("file").cast("string")).mapInArrow(read, RECORD)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a written folder's manifest, dealt over tasks."""
    manifest = spark.read.parquet(f"{folder}/manifest").select(F.concat(F.lit(folder + "/"), "file").alias("file"))
    return manifest.repartition(max(1, min(manifest.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, its ``request`` and its ``metadata`` (null where there is none), and their numbers.

    Records belong together when either names the other in concurrent_to, and
    metadata also through the request.  Of several requests or metadata records
    the one with the least identifier stands in the row.  They are reduced to
    one row per identifier named before they are joined, so no number of
    records that name one response meets in a task.  Requests and metadata
    without a capture, and other types, have no row.  A capture without an
    identifier has a row of its own.
    """
    records = stage(records, "warc_records")
    part = lambda df: F.struct(*[c for c in df.columns if c not in ("n", "to")])
    capture = records.where(F.col("type").isin(*CAPTURES))
    rest = records.where(F.col("type").isin("request", "metadata")).drop("payload_digest", "declared_digest", "refers_to")
    rest = rest.select("record_id", *[c for c in rest.columns if c != "record_id"])

    def reduced(named: DataFrame) -> DataFrame:
        """One row per identifier named: the least request and metadata record, and how many."""
        is_ = lambda kind: F.col("type") == kind
        return named.groupBy("to").agg(*[f for kind in ("request", "metadata") for f in (F.min(F.when(is_(kind), F.col("one"))).alias(kind), F.count(F.when(is_(kind), 1)).alias("n_" + kind))])

    named = reduced(rest.select(F.explode("concurrent_to").alias("to"), "type", part(rest).alias("one")))
    out = capture.select(part(capture).alias("capture"), F.col("record_id").alias("to")).join(named, "to", "left")
    if not capture.where(F.size("concurrent_to") > 0).isEmpty():  # captures that name the others
        naming = capture.select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("record_id"))
        weights = naming.groupBy("record_id").agg(F.count("*").alias("n"))
        found = attach(naming, rest.select("record_id", "type", part(rest).alias("one")).join(weights, "record_id"), "record_id", "n").where("type is not null")
        other = reduced(found.select("to", "type", "one")).select("to", *[F.col(c).alias(c + "_2") for c in ("request", "n_request", "metadata", "n_metadata")])
        out = out.join(other, "to", "left").select("to", "capture", *[x for c in ("request", "metadata") for x in (F.coalesce(c, c + "_2").alias(c), (F.coalesce("n_" + c, F.lit(0)) + F.coalesce(f"n_{c}_2", F.lit(0))).alias("n_" + c))])
    through = named.select(F.col("to").alias("request_id"), F.col("metadata").alias("far"), F.col("n_metadata").alias("n_far")).where("n_far > 0")
    out = out.withColumn("request_id", F.col("request.record_id")).join(through, "request_id", "left")
    return out.select("capture", "request", F.coalesce("metadata", "far").alias("metadata"), F.coalesce("n_request", F.lit(0)).alias("n_request"), (F.coalesce("n_metadata", F.lit(0)) + F.coalesce("n_far", F.lit(0))).alias("n_metadata"))


def page_captures(captures: DataFrame) -> DataFrame:
    """Captures of written pages: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the size and digest of the response it refers to.
    """
    page = F.get_json_object("metadata.head", "$.page_id").cast("long")
    flat = captures.select(F.col("capture.record_id").alias("record_id"), page.alias("page_id"), F.get_json_object("metadata.head", "$.url").alias("url"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"))
    flat = stage(flat, "warc_captures")
    whole, again = flat.where("record_type <> 'revisit'"), flat.where("record_type = 'revisit'")
    cited = again.groupBy("to").agg(F.count("*").alias("n"))
    origin = whole.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).join(cited, "to")
    again = attach(again, origin, "to", "n").select("page_id", "url", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return whole.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again)
