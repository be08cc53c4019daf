"""WARC archives: one gzip member a record, read sequentially.

Writing: a record's type needs only page_id and the payload's digest, so these are grouped first (partial
aggregates keep a hot payload small), and html moves once. Each task writes one archive to the shared folder
under a name of its own attempt and lists it in a manifest; only listed archives are read, so a retried task
leaves no double records.

Reading: bytes are inflated incrementally, member by member, without holding a member's file; a block is framed
by Content-Length, and the payload's SHA-256 is held against WARC-Payload-Digest.

Defined cases: null html is an empty payload; null page_id never is a first record if another page has the
payload; repeated rows are records of their own, and those with the smallest page_id are all responses; an empty
table gives no archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import fresh_path, materialize, shuffle_width, spread_join

MIN_REVISIT_BYTES = 100
READ_BYTES = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as one gzip member. A revisit's block has the HTTP head only; its full payload's size is kept in a header field."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def members(stream, size: int = READ_BYTES) -> Iterator[bytearray]:
    """Inflated gzip members of a byte stream, one after another."""
    waiting = b""
    while True:
        inflate, whole = zlib.decompressobj(31), bytearray()
        began = False
        while not inflate.eof:
            data = waiting or stream.read(size)
            waiting = b""
            if not data:
                if began:
                    raise ValueError("an archive ends within a record")
                return
            began = True
            whole += inflate.decompress(data)
        waiting = inflate.unused_data
        yield whole


def parse_record(member: bytes | bytearray) -> dict:
    """Fields of one record; raises where framing or a digest is wrong."""
    end = member.find(b"\r\n\r\n")
    lines = bytes(member[: max(end, 0)]).decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no record head")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(head["content-length"])
    block = bytes(member[end + 4 : end + 4 + size])
    if len(block) != size or bytes(member[end + 4 + size :]) != b"\r\n\r\n":
        raise ValueError("a block is not as long as its head says")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"]:
        raise ValueError("a block does not match its digest")
    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
        raise ValueError("a payload does not match its digest")
    number = lambda name: None if name in (None, record_name(None)) else int(name[len("<urn:page:") : -1])
    return {"page_id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(head["x-payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("warc-refers-to")), "payload": payload}


def _open(uri: str):
    """File system and path of a URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str):
    def run(batches):
        sink = stream = name = None
        records = size = 0
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if stream is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    sink, path = _open(name)
                    stream = sink.open_output_stream(path, compression=None)
                member = build_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, first)
                stream.write(member)
                records, size = records + 1, size + len(member)
        if stream is not None:
            stream.close()
            yield pa.record_batch([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

    return run


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, digest and refers_to (the smallest page_id) of those pages whose payload another page has first."""
    known = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", F.octet_length("html").alias("size"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest")
    )
    known = known.where(F.col("size") >= min_bytes).select("page_id", "digest")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    later = known.join(first.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and give the manifest: archive, records, bytes."""
    spark = pages.sparkSession
    sink, path = _open(folder)
    sink.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    later = revisits(rows, min_bytes).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    typed = rows.join(later, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    typed = typed.select("page_id", "url", "html", "digest", "refers_to")
    return materialize(typed.mapInArrow(_writer(folder), "archive string, records long, bytes long"), "warc-manifest")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    names = [f.name for f in _READ][: None if with_payload else -1]

    def run(batches):
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, path = _open(uri)
                rows, n, held = [], 0, 0
                with source.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        record = parse_record(member)
                        rows.append(record)
                        n, held = n + 1, held + (len(record["payload"]) if with_payload else 0)
                        if len(rows) >= 2048 or held > 1 << 24:
                            yield pa.record_batch([pa.array([r[c] for r in rows], _READ.field(c).type) for c in names], names=names)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{uri} has {n} records, not {expected}")
                if rows:
                    yield pa.record_batch([pa.array([r[c] for r in rows], _READ.field(c).type) for c in names], names=names)

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of all listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked for, payload."""
    listed = manifest.select("archive", "records").repartition(shuffle_width(spark), "archive")
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return listed.mapInArrow(_reader(with_payload), ddl)


def verify_revisits(records: DataFrame, total: int) -> None:
    """Every revisit's digest and length are those of the response that it refers to; ``total`` records, about."""
    later = records.where("record_type = 'revisit'").select("page_id", F.col("refers_to").alias("first"), "payload_digest", "payload_bytes")
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("first"), "payload_digest", "payload_bytes").distinct()
    bad = spread_join(later, held, ["first", "payload_digest", "payload_bytes"], ["page_id"], total, "left_anti")
    if not bad.isEmpty():
        raise ValueError("a revisit does not match the record that it refers to")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of archives in the shared folder, read them back, and hold revisits against the
    records that they refer to."""
    spark = pages.sparkSession
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    records = read_archives(spark, manifest)
    verify_revisits(records, manifest.agg(F.sum("records")).first()[0] or 0)
    return records
