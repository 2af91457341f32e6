"""WARC archives as a Spark data source: one gzip member for each record.

Writing makes one file for each task; a write's commit lists the files of the
attempts that won, so a task that runs twice leaves no record twice. Reading is
sequential: each file is one task, members are inflated piece by piece, a record
ends where its Content-Length says, and digests are compared on the way.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from proofcast.llm.common import cut
from proofcast.session import fresh_folder

PIECE = 1 << 16
MANIFEST = "_files"
SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"
#: Fixed by the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks its own framing or digest."""


def record(record_id: str, kind: str, refers_to: str | None, uri: str | None, size: int, digest: str, payload: bytes) -> bytes:
    """One record, compressed as a gzip member of its own.

    The HTTP head states the size of the whole payload, also in a revisit, whose
    block is the head alone.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if uri:
        fields.append(("WARC-Target-URI", "".join(uri.split())))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


class Members:
    """The inflated bytes of one gzip member after another, from a stream."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate = stream, b"", None

    def start(self) -> bool:
        """Go to the next member; false at the end of the stream."""
        self.rest = self.rest or self.stream.read(PIECE)
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return self.inflate is not None

    def read(self) -> bytes:
        """Some bytes of this member; empty at its end."""
        while not self.inflate.eof:
            source = self.inflate.unconsumed_tail or self.rest or self.stream.read(PIECE)
            if not source:
                raise WarcError("the file ends inside a gzip member")
            self.rest = b""
            try:
                out = self.inflate.decompress(source, PIECE)
            except zlib.error as why:
                raise WarcError(f"broken gzip member: {why}") from why
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if out:
                return out
        return b""


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(stream) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive; breaks raise WarcError."""
    members = Members(stream)
    while members.start():
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            piece = members.read()
            if not piece:
                raise WarcError("a record has no end of its header")
            held += piece
        if not held.startswith(VERSION):
            raise WarcError("not a WARC record")
        fields = _fields(bytes(held[:end]))
        length = int(fields["content-length"])
        body = held[end + 4 :]
        while len(body) < length:
            piece = members.read()
            if not piece:
                raise WarcError("a record is shorter than its Content-Length")
            body += piece
        tail = bytes(body[length:])
        while piece := members.read():
            tail += piece
        if tail != b"\r\n\r\n":
            raise WarcError("a record is longer than its Content-Length")
        block = bytes(body[:length])
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
            raise WarcError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, kind = int(_fields(http)["content-length"]), fields["warc-type"]
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise WarcError("payload digest or size differs")
        refers = fields.get("warc-refers-to")
        yield (
            fields["warc-record-id"].strip("<>"),
            kind,
            refers.strip("<>") if refers else None,
            fields.get("warc-target-uri"),
            size,
            digest,
            payload if kind == "response" else None,
        )


@dataclass
class Done(WriterCommitMessage):
    name: str | None


@dataclass
class Archive(InputPartition):
    name: str


def _manifests(store, folder: str) -> list[str]:
    """Paths of the lists that commits have left, one for each."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


class WarcWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool = False):
        self.uri, self.overwrite = uri, overwrite

    def write(self, rows: Iterator) -> Done:
        """A file of this attempt's own name, so attempts never meet."""
        first = next(rows, None)
        if first is None:
            return Done(None)
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            while first is not None:
                out.write(record(first.record_id, first.record_type, first.refers_to, first.target_uri, first.payload_bytes, first.payload_digest, first.payload))
                first = next(rows, None)
        return Done(name)

    def commit(self, messages: list[Done]) -> None:
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder, recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        before = _manifests(store, folder) if self.overwrite else []
        # a list is written under another name first: readers see it whole or not at all
        draft, path = f"{folder}/.{uuid4().hex}", f"{folder}/{MANIFEST}-{uuid4().hex}.json"
        with store.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps(names).encode())
        store.move(draft, path)
        for old in before:
            with store.open_input_stream(old, compression=None) as listed:
                gone = json.loads(listed.read())
            store.delete_file(old)
            for name in gone:
                store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Done]) -> None:
        """Files of tasks that ended go; those of lost tasks are in no list and never count."""
        store, folder = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


class WarcReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Archive]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        lists = _manifests(store, folder)
        if not lists:
            raise FileNotFoundError(f"{self.uri} holds no archive")
        names = []
        for path in lists:
            with store.open_input_stream(path, compression=None) as listed:
                names += json.loads(listed.read())
        return [Archive(name) for name in names] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if partition.name:
            store, folder = fs.FileSystem.from_uri(self.uri)
            with store.open_input_stream(f"{folder}/{partition.name}", compression=None) as stream:
                yield from records(stream)


class WarcSource(DataSource):
    """`format("warc")`: a folder of archives and a list of those that count."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def captures(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", least_bytes: int = 100) -> DataFrame:
    """Rows to archive: SCHEMA, with the payload of revisits left out.

    Of equal payloads of at least `least_bytes`, the smallest page_id is the
    response and the others revisit it; smaller payloads are all responses. Null
    html is an empty payload. A null page_id is never revisited and, having no
    name to be found by, always a response; of rows with one id and one payload
    all are responses. Only digests meet to find the smallest id.
    """
    whole = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{page_id}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("target_uri") if url in pages.columns else F.lit(None).cast("string").alias("target_uri"),
        whole.alias("payload"),
    ).select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least_bytes).where("page_id is not null")
    shared = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = cut(shared.where("first < last").drop("last"), "shared-payloads")
    found = rows.join(shared, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    return found.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        "target_uri",
        "payload_bytes",
        "payload_digest",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_warc(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Add records to an archive folder, or replace what it holds (`overwrite`)."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode(mode).save(path)


def read_warc(spark, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write the pages to a new archive folder and read it back."""
    path = folder or fresh_folder(pages.sparkSession, "llm-warc")
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    write_warc(captures(pages, **columns), uri)
    return read_warc(pages.sparkSession, uri)


def page_of(record_id):
    """The page id in a record id; null for the record of a null id."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
