"""WARC archives: write, normalise whole-file gzip into one member a record with an offset index, read back.

Archives go through ``pyarrow.fs`` to the folder that all executors share, under a name of their own for each task
attempt; only names that a finished task has reported are read, so that a lost executor leaves nothing behind but an
unread file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.common import forget, new_path, written
from landfold.tables import joined_by_hot_key

#: Bytes read or inflated at a time; payload bytes after which a task begins another archive.
STEP, ROLL = 1 << 18, 1 << 28
#: Payload bytes that the reader hands on at a time.
FLUSH = 1 << 25
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def _open(path: str, mode: str):
    where, name = fs.FileSystem.from_uri(path)
    if mode == "r":
        return where.open_input_file(name)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name, compression=None)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit whose block is the HTTP header alone; its Content-Length still tells the full size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def _inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, in bounded memory."""
    engine = zlib.decompressobj(31)
    while data := stream.read(STEP):
        while data:
            piece = engine.decompress(data, STEP)
            if piece:
                yield piece
            data = engine.unconsumed_tail or engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    if piece := engine.flush():
        yield piece


def records_of(stream) -> Iterator[bytes]:
    """Whole records of an inflated archive, one at a time."""
    held = bytearray()
    pieces = _inflated(stream)

    def more() -> bool:
        piece = next(pieces, b"")
        held.extend(piece)
        return bool(piece)

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
        size = end + 4 + int(header_fields(bytes(held[:end]))["Content-Length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with ``payload``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least_bytes`` the smallest page_id is the response and the others revisit it.
    Rows that repeat the smallest page_id with the same payload are responses too; a null page_id is never the
    smallest unless no other is there. Columns of these names are replaced, others kept.
    """
    pages = pages.drop("payload", "record_type", "refers_to")
    pages = pages.withColumn("payload", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8"))
    pages = pages.withColumn("_digest", F.unhex(F.sha1("payload")))
    # a digest that many pages share, as that of the empty page, is dealt over many tasks
    first = written(pages.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n")), "digests")
    revisit = (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        joined_by_hot_key(pages, first.drop("n"), "_digest", F.col("page_id"), first)
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_digest", "_first")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(archive): whole-file gzip archives, each one stream, of records(page_id, url, payload, record_type, refers_to)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, engine, path, size = None, None, "", 0
        for frame in frames:
            for page_id, url, payload, kind, refers in zip(*(frame[c] for c in ("page_id", "url", "payload", "record_type", "refers_to"))):
                if out is None:
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out, engine = _open(path, "w"), zlib.compressobj(6, wbits=31)
                data = record_bytes(page_id, url, bytes(payload), refers, kind == "revisit")
                out.write(engine.compress(data))
                size += len(data)
                if size > ROLL:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [path]})
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pd.DataFrame({"archive": [path]})

    # ids as text: a null among numbers would turn them to floats
    as_text = records.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    return written(as_text.mapInPandas(run, "archive string"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, sidecar): each archive inflated once and rewritten with a gzip member a record, beside an index.

    The sidecar is a CSV of ``offset,length,record_id,record_type``. Archives that already have many members, and
    empty ones, are rewritten alike.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source in frame["archive"]:
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                at = 0
                with _open(source, "r") as stream, _open(path, "w") as out, _open(path + ".idx", "w") as index:
                    for record in records_of(stream):
                        engine = zlib.compressobj(6, wbits=31)
                        member = engine.compress(record) + engine.flush()
                        fields = header_fields(record[: record.index(b"\r\n\r\n")])
                        out.write(member)
                        index.write(f"{path},{at},{len(member)},{fields['WARC-Record-ID']},{fields['WARC-Type']}\n".encode())
                        at += len(member)
                yield pd.DataFrame({"archive": [path], "sidecar": [path + ".idx"]})

    few = max(1, archives.count())
    return written(archives.repartition(few).mapInPandas(run, "archive string, sidecar string"), "normalised")


def read_index(spark: SparkSession, normalised: DataFrame, folder: str) -> DataFrame:
    """The sidecars' rows, of archives that a finished task has reported."""
    rows = spark.read.schema(INDEX).csv(f"{folder}/*.idx")
    return rows.join(normalised.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to), each record by its own offset.

    A task hands its records on whenever ``flush`` bytes are together. A revisit has a null payload; its size and digest are those that it states of the full payload. A response's are
    taken from the payload, and a digest that differs from the stated one is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, name = None, None
        columns = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        for frame in frames:
            out, held = [], 0
            for path, offset, length in zip(frame["archive"], frame["offset"], frame["length"]):
                if path != name:
                    stream, name = _open(path, "r"), path
                stream.seek(int(offset))
                record = zlib.decompress(stream.read(int(length)), 31)
                end = record.index(b"\r\n\r\n")
                fields = header_fields(record[:end])
                block = record[end + 4 : end + 4 + int(fields["Content-Length"])]
                http = block.index(b"\r\n\r\n")
                full = int(re.search(rb"Content-Length: (\d+)", block[:http])[1])
                revisit = fields["WARC-Type"] == "revisit"
                payload = None if revisit else block[http + 4 :]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and (digest_of(payload) != digest or len(payload) != full):
                    raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                out.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload, full, digest, _id(fields.get("WARC-Refers-To"))))
                held += len(payload or b"")
                if held >= flush:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    found = index.mapInPandas(run, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _id(urn: str | None) -> str | None:
    number = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number in (None, "None") else number


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every row of pages(page_id, url, html) to archives, normalise them, and return the index."""
    spark = pages.sparkSession
    whole, split = new_path(spark, "warc-whole"), new_path(spark, "warc")
    archives = write_archives(with_revisits(pages, least_bytes), whole)
    if not archives.take(1):
        return spark.createDataFrame([], INDEX)
    normalised = normalise_archives(archives, split)
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    forget(archives)
    return read_index(spark, normalised, split)
