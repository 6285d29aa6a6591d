"""WARC archives compressed record by record with a dictionary of their own.

An archive is a sequence of Zstandard frames. The first is a skippable frame that holds the dictionary, trained from the
first records of the archive itself; each record follows as a frame of its own, so a reader can start at any of them.
Every archive is one partition, written by Spark's text writer, so that a task that is tried again or a lost executor
leaves no half archive. The writer puts a separator after each row; here it is an empty skippable frame, which readers of
Zstandard pass over.

Of records with equal payloads one is the response; the others are revisits of it, without the payload.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote
from uuid import uuid4

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .common import small

#: Fixed values of the format: skippable frames with a dictionary and in general, an empty one, frames with data, profile of a revisit.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SKIPPED = range(0x184D2A50, 0x184D2A60)
SEPARATOR = "P*M\x18\0\0\0\0"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that a dictionary is trained on, its size, the fewest records to train on, bytes of a record that are looked at.
SAMPLE_BYTES, DICTIONARY_BYTES, LEAST_SAMPLES, SAMPLE_RECORD = 2 << 20, 64 << 10, 8, 128 << 10
LEVEL = 3
#: Bytes of records that go back to Spark at once.
CHUNK_BYTES = 4 << 20
_HEX_32, _BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), _HEX_32, _BASE_32)


def planned(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """(key, url, n, digest, payload, first_key, first_url): the response that a revisit refers to, else null.

    Equal payloads are found by SHA-256. The response is the row of the largest key; rows that repeat this key are
    responses too, as are all of a group without any key; rows without a key revisit the others.
    """
    whole = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), whole.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("same"), F.octet_length("payload").cast("long").alias("n"))
    groups = rows.where(F.col("n") >= least).groupBy("same").agg(F.max(F.struct("key", "url")).alias("first"), F.count("*").alias("c"))
    again = cut_lineage(groups.where("c > 1 and first.key is not null").select("same", "first"))
    met = rows.join(small(again, again.count()), "same", "left")
    revisit = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("first.key")))
    kept = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    first = [F.when(revisit, F.col(f"first.{c}")).cast("string").alias(f"first_{c}") for c in ("key", "url")]
    return met.select(F.col("key").cast("string").alias("key"), "url", "n", base32(F.sha1("payload")).alias("digest"), kept.alias("payload"), *first)


def _address(url: str | None) -> str:
    """A header holds no white space or control character."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: quote(m[0]), url) if url else "about:blank"


def capture(key: str | None, digest: str) -> str:
    """The id of a record; rows that are equal in key and payload are one capture."""
    return f"<urn:capture:{digest}" + ("" if key is None else f":{quote(key, safe='')}") + ">"


def record(key: str | None, url: str | None, n: int, digest: str, payload: bytes, first: str | None, first_url: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {capture(key, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_address(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {capture(first, digest)}", f"WARC-Refers-To-Target-URI: {_address(first_url)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """None where an archive has too few records, or ones too short, to train on."""
    if len(samples) < LEAST_SAMPLES:
        return None
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=1000, d=8)
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: its dictionary, then one for each record."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    own = trained([r[:SAMPLE_RECORD] for r in held])
    if own is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(own.as_bytes())
        yield DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed
        own.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
    for r in chain(held, records):
        yield packer.compress(r)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes each row of pages as a record; one archive for each partition.

    least: payloads of fewer bytes are never revisits. Null payloads are empty ones; rows without an address get
    about:blank; very long payloads are records like others. Repeated rows are records of their own with one id. An
    empty table gives archives without records. Other columns are not read.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for pdf in batches:
                pdf = pdf.astype(object).where(pdf.notna(), None)
                yield from (record(*row, date) for row in pdf.itertuples(index=False, name=None))

        out, size = [], 0
        for frame in frames(records()):
            out.append(frame)
            size += len(frame)
            if size >= CHUNK_BYTES:
                yield pd.DataFrame({"frame": out})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"frame": out})

    archives = planned(pages, key, url, payload, least).mapInPandas(packed, "frame binary")
    archives.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at this place ends: its header, its blocks, its checksum."""
    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return end + (4 if zstandard.get_frame_parameters(head).has_checksum else 0)


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, by its own dictionary."""
    data, at, own = memoryview(archive), 0, None
    unpacker = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPED:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at == 0 and bytes(data[:4]) == DICTIONARY_MAGIC:
                own = bytes(data[8:end])
                own = zstandard.ZstdDecompressor().decompress(own) if own[:4] == FRAME_MAGIC else own
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
        else:
            end = frame_end(data, at)
            yield unpacker.decompress(data[at:end])
        at = end


def parsed(raw: bytes) -> dict:
    """The fields of a record; a digest or length that doesn't fit its payload is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if not first.startswith("WARC/") or len(rest) != int(fields["content-length"]) + 4 or (kind == "response" and (len(payload) != n or b32encode(hashlib.sha1(payload).digest()).decode() != digest)):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return {"record_id": fields["warc-record-id"], "url": fields["warc-target-uri"], "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to_id": fields.get("warc-refers-to"), "payload": payload if kind == "response" else None}


def key_of(capture_id: str | None) -> str | None:
    parts = capture_id.strip("<>").split(":") if capture_id else []
    return unquote(parts[3]) if len(parts) > 3 else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(key, record_id, url, record_type, payload_bytes, payload_digest, refers_to, refers_to_id, payload) of every record of the archives in a folder.

    Payloads are checked against their digests. An archive is read by one task and is as long as the partition it was
    written from.
    """
    schema = "key string, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, refers_to_id string, payload binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            for archive in pdf["content"]:
                rows, size = [], 0
                for raw in records_of(archive):
                    r = parsed(raw)
                    r |= {"key": key_of(r["record_id"]), "refers_to": key_of(r["refers_to_id"])} | ({} if payloads else {"payload": None})
                    rows.append([r[n] for n in names])
                    size += len(r["payload"] or b"") + 500
                    if size >= CHUNK_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content").mapInPandas(read, schema)


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """The rows of pages as read back from archives in the folder that all executors share."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/archives-{uuid4().hex}"
    write_archives(pages, folder, key, **options)
    return read_archives(pages.sparkSession, folder, payloads=False)
