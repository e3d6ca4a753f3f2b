"""WARC archives: one gzip member for each record, and a sequential reader.

Writing: payloads are grouped by digest and length; the smallest id of a group is its response, the others are revisit
records that name it and hold no payload. Each task writes archives of its own, of about ARCHIVE_BYTES, to the shared
folder under names that no other attempt uses; only archives in the written manifest are read, so a task that ran twice
leaves an orphan, not a duplicate.

Reading: an archive is read front to back in chunks; each member is inflated incrementally (bounded by the record),
the head ends at the empty line, Content-Length frames the block, and the digests of block and payload are verified; a
record that doesn't verify is an error.

Defined results: a null html is an empty payload; equal rows are records of their own; a null id is written as such, and is
a group's response only where the group has no id; rows with the response's id are responses as well; extra columns are
passed over; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import cut, new_path

ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 16
_EPOCH = "1970-01-01T00:00:00Z"  # records carry no clock: equal tables make equal archives


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None) -> str:
    """The id is the low half of the uuid; a null id has the high half 1."""
    return f"<urn:uuid:{uuid.UUID(int=1 << 64 if page_id is None else page_id % (1 << 64))}>"


def urn_id(urn: str | None) -> int | None:
    """The page id in a record's id; None for ids that others have given."""
    try:
        n = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def encode_record(page_id: int | None, url: str | None, payload: bytes, size: int, sha: str, refers_to: int | None) -> bytes:
    """One gzip member. refers_to: for a revisit, whose block is the HTTP head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {_EPOCH}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one after the other."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(chunk):
        rest = b""
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            rest, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("the archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")  # a line may be folded
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _agrees(told: str | None, data: bytes) -> bool:
    """Whether data has the digest that a field tells, in base32 or hexadecimal; one that isn't told, or of an unknown kind, counts."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    own = hashlib.new(kind.lower(), data).digest()
    return value.rstrip("=").upper() in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


#: Records whose block is an HTTP message.
HTTP_RECORDS = ("response", "revisit", "request")


def decode_record(data: bytes) -> dict:
    """The parts of a record of any type. Digests are verified where they are told; a response's length where HTTP tells it."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    f = _fields(head)
    n, kind, name = int(f["content-length"]), f.get("warc-type", "unknown"), f.get("warc-record-id")
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or not _agrees(f.get("warc-block-digest"), block):
        raise ValueError(f"record {name}: its block doesn't verify")
    http, between, payload = block.partition(b"\r\n\r\n") if kind in HTTP_RECORDS and not f.get("content-type", "application/http").startswith("text/") else (b"", b"", block)
    told = _fields(http).get("content-length") if between else None
    size = int(told) if told and told.isdigit() and kind != "request" else len(payload)
    if kind == "response" and (len(payload) != size or not _agrees(f.get("warc-payload-digest"), payload)):
        raise ValueError(f"record {name}: its payload doesn't verify")
    sha = f.get("warc-payload-digest", "").removeprefix("sha1:") or (None if kind == "revisit" else digest(payload))
    return {"id": urn_id(name), "record_id": name, "url": f.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": urn_id(f.get("warc-refers-to")) if kind == "revisit" else None}


def _filesystem(uri: str):
    """(filesystem, path); pyarrow opens local, HDFS and object-store locations on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, revisit_from: int = 0) -> DataFrame:
    """The manifest (archive, records, bytes), already written. revisit_from: payloads of fewer bytes are all responses."""
    folder = folder or new_path(pages.sparkSession, "warc")
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), raw.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"))
    firsts = cut(rows.where(F.col("size") >= revisit_from).groupBy(F.col("sha").alias("of_sha"), F.col("size").alias("of_size")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    tied = rows.join(firsts, (F.col("sha") == F.col("of_sha")) & (F.col("size") == F.col("of_size")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    out = tied.select("id", "url", "size", "sha", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        sink, name, records, size = None, "", 0, 0
        done = []
        for b in batches:
            for page_id, url, n, sha, to, payload in zip(b["id"], b["url"], b["size"], b["sha"], b["refers_to"], b["payload"], strict=True):
                if sink is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)  # by the name it would compress again
                known = None if pd.isna(page_id) else int(page_id)
                data = encode_record(known, url, payload or b"", int(n), base64.b32encode(bytes.fromhex(sha)).decode(), None if pd.isna(to) else int(to))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    done.append((f"{folder}/{name}", records, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", records, size))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    whole = out.withColumn("id", F.col("id").cast("decimal(20,0)")).withColumn("refers_to", F.col("refers_to").cast("decimal(20,0)"))  # longs with nulls would become floats
    return cut(whole.mapInPandas(archives, "archive string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the manifest's archives: id, record_id, url, payload (if asked for; revisits have none),
    payload_bytes, payload_digest, record_type, refers_to. Archives of others are read too: their manifest has NULL for records,
    and their records' ids are in record_id alone."""
    n = max(1, manifest.count())
    columns = ["id", "record_id", "url", *(["payload"] if payloads else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"id": "decimal(20,0)", "record_id": "string", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "decimal(20,0)"}

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for b in batches:
            for archive, expected in zip(b["archive"], b["records"], strict=True):
                fs, path = _filesystem(archive)
                some, held, seen = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        r = decode_record(data)
                        some.append([Decimal(r[c]) if c in ("id", "refers_to") and r[c] is not None else r[c] for c in columns])
                        held, seen = held + len(data) * payloads, seen + 1
                        if held >= 8 << 20 or len(some) >= 10_000:
                            yield pd.DataFrame(some, columns=columns)
                            some, held = [], 0
                if not pd.isna(expected) and seen != expected:
                    raise ValueError(f"{archive}: {seen} records, {expected} expected")
                yield pd.DataFrame(some, columns=columns)

    out = manifest.repartition(n).mapInPandas(records, ", ".join(f"{c} {kinds[c]}" for c in columns))
    return out.withColumn("id", F.col("id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
