"""WARC archives, and records as a chunked table.

Records are written as gzip members of .warc.gz files in the shared folder, a file a task; a manifest names the files
of the tasks that succeeded. Reading streams each member in bounded pieces and gives rows (record_id, chunk_no, ...):
an oversized payload is many rows, each with the digest of the payload up to and with its chunk, so no record is ever
whole in memory on the way back.

Of records with equal payloads of at least `least` bytes, that with the smallest id is a response, the others are
revisits that name it and carry no payload.

Defined results: a null payload is empty; payloads below the limit are all responses; rows that repeat the smallest id
are responses too; a row without an id is a record too, and revisits an equal one that has an id; a null address is
left out; an empty table gives no rows and no files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir, written

CHUNK = 1 << 18
LEAST = 100
#: Rows of (digest, id) that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 100_000
_NAME = "urn:quillspark:record:"
SCHEMA = "archive string, record_id string, record_type string, uri string, refers_to string, chunk_no int, n_bytes long, data binary, digest string, last boolean, payload_bytes long, payload_digest string"


def _open(folder: str):
    from pyarrow import fs

    folder = re.sub("^s3[an]://", "s3://", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri(folder.removeprefix("file:")) if folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def qualified(spark, folder: str) -> str:
    """The folder with its scheme: where Spark's default file system is not the local one, a bare path lies in that."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return folder if ":" in folder.split("/")[0] or default.startswith("file:") else default.rstrip("/") + folder


def record_head(name: str, kind: str, uri: str | None, refers_to: str | None, size: int, digest: str) -> bytes:
    """All of a record before its payload: the WARC fields, an empty line, the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Target-URI: {' '.join(uri.split())}"] if uri else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def record(packer, head: bytes, data, size: int) -> Iterator[bytes]:
    """A record's gzip member in pieces. data: the payload as an Arrow scalar, or None."""
    yield packer.compress(head)
    if data is not None:
        view = memoryview(data.as_buffer())
        for at in range(0, size, CHUNK):
            yield packer.compress(view[at : at + CHUNK])
    yield packer.compress(b"\r\n\r\n")
    yield packer.flush()


def write(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, least: int = LEAST, folder: str | None = None) -> DataFrame:
    """Writes a record for each row; returns the manifest (archive string, records long, bytes long), itself written."""
    spark = df.sparkSession
    prepare(spark)
    folder = qualified(spark, folder or shared_dir(spark, "warc"))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, "firsts")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        records = total = 0
        for b in batches:
            for i, uri, data, size, digest, first in zip(*(b.column(c) for c in ("id", "uri", "payload", "size", "digest", "first"))):
                if out is None:
                    system, path = _open(folder)
                    system.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                i, uri, size, digest, first = i.as_py(), uri.as_py(), size.as_py(), digest.as_py(), first.as_py()
                kind = "revisit" if first is not None and first != i else "response"
                own = _NAME + (f"{i}" if i is not None else f"none-{uuid.uuid4().hex}")
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in record(packer, record_head(own, kind, uri, f"{_NAME}{first}", size, digest), data if kind == "response" else None, size):
                    out.write(piece)  # at once, so that no record's compressed form is held either
                    total += len(piece)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [total]})

    return written(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def _inflated(stream, limit: int = CHUNK) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the inflated members of a gzip stream, at most so long, and whether one ends a member."""
    opener, data = zlib.decompressobj(31), b""
    begun = False
    while data or (data := stream.read(limit)):
        begun = True
        piece = opener.decompress(data, limit)
        data = opener.unconsumed_tail or opener.unused_data
        if opener.eof:
            yield piece, True
            opener, begun = zlib.decompressobj(31), False
        elif piece:
            yield piece, False
    if begun:
        raise ValueError("an archive ends inside a record")


def chunks(stream, archive: str = "", limit: int = CHUNK) -> Iterator[dict]:
    """Rows of the chunked record table, from one archive's stream."""
    held, row, left, sha = b"", None, 0, None
    for piece, ends in _inflated(stream, limit):
        held += piece
        if row is None:
            if (cut := held.find(b"\r\n\r\n")) < 0 or (http := held.find(b"\r\n\r\n", cut + 4)) < 0:
                if ends:
                    raise ValueError(f"a record without a head in {archive}")
                continue
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in held[:cut].decode().split("\r\n")[1:])}
            heads = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in held[cut + 4 : http].decode().split("\r\n")[1:])}
            left = int(fields["content-length"]) - (http - cut)
            row = {
                "archive": archive, "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "chunk_no": -1,
                "payload_bytes": int(heads["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
            }
            sha, held = hashlib.sha256(), held[http + 4 :]
        while row["chunk_no"] < 0 and not left or left and (len(held) >= min(limit, left)):
            data, held = held[: min(limit, left)], held[min(limit, left) :]
            left -= len(data)
            sha.update(data)
            row["chunk_no"] += 1
            yield row | {"n_bytes": len(data), "data": data, "digest": sha.hexdigest(), "last": not left}
        if ends:
            if left or row["record_type"] == "response" and sha.hexdigest() != row["payload_digest"]:
                raise ValueError(f"record {row['record_id']} of {archive} is not whole")
            row, held = None, b""


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives, an archive a task at most."""
    spark = manifest.sparkSession
    prepare(spark)
    schema = SCHEMA if with_data else SCHEMA.replace("data binary, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        types = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], types)

        for b in batches:
            for archive in b.column(0).to_pylist():
                folder, _, name = archive.rpartition("/")
                system, path = _open(folder)
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for r in chunks(stream, archive):
                        rows.append(r)
                        size += r["n_bytes"] if with_data else 0
                        if len(rows) >= 2000 or size >= 16 * CHUNK:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("archive").repartition(n).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "url")
    last = read(manifest, with_data=False).where("last")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(_NAME) + 1}) as bigint)")
    digest = F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("payload_digest"))
    return last.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), (F.col("chunk_no") + 1).alias("n_chunks"))
