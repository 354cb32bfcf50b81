"""WARC: monolithic gzip files, normalised to one member per record with a sidecar offset index.

`write` makes archives of one gzip stream each. `normalise` inflates each file once, whether it holds one gzip member
or several, rewrites every record as a member of its own, and writes the members' offsets to a sidecar file, which
`read_index` reads. `read_back` finds records by range reads. Of records with equal payloads the one with the
smallest id is a response; the others are revisits that name it.

Edge cases: archives of others may have any record types, header fields in any order and case, folded lines, and ids that are
no page's (read as null); their revisits may lack the payload's length (null). An archive that ends within a record or
a member is an error. A null payload counts as empty. A null id is written as a response of its own and refers to
nothing. Rows that repeat id and payload are responses alike. Records of any size are streamed one at a
time. An empty table writes no archive. Extra columns aren't written. A retried task writes new files; only
the successful attempt's are named by the tables.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tasks, tidy, written
from .media import Files, in_tasks

ARCHIVE_BYTES = 128 << 20
READ_BYTES = 1 << 20
#: parts of a payload that many pages share
SALTS = 64


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def header(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space goes on with the field before."""
    fields, name = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header(head)
    return fields, rest[: int(fields["content-length"])]


def page_of(urn: str | None) -> int | None:
    urn = (urn or "").strip("<>")
    return int(urn.removeprefix("urn:page:")) if urn.startswith("urn:page:") and urn.removeprefix("urn:page:").lstrip("-").isdigit() else None


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, one at a time."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                need = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("archive ends within a record")


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of all members, in pieces of bounded size."""
    unzip = None
    while data := stream.read(READ_BYTES):
        while data:
            if unzip is None:
                if not (data := data.lstrip(b"\0")):  # padding between members
                    break
                unzip = zlib.decompressobj(31)
            yield unzip.decompress(data, READ_BYTES)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, None
    while unzip is not None and not unzip.eof and (last := unzip.decompress(unzip.unconsumed_tail, READ_BYTES)):
        yield last
    if unzip is not None and not unzip.eof:
        raise ValueError("gzip stream is cut short")


def write(df: DataFrame, key: Column, url: Column, payload: Column, min_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Writes monolithic archives now; returns a written table of their paths (archive)."""
    root = root or shared_dir(df.sparkSession)
    pages = df.select(key.cast("long").alias("id"), url.cast("string").alias("url"), F.coalesce(payload.cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    small = pages.where(F.octet_length("payload") >= min_bytes).select("id", "sha")
    first = small.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    small = small.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = small.join(first, ["sha", "salt"]).where("id <> first").distinct().select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "first")
    rows = pages.join(again, (F.col("id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        out, zipped, size, done = None, None, 0, []

        def close() -> None:
            out.write(zipped.flush())
            out.close()

        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for r in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    done.append(f"{root}/{name}")
                    out, zipped, size = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                data = record(r["id"], r["url"], r["payload"].encode(), r["first"])
                out.write(zipped.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})

    return written(rows.mapInArrow(tidy(run), "archive string"))


INDEX = "archive string, offset long, length long, id long"


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites each archive, one task each; returns the index (archive, offset, length, id) of members, from the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch["archive"].to_pylist():
                system, path = fs.FileSystem.from_uri(source)
                tag = uuid.uuid4().hex
                target = f"{path.removesuffix('.warc.gz')}-{tag}.members.warc.gz"
                name = f"{source.removesuffix('.warc.gz')}-{tag}.members.warc.gz"
                offset = 0
                with system.open_input_stream(path, compression=None) as stream, system.open_output_stream(target, compression=None) as out, system.open_output_stream(f"{target}.index", compression=None) as index:
                    for data in records(_inflated(stream)):
                        zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = zipper.compress(data) + zipper.flush()
                        key = page_of(parse(data)[0].get("warc-record-id"))
                        out.write(member)
                        index.write(f"{offset} {len(member)} {'-' if key is None else key}\n".encode())
                        offset += len(member)
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name], pa.string())})

    return read_index(written(archives.select("archive").repartition(tasks(archives.sparkSession)).mapInArrow(tidy(run), "archive string")))


def read_index(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, id) of every member of normalised archives, from the sidecar files, read line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["archive"].to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_stream(f"{path}.index", compression=None) as stream:
                    rest = b""
                    while data := stream.read(READ_BYTES):
                        *lines, rest = (rest + data).split(b"\n")
                        rows = [line.split() for line in lines]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array([int(r[i]) for r in rows], pa.int64()) for i in (0, 1)), pa.array([None if r[2] == b"-" else int(r[2]) for r in rows], pa.int64())], names=["archive", "offset", "length", "id"])

    return archives.mapInArrow(tidy(run), INDEX)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(index: DataFrame) -> DataFrame:
    """One row for each indexed record. A response's payload is measured; a revisit says what its response has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                fields, block = parse(zlib.decompress(files.read(r["archive"], r["offset"], r["length"]), 31))
                kind = fields.get("warc-type", "").lower()
                if kind == "revisit":
                    size = fields.get("warc-payload-length")
                    rows.append((r["id"], None if size is None else int(size), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, kind, page_of(fields.get("warc-refers-to"))))
                else:
                    http = fields.get("content-type", "").lower().startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    rows.append((r["id"], len(payload), digest(payload), kind, None))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])
        files.close()

    return in_tasks(index, "archive", "offset").mapInArrow(tidy(run), READ)
