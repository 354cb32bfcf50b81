"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG of width 64, named by its SHA-256, in a tar shard in the shared
folder. Tasks store what they haven't stored yet without waiting for each other; of a digest's places the least is
the one that all its rows carry: digest, shard, offset and length. `headers` fills metadata columns by range reads
of the header alone; `read_back` reads the payloads' samples, in tasks of about equal bytes of payload.

Edge cases: a null payload counts as empty; an empty one is padded to 64 zero bytes. Equal payloads have
one stored form and equal values. An empty table writes no shard. Extra columns are left out of the rows.
A retried task writes new shards; only the successful attempt's rows name theirs.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tasks, tidy, written

WIDTH = 64
HEADER = 33  # signature and IHDR chunk
SHARD_BYTES = 64 << 20
#: bytes of stored payloads for a task that reads them; parts of a digest that many rows share
TASK_BYTES, SALTS = 32 << 20, 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # every line begins with filter type 0
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height, from the first HEADER bytes."""
    return struct.unpack(">II", header[16:24])


def from_png(data: bytes) -> bytes:
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    width, _ = png_size(data)
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and the share of zero samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    spread = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};zero={p[0]:.4f}"


STORED = "id long, n_bytes long, digest string, shard string, offset long, length long"


def store(df: DataFrame, key: Column, payload: Column, root: str | None = None) -> DataFrame:
    """Writes the shards now; returns (id, n_bytes, digest, shard, offset, length), read from a written table."""
    root = root or shared_dir(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        out, shard, at, places = None, "", 0, {}
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            rows = []
            for key, text in zip(batch["id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                raw = (text or "").encode()
                body = raw + bytes(-len(raw) % 64 if raw else 64)
                digest = hashlib.sha256(body).hexdigest()
                if not (place := places.get(digest)):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.tar"
                        out, shard, at = system.open_output_stream(f"{base}/{name}"), f"{root}/{name}", 0
                    data = to_png(body)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(data)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % 512))
                    place = places[digest] = (shard, at + 512, len(data))
                    at += 512 + len(data) + -len(data) % 512
                rows.append((key, len(raw), digest, *place))
                if at >= SHARD_BYTES:
                    out.write(bytes(1024))
                    out.close()
                    out, places = None, {}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["id", "n_bytes", "digest", "shard", "offset", "length"]) if rows else pa.RecordBatch.from_pylist([])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    rows = written(df.select(key.cast("long").alias("id"), payload.cast("string").alias("payload")).mapInArrow(tidy(run), STORED))
    place = F.struct("shard", "offset", "length")
    copied = rows.groupBy("digest").agg(F.min(place).alias("place"), F.max(place).alias("last")).where("place <> last").drop("last")
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = rows.withColumn("salt", F.pmod(F.xxhash64("id", "shard"), F.lit(SALTS)).cast("int")).join(copied, ["digest", "salt"], "left")
    return one.select("id", "n_bytes", "digest", *(F.coalesce(F.col("place")[c], F.col(c)).alias(c) for c in ("shard", "offset", "length")))


READ = "id long, n_bytes long, digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def in_tasks(df: DataFrame, *place: str) -> DataFrame:
    """Rows that point into files by `place`, dealt by it and then by id, so that a task reads about TASK_BYTES, in order."""
    df = written(df)
    n = (df.agg(F.sum("length").alias("n")).first()["n"] or 0) // TASK_BYTES + 1
    return df.repartitionByRange(max(n, tasks(df.sparkSession)), *place, "id").sortWithinPartitions(*place)


class Files:
    """The file that was read last, open for range reads."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if self.name != name:
            self.close()
            system, path = fs.FileSystem.from_uri(name)
            self.name, self.file = name, system.open_input_file(path)
        return bytes(self.file.read_at(length, offset))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def headers(stored: DataFrame) -> DataFrame:
    """`stored` with width and height, from the first bytes of each payload; nothing else is read. Tasks read shards in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, size = Files(), None, (0, 0)
        for batch in batches:
            found = []
            for at in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True):
                if at != last:
                    last, size = at, png_size(files.read(*at, HEADER))
                found.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], pa.int32()) for i in (0, 1))], names=[*batch.schema.names, "width", "height"])
        files.close()

    return in_tasks(stored, "shard", "offset").mapInArrow(tidy(run), f"{STORED}, width int, height int")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of the samples, from range reads of the whole payloads; equal places are read once in a row.

    Width and height are those that `headers` has read: rows without them get them first.
    """
    if "width" not in stored.columns:
        stored = headers(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, values = Files(), None, ()
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in READ.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (at := (r["shard"], r["offset"], r["length"])) != last:
                    data = files.read(*at)
                    body = from_png(data)
                    last, values = at, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(body))
                rows.append((r["id"], r["n_bytes"], r["digest"], *values, r["width"], r["height"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        files.close()

    return stored.mapInArrow(tidy(run), READ)  # in the tasks and order of the header pass
