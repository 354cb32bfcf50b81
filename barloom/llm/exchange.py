"""Which keys do several owners hold, and who holds each first? Keys travel as packed arrays.

A document has hundreds of 64-bit keys (anchors, windows, signature values). One row per key would
cost more in row overhead than in keys, so every Arrow batch is reduced first: a key goes out once
per batch, with its smallest owner in that batch, whatever the number of copies. A key that a third
of all rows hold so reaches its bucket once per batch. Keys may have tags: 32 more bits of the key and its
32-bit place in the owner. Equal keys with unequal bits are different keys. Keys, tags and firsts travel as planes of bytes.
Owners are told their keys without the bits: among one owner's keys, 64 bits tell enough.

Keys meet in the bucket of their hash; what is found goes, packed, to the owners' buckets. A task holds one
bucket in memory at a time. There are as many buckets as shuffle partitions, or more where the input is large for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tasks, tidy

PACKED = "bucket int, known boolean, owners binary, sizes binary, keys binary, tags binary, firsts binary"
NOTES = "owner long, keys binary, tags binary, firsts binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("owners", "sizes", "keys", "tags", "firsts"))])
_NOTES = pa.schema([("owner", pa.int64()), ("keys", pa.binary()), ("tags", pa.binary()), ("firsts", pa.binary())])
#: keys packed together; bytes of input (as Spark estimates it) for one bucket at most
FLUSH, BUCKET_BYTES = 2_000_000, 32 << 20
LOW = np.uint64(0xFFFFFFFF)
HIGH = np.uint64(32)


def planes(x: np.ndarray) -> bytes:
    """64-bit values by the place of their bytes: places and ids have leading zeros, which so lie together and shrink on their way."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def buckets(df: DataFrame) -> int:
    """A multiple of the shuffle partitions; Spark's estimate of a table without statistics is no size at all."""
    n = tasks(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n * (min(64, max(1, -(-size // (n * BUCKET_BYTES)))) if size < 1 << 60 else 1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _sorted(owner: np.ndarray, key: np.ndarray, tag: np.ndarray | None) -> tuple:
    """Entries by key, then owner, each pair once; per entry the place of its key's first entry, and whether others hold the key."""
    order = np.lexsort((owner, key) if tag is None else (tag & LOW, owner, tag >> HIGH, key))
    owner, key, tag = owner[order], key[order], None if tag is None else tag[order]
    full = (key,) if tag is None else (key, tag >> HIGH)
    once = _starts(*full, owner)
    owner, key, tag = owner[once], key[once], None if tag is None else tag[once]
    starts = _starts(key) if tag is None else _starts(key, tag >> HIGH)
    sizes = np.diff(np.r_[starts, len(key)])
    return owner, key, tag, np.repeat(starts, sizes), np.repeat(sizes > 1, sizes)


def _told(owner: np.ndarray, key: np.ndarray, tag: np.ndarray | None, first: np.ndarray, some: np.ndarray, n: int) -> list[tuple]:
    """Packed rows for the owners of `some` entries: the keys alone, or with tags also place and owner of the first entry."""
    if tag is None:
        return _homeward(owner[some], key[some], None, None, n)
    at = first[some]
    return _homeward(owner[some], key[some], tag[at] & LOW, owner[at], n)


def _homeward(owner: np.ndarray, key: np.ndarray, tag: np.ndarray | None, first: np.ndarray | None, n: int) -> list[tuple]:
    """Packed rows for the owners' own buckets."""
    home = owner % n
    order = np.lexsort((owner, home))
    owner, home = owner[order], home[order]
    cuts = np.r_[_starts(home), len(home)]
    rows = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        starts = _starts(owner[a:z])
        part = order[a:z]
        sizes = np.diff(np.r_[starts, z - a]).astype(np.int32)
        rows.append((int(home[a]), True, owner[a:z][starts].tobytes(), sizes.tobytes(), planes(key[part]), b"" if tag is None else planes(tag[part]), b"" if first is None else planes(first[part])))
    return rows


def pack(owner: np.ndarray, key: np.ndarray, tag: np.ndarray | None, n: int, tell_first: bool) -> Iterator[pa.RecordBatch]:
    """The batch's keys for their buckets, each once, and what the batch knows by itself."""
    owner, key, tag, first, shared = _sorted(owner, key, tag)
    lead = first == np.arange(len(first))
    rows = _told(owner, key, tag, first, np.flatnonzero(shared & (tell_first | ~lead)), n)
    owner, key, tag = owner[lead], key[lead], None if tag is None else tag[lead]
    home = ((key >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((owner, home))
    owner, key, home, tag = owner[order], key[order], home[order], None if tag is None else tag[order]
    cuts = np.r_[_starts(home), len(home)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        starts = _starts(owner[a:z])
        sizes = np.diff(np.r_[starts, z - a]).astype(np.int32)
        rows.append((int(home[a]), False, owner[a:z][starts].tobytes(), sizes.tobytes(), planes(key[a:z]), b"" if tag is None else planes(tag[a:z]), b""))
    yield from _batch(rows)


def packing(keys_of, columns: list[str], n: int, tell_first: bool):
    """A mapInArrow function: packed keys of every row that has an id, the first of `columns`.

    `keys_of` makes keys, or keys and tags, from the other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, keys, tags, held = [], [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            yield from pack(np.concatenate(owners), np.concatenate(keys), np.concatenate(tags) if tags else None, n, tell_first)

        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            for owner, *rest in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if owner is None:
                    continue
                found = keys_of(*rest)
                found, tag = found if isinstance(found, tuple) else (found, None)
                if not len(found):
                    continue
                owners.append(np.full(len(found), owner, np.int64))
                keys.append(found)
                if tag is not None:
                    tags.append(tag)
                held += len(found)
                if held >= FLUSH:
                    yield from packed()
                    owners, keys, tags, held = [], [], [], 0
        if held:
            yield from packed()

    return tidy(run)


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _entries(rows: list[dict]) -> tuple:
    """Owner, key, tag and first of every entry; the last two are None where there are none."""
    joined = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
    keys, tags, firsts = (np.concatenate([from_planes(r[c], kind) for r in rows]) for c, kind in (("keys", np.uint64), ("tags", np.uint64), ("firsts", np.int64)))
    return np.repeat(joined("owners", np.int64), joined("sizes", np.int32)), keys, tags if len(tags) else None, firsts if len(firsts) else None


def by_bucket(settle):
    """A mapInArrow function that gives `settle` the rows of one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for r in batch.to_pylist():
                if rows and rows[0]["bucket"] != r["bucket"]:
                    yield from settle(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from settle(rows)

    return tidy(run)


def notes(rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Of one owner bucket's rows: owners, where each one's entries start (and the last end), keys, tags and firsts."""
    owner, key, tag, first = _entries(rows)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    starts = _starts(owner)
    yield owner[starts], np.r_[starts, len(owner)], key[order], None if tag is None else tag[order], None if first is None else first[order]


def deliver(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """One row for each owner."""
    for who, ends, keys, tags, firsts in notes(rows):
        for at in range(0, len(who), 5_000):
            part = range(at, min(at + 5_000, len(who)))
            cut = lambda x: pa.array([b"" if x is None else planes(x[ends[i] : ends[i + 1]]) for i in part], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(who[at : at + 5_000]), cut(keys), cut(tags), cut(firsts)], schema=_NOTES)


def held_by_others(packed: DataFrame, n: int, tell_first: bool, deliver=deliver, schema: str = NOTES) -> DataFrame:
    """Of rows as `pack` makes them for `n` buckets: (owner, keys, tags, firsts), the owner's keys that other owners hold too.

    Where keys have tags, `firsts` has the smallest owner known of each key, and the tag the place there. With `tell_first` unset, the smallest owner of a key isn't told of it. Every owner that is told gets
    one row, unless another `deliver` (of `schema`) makes something else of a bucket's rows.
    """

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if known := [r for r in rows if r["known"]]:
            yield from _batch(_homeward(*_entries(known), n))
        if met := [r for r in rows if not r["known"]]:
            owner, key, tag, first, shared = _sorted(*_entries(met)[:3])
            some = np.flatnonzero(shared & (tell_first | (first != np.arange(len(first)))))
            yield from _batch(_told(owner, key, tag, first, some, n))

    def sent(df: DataFrame) -> DataFrame:
        return df.repartition(tasks(df.sparkSession), "bucket").sortWithinPartitions("bucket")

    return sent(sent(packed).mapInArrow(by_bucket(settle), PACKED)).mapInArrow(by_bucket(deliver), schema)
