"""Best-fit packing by exact-complement hashing.

Texts become pieces of at most `capacity` tokens. Only the number of pieces of each length (at most
`capacity` numbers) is planned with: for each length, from the longest, single lengths, pairs and triples that
fill its gap exactly are looked up by their sums and consumed as far as pieces are left; what remains is
packed best-fit, longest first. The plan is a list of patterns with multiplicities. Pieces then find their
places by rank within their length, counted by salted groups, so no length is gathered in one task.

Edge cases: a null text is empty and is one piece of the end token alone. Only texts longer than a sequence
are cut; their first piece may be shorter. Repeated rows are packed as often as they occur; null ids too. An
empty table gives no rows. Extra columns aren't returned.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import Encoder
from .common import tidy, written

SALTS = 64


@lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def json_encoder(path: str, ranks_path: str, pattern: str, special: list[str]):
    """Text to packed 32-bit ids, as the tokenizer's file has it; texts with a special token's string go to it whole.

    Chunks are encoded by the same vocabulary's rank file, which is several times as fast; the tests hold both against
    each other. A task loads the tokenizer itself only when it meets one of the `special` strings.
    """
    import tiktoken

    from .bpe import load_ranks

    fast = Encoder(tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}).encode_ordinary)

    def encode(text: str | None) -> bytes:
        if text and any(s in text for s in special):
            import numpy as np

            return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return fast(text)

    return encode


PIECES = "id long, piece int, start long, length int, ids_crc32 long"


def pieces(df: DataFrame, encoder, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """`encoder` makes, in a task, a function from text to packed ids."""
    end_bytes = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            out = []
            for key, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(t) + end_bytes
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(key, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with multiplicities that use every piece once."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> bool:
        need: dict[int, int] = defaultdict(int)
        for x in pattern:
            need[x] += 1
        times = min(left.get(x, 0) // n for x, n in need.items())
        if times:
            out.append((pattern, times))
            for x, n in need.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]
        return times > 0

    def fillers(gap: int, size: int, most: int) -> Iterator[tuple[int, ...]]:
        """Combinations of `size` lengths of at most `most` that sum to `gap`, found by the last one's complement."""
        if size == 1:
            if gap in left and gap <= most:
                yield (gap,)
            return
        for x in sorted((x for x in left if x <= min(most, gap - size + 1) and x * size >= gap), reverse=True):
            if x in left:
                for rest in fillers(gap - x, size - 1, x):
                    yield (x, *rest)

    for size in (0, 1, 2, 3):
        for n in sorted(left, reverse=True):
            if n in left:
                if size == 0:
                    if n == capacity:
                        consume((n,))
                    continue
                while n in left:  # what a combination leaves is looked up again
                    if not any(consume((n, *f)) for f in fillers(capacity - n, size, n)):
                        break
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            gap = min((g for g in bins if g >= n and bins[g]), default=None)
            if gap is None:
                per = min(capacity // n, c)
                times = c // per
                bins[capacity - n * per].append(((n,) * per, times))
                c -= per * times
                continue
            pattern, times = bins[gap].pop()
            fit = min(gap // n, c)
            used = min(times, c // fit)
            if used < times:
                bins[gap].append((pattern, times - used))
            bins[gap - fit * n].append((pattern + (n,) * fit, used))
            c -= fit * used
    return out + [x for group in bins.values() for x in group]


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = parts.sparkSession
    parts = written(parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each possible length
    slots, taken, first = [], defaultdict(int), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for x in pattern:
            slots.append((x, taken[x], taken[x] + times, first, offset))
            taken[x] += times
            offset += x
        first += times
    # the plan's size depends on the capacity alone: it has a row for each pattern and place
    table = spark.createDataFrame(slots, "length int, lo long, hi long, first long, offset long")
    sizes = parts.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "start")) - 1).join(F.broadcast(before), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(table), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
