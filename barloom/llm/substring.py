"""Substring dedup by relative Lempel-Ziv factors.

The reference is the text of all documents: every run of `words` consecutive words (a window) is indexed by its
first document and place, in blocks by hash. A document is parsed against every block, greedily from the left: a
factor begins at a window that an earlier document holds and is extended, window by window, as long as the index
names the next place of the same document, so that a factor is a passage of its reference. Where the next window's first
place is elsewhere, the factor ends and the next one begins at that window: the two overlap by `words` - 1
words, and no duplicate window is lost at a factor boundary. Words inside factors are removed.

Windows are told apart by 96 bits of hash; a document finds those it is told of among its own by 64. Only windows that
can match are looked up. The smallest hash among a window's 6-word runs is its anchor (48 bits travel): equal windows have
equal anchors, so a window whose anchor no other document has is in no other document.

Edge cases: null and empty texts have no words; texts shorter than a window have no factors. Rows of one id
are one document: a repeated row isn't earlier than itself. Rows with a null id are neither references nor
factored. Windows repeated within one document are not duplicates of each other. Extra columns pass through,
whatever their names; _n_words, _n_removed, _factors and _kept replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, gram_hashes, tidy, word_hashes
from .exchange import HIGH, PACKED, buckets, from_planes, held_by_others, packing

ANCHOR = 6
#: an anchor's bits that travel: an anchor that only seems shared costs a look-up, and changes no result
SENT = np.uint64(0xFFFFFFFFFFFF0000)
#: for the further bits of a window's hash
CHECK = np.uint64(0xD6E8FEB86659FD93)
#: a factor's place, length, reference document and place there, in words
FACTORS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("reference", T.LongType()), T.StructField("at", T.LongType())]))
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("reference", pa.int64()), ("at", pa.int64())]))
OUT = ["_n_words", "_n_removed", "_factors", "_kept"]


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def anchors(hashes: np.ndarray, words: int) -> np.ndarray:
    """Every window's anchor."""
    grams = gram_hashes(hashes, ANCHOR)
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, words - ANCHOR + 1):
        np.minimum(out, grams[j : j + n], out=out)
    return out & SENT


def parse(at: np.ndarray, reference: np.ndarray, place: np.ndarray, words: int) -> list[dict]:
    """Factors, from the places of duplicate windows and the documents and places that the index names."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (reference[1:] != reference[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.r_[cut[1:], len(at)] - 1
    return [{"start": int(at[a]), "n_words": int(at[z] - at[a] + words), "reference": int(reference[a]), "at": int(place[a])} for a, z in zip(cut, last, strict=True)]


def factor(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 13) -> DataFrame:
    """`df` with _n_words, _n_removed, _factors and _kept (the words outside factors, joined by a space)."""
    n = buckets(df)
    keep = [c for c in df.columns if c not in OUT]
    owner, live_owner, live, dup_owner, dup_keys, dup_tags, dup_firsts = fresh(df, "_owner", "_live_owner", "_live", "_dup_owner", "_dup_keys", "_dup_tags", "_dup_firsts")
    # both joins read all columns, so that Spark sends the texts to their ids once
    docs = df.select(*keep, F.col(key).cast("long").alias(owner))
    first = docs.mapInArrow(packing(lambda t: np.unique(anchors(word_hashes(split(t)), words)), [owner, text], n, True), PACKED)
    alive = held_by_others(first, n, tell_first=True).select(F.col("owner").alias(live_owner), F.col("keys").alias(live))

    def windows(t: str | None, live: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        if not live:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        hashes = word_hashes(split(t))
        at = np.flatnonzero(np.isin(anchors(hashes, words), from_planes(live, np.uint64)))
        return gram_hashes(hashes, words)[at], (gram_hashes(hashes, words, CHECK)[at] >> HIGH << HIGH) | at.astype(np.uint64)

    some = docs.join(alive, F.col(owner) == F.col(live_owner), "left")
    second = some.mapInArrow(packing(windows, [owner, text, live], n, False), PACKED)
    found = held_by_others(second, n, tell_first=False)
    found = found.select(*(F.col(a).alias(b) for a, b in zip(("owner", "keys", "tags", "firsts"), (dup_owner, dup_keys, dup_tags, dup_firsts), strict=True)))
    rows = docs.join(found, F.col(owner) == F.col(dup_owner), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out = []
            for t, keys, tags, firsts in zip(*(batch[c].to_pylist() for c in (text, dup_keys, dup_tags, dup_firsts)), strict=True):
                w = split(t)
                if not keys:
                    out.append((len(w), 0, [], b" ".join(w).decode()))
                    continue
                dup, place, reference = from_planes(keys, np.uint64), from_planes(tags, np.int64), from_planes(firsts, np.int64)
                order = np.lexsort((place, reference, dup))
                dup, place, reference = dup[order], place[order], reference[order]
                grams = gram_hashes(word_hashes(w), words)
                at = np.minimum(np.searchsorted(dup, grams), len(dup) - 1)
                hit = dup[at] == grams
                start = np.flatnonzero(hit)
                factors = parse(start, reference[at[start]], place[at[start]], words)
                edge = np.zeros(len(w) + 1, np.int64)
                for f in factors:
                    edge[f["start"]] += 1
                    edge[f["start"] + f["n_words"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out.append((len(w), int(gone.sum()), factors, b" ".join([x for x, g in zip(w, gone, strict=True) if not g]).decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _FACTOR, pa.string()), strict=True))], names=[*keep, *OUT])

    types = (T.LongType(), T.LongType(), FACTORS, T.StringType())
    return rows.mapInArrow(tidy(run), T.StructType([*df.select(keep).schema.fields, *(T.StructField(c, t) for c, t in zip(OUT, types, strict=True))]))
