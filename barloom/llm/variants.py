"""Spelling variants: words one edit apart, by range reporting in two orders at once.

Sort the words of one length by their beginnings (forward order) and by their ends (reverse order). Two words that
differ at place i agree in the i code points before it, so both lie in one interval of the forward order, and in the
code points behind it, so both lie in one interval of the reverse order. A wavelet tree over the reverse ranks in forward
order reports the words in both intervals. Words of a length ask about themselves (replacement), those that are
one shorter ask too (insertion; a deletion is the same pair seen from the other side). What is reported is exact.

At any place either the half before it or the half behind it is left whole, so words meet in groups by length and
first half, and by length and last half: an index of one length holds some thousands of words, whatever the vocabulary.
Of a group of over `GROUP` words (a common half), each place is a key by itself: the code points before and behind it. Its
words then meet only those that they are near to: the same pairs, spread over many keys.

Edge cases: null words and null counts take no part; a word given twice counts once, with its largest count. The empty word
is near to words of one code point. A word with code point 0 is near to none. Words of any length are compared whole. An
empty table gives no rows. Extra columns don't matter: only word and n are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: words of a group of one half, and of an index, at most; questions answered at once; distinct words that a task holds
GROUP, INDEX, QUESTIONS, HELD = 20_000, 50_000, 200_000, 200_000
LAST = 0x10FFFF
RUN = re.compile(rb"[a-z\xc0-\xff]+")


def edited_words(df: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 97) -> DataFrame:
    """(word, n): how often each run of letters occurs in all texts, after one code point of some is left out.

    A run `[A-Za-z\\u00C0-\\u00FF]+`, lower-cased in A-Z, loses the code point h % length where `one_in` divides h, the unsigned crc32 of
    `<key>:<run>`. Null texts have no runs; a row with a null key loses nothing. Tasks count before they send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                # all code points of a run are one byte in this encoding; others become a question mark, which ends a run
                found = Counter(RUN.findall(t.encode("latin-1", "replace").lower())) if t else {}
                start = None if k is None else zlib.crc32(f"{k}:".encode())
                for w, n in found.items():
                    if start is not None and (h := zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)) % one_in == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]  # noqa: PLW2901
                    seen[w] += n
            if len(seen) >= HELD:
                yield counted()
                seen.clear()
        if seen:
            yield counted()

    parts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Values 0 to n - 1, each once, in some order: which of them in a range of places lie in a range of values?

    A level a bit, from the highest: values with the bit unset go left, the others right, each in order; a count of
    the unset bits before each place leads from a range of places to its two ranges on the next level.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros, self.split = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            self.split.append(int((~one).sum()))
            values = np.r_[values[~one], values[one]]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, value) for all questions: places from left to right and values from low to high, without the ends."""
        question, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            half = 1 << (self.bits - 1 - level)
            a, z = zeros[left], zeros[right]
            question, base = np.r_[question, question], np.r_[base, base + half]
            left, right = np.r_[a, split + left - a], np.r_[z, split + right - z]
            some = (left < right) & (base < high[question]) & (base + half > low[question])
            question, base, left, right = question[some], base[some], left[some], right[some]
        return question, base


def _beginnings(words: np.ndarray, n: int, fill: int) -> np.ndarray:
    """The first n code points of words of one length, filled up."""
    points = words.view(np.uint32).reshape(len(words), -1)
    out = np.full_like(points, fill)
    out[:, :n] = points[:, :n]
    return out.view(words.dtype).ravel()


def _mirrored(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.view(np.uint32).reshape(len(words), -1)[:, ::-1]).view(words.dtype).ravel()


def _shared(sorted_: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The longest beginning that each word shares with some word of `sorted_` other than itself."""
    points, own = (x.view(np.uint32).reshape(len(x), -1) for x in (sorted_, words))
    at, end = np.searchsorted(sorted_, words), np.searchsorted(sorted_, words, side="right")
    out = np.zeros(len(words), np.int64)
    for near in (at - 1, end):
        some = np.flatnonzero((near >= 0) & (near < len(sorted_)))
        differ = points[near[some]] != own[some]
        out[some] = np.maximum(out[some], np.where(differ.any(axis=1), differ.argmax(axis=1), points.shape[1]))
    return out


def near_in_index(index: np.ndarray, words: np.ndarray, size: int, insertion: bool, places: range) -> tuple[np.ndarray, np.ndarray]:
    """(i, near): words of `index` that come of word i by one replacement (or `insertion`) at one of `places`.

    Places are counted from 0; an insertion at a place comes before what is there. All words of `index` have `size` code
    points, and those of `words` as many, or one fewer for insertions. A word isn't near to itself.
    """
    index = np.sort(index)
    mirrored = _mirrored(index)
    reverse = np.argsort(mirrored, kind="stable")
    rank = np.empty(len(index), np.int64)
    rank[reverse] = np.arange(len(index))
    tree, mirrored = WaveletTree(rank), mirrored[reverse]
    ahead_of, behind_of = words.astype(index.dtype), _mirrored(words).astype(index.dtype)  # filled up behind
    ahead, behind = _shared(index, ahead_of), _shared(mirrored, behind_of)
    at = np.minimum(np.searchsorted(index, ahead_of), len(index) - 1)
    itself = np.where(index[at] == words, at, -1)
    found = [np.empty(0, np.int64)]
    for place in places:
        rest = size - 1 - place  # code points behind the place
        some = np.flatnonzero((ahead >= place) & (behind >= rest))
        for part in (some[a : a + QUESTIONS] for a in range(0, len(some), QUESTIONS)):
            ends = []
            for order, asked, n in ((index, ahead_of, place), (mirrored, behind_of, rest)):
                ends += [np.searchsorted(order, _beginnings(asked[part], n, 0)), np.searchsorted(order, _beginnings(asked[part], n, LAST), side="right")]
            question, value = tree.report(*ends)
            i, j = part[question], reverse[value]
            found.append((i * len(index) + j)[insertion | (itself[i] != j)])
    i, j = np.divmod(np.unique(np.concatenate(found)), len(index))
    return i, index[j]


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of one index: rows of one side and size, and the words that ask."""
    side, size = pdf["side"].iat[0], int(pdf["size"].iat[0])
    first = (size - 1) // 2
    places = range(first, size) if side == "f" else range(first)
    index = np.array(pdf.loc[pdf["held"], "word"].tolist(), f"U{size}")
    out = []
    for n, insertion in ((size, False), (size - 1, True)):
        words = np.array(pdf.loc[pdf["held"] != insertion, "word"].tolist(), f"U{max(n, 1)}")
        if len(index) and len(words):
            i, near = near_in_index(index, words, size, insertion, places)
            out.append(pd.DataFrame({"word": words[i], "near": near}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "near": []})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): the distinct words that differ by one inserted, deleted or replaced code point, both ways."""
    key, first = ["side", "size", "half"], F.floor((F.col("size") - 1) / 2).cast("int")
    words = words.select("word").where("word is not null and instr(word, '\\0') = 0").distinct()
    asks = F.array(F.struct(F.char_length("word").alias("size"), F.lit(True).alias("held")), F.struct((F.char_length("word") + 1).alias("size"), F.lit(False).alias("held")))
    posts = words.select("word", F.explode(asks).alias("a")).where("a.size > 0").select("word", "a.size", "a.held")
    halves = F.array(F.struct(F.lit("f").alias("side"), F.substring(F.col("word"), F.lit(1), first).alias("half")), F.struct(F.lit("b").alias("side"), F.right(F.col("word"), F.col("size") - first).alias("half")))
    posts = posts.select("word", "size", "held", F.explode(halves).alias("h")).select("word", "held", "size", "h.side", "h.half").where("side = 'f' or size > 2")
    posts = written(posts)
    groups = written(posts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("any")).where("n > 1 and any").drop("any"))

    small = groups.where(F.col("n") <= GROUP)
    parts = small.groupBy("side", "size").agg(F.ceil(F.sum("n") / INDEX).cast("int").alias("parts"))
    dealt = posts.join(small.drop("n"), key).join(parts, ["side", "size"]).withColumn("part", F.pmod(F.xxhash64("half"), F.col("parts")).cast("int"))
    found = dealt.groupBy("side", "size", "part").applyInPandas(_search, "word string, near string")

    crowded = posts.join(groups.where(F.col("n") > GROUP).drop("n"), key)
    crowded = crowded.select("word", "size", "held", F.explode(F.when(F.col("side") == "f", F.sequence(first, F.col("size") - 1)).otherwise(F.sequence(F.lit(0), first - 1))).alias("place"))
    before, behind = F.substring(F.col("word"), F.lit(1), F.col("place")), F.substring(F.col("word"), F.col("place") + F.when(F.col("held"), 2).otherwise(1), F.char_length("word"))
    crowded = crowded.select("word", "size", "held", "place", F.sha2(F.concat(before, F.lit("\0"), behind), 256).alias("rest"))
    exact = crowded.join(crowded.where("held").select(F.col("word").alias("near"), "size", "place", "rest"), ["size", "place", "rest"]).where("word <> near").select("word", "near")

    both = written(found.unionByName(exact))
    return both.unionByName(both.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of `counts` (word, n).

    A word's form is its near word of largest n, of equals the smallest, if that n is at least `ratio` times the word's
    own; else null. Its root is where forms lead to, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their words, so that they end")
    counts = written(counts.where("word is not null and n is not null").groupBy("word").agg(F.max("n").alias("n")))
    near = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("b"))
    out = counts.join(best, "word", "left").withColumn("form", F.when(F.col("b.near_n") >= F.col("n") * ratio, F.col("b.near")))
    out = written(out.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("b.near_n")).alias("form_n")))
    # each form is at least twice as common as its word: no circles, and 63 forms lead from 1 to the largest count
    ways = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return out.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
