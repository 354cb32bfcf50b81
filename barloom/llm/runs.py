"""Periodic runs of words: harmonic grids of longest-common-extension queries.

A run is a stretch of consecutive words with smallest period p (words p apart are equal) that is at least `times`
periods and `least` words long and that no neighbouring word extends. For each period p the places p, 2p, 3p, ... of a
text are a grid: a run that is two periods long holds two neighbours of its grid, so the words that two neighbours
share to their right (forward extension) and to their left (backward extension) give every run's ends. Extensions are
minima of longest common prefixes between two places of a suffix array, of the words and of the reversed words; a
block-wise range-minimum table answers them without a walk. The texts of a batch share one array: each ends in a word of
its own, which no extension crosses. Periods go up to n / times, so a text of n words asks about n log n questions, and
those whose first words differ are answered without the array.

A stretch that has period p and a smaller one q has, at four periods' length, q dividing p, and both runs have the same
ends: of runs with the same ends the smallest period counts.

Edge cases: null and empty texts have no words and no runs, and collapse to an empty text. A repeated row has its own,
equal result. A text is never cut: a very long one is a batch by itself, whose memory grows with its words alone. An
empty table gives no rows. Extra columns pass through, whatever their names; _n_words, _runs and _collapsed replace
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

OUT = ["_n_words", "_runs", "_collapsed"]
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
#: words of a batch of texts that share an array; questions asked at once; places of a block of the range-minimum table
WORDS, QUESTIONS, BLOCK = 100_000, 1_000_000, 16


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, lcp) of the suffixes of `x`, whose last value occurs once; lcp[i] is between order[i - 1] and order[i].

    Prefixes double; only places that are not told apart yet are sorted again. Equal ranks of a round mean equal
    prefixes of its length, so the rounds, from the longest prefix down, give the longest common prefixes.
    """
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    head = np.r_[True, x[order[1:]] != x[order[:-1]]]
    first = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = first
    rounds, k = [rank.copy()], 1
    live = np.flatnonzero(~head | ~np.r_[head[1:], True])
    while len(live):
        who = order[live]
        key = rank[who].astype(np.int64) * n + rank[who + k]
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[live] = who
        head = np.r_[True, key[1:] != key[:-1]]
        rank[who] = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
        live = live[~head | ~np.r_[head[1:], True]]
        k *= 2
        rounds.append(rank.copy())
    lcp = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for at in range(len(rounds) - 1, -1, -1):
        # a unique last value ends every common prefix before the array does
        same = np.flatnonzero(rounds[at][a] == rounds[at][b])
        lcp[same + 1] += 1 << at
        a[same] += 1 << at
        b[same] += 1 << at
    return order, rank, lcp


class Extension:
    """How many values from two places on are equal, by range minima over a suffix array."""

    def __init__(self, x: np.ndarray):
        _, self.rank, lcp = suffix_array(x)
        blocks = -(-len(lcp) // BLOCK)
        tiled = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        tiled[: len(lcp)] = lcp
        tiled = tiled.reshape(blocks, BLOCK)
        self.lcp = tiled.ravel()
        self.left = np.minimum.accumulate(tiled, axis=1).ravel()  # from the block's start
        self.right = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()  # to the block's end
        self.table = [tiled.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a <> b."""
        p, q = self.rank[a], self.rank[b]
        low, high = np.minimum(p, q) + 1, np.maximum(p, q)
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.right[low], self.left[high])
        within = np.flatnonzero(first == last)
        if len(within):
            at, end = low[within], high[within]
            least = self.lcp[at]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.lcp[np.minimum(at + step, end)])
            out[within] = least
        between = last - first - 1
        level = np.frexp(np.maximum(between, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            some = np.flatnonzero((level == k) & (between > 0))
            out[some] = np.minimum(out[some], np.minimum(self.table[k][first[some] + 1], self.table[k][last[some] - (1 << k)]))
        return out


def _grid(starts: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all neighbours on all grids of all texts, some at a time: the place p behind is the neighbour."""
    periods = sizes // times
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = np.maximum((sizes[text] - 1) // period, 0)  # of j with (j + 1) p within the text
    ends = np.cumsum(count)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(QUESTIONS, ends[-1] if len(ends) else 0, QUESTIONS), side="right"), len(text)])
    for a, z in zip(cuts, cuts[1:], strict=False):
        c, p = count[a:z], period[a:z]
        j = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        each = np.repeat(p, c)
        yield np.repeat(starts[text[a:z]], c) + j * each, each


def find_runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """For every text, given as word numbers from 0: its runs as rows (start, length, period), by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    x = np.concatenate([np.r_[t, top + i] for i, t in enumerate(texts)]) if texts else np.empty(0, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ahead: Extension | None = None
    found = []
    for at, p in _grid(starts, sizes, times):
        same = x[at] == x[at + p]
        at, p = at[same], p[same]
        if not len(at):
            continue
        ahead = ahead or Extension(x)
        right = ahead(at, at + p)
        some = right > (times - 2) * p  # less than a period lies to the left of a run's first place on the grid
        if some.any():
            found.append(np.stack([at[some], p[some], right[some]], axis=1))
    if not found:
        return [np.empty((0, 3), np.int64) for _ in texts]
    at, p, right = np.concatenate(found).astype(np.int64).T
    # reversed words: what lies before a place comes after its mirror image. A last value of its own ends this array too.
    behind = Extension(np.r_[x[::-1], top + len(texts)])
    mirror = len(x) - at
    left = behind(mirror, mirror - p).astype(np.int64)
    begin, length = at - left, p + left + right
    whole = (left < p) & (length >= np.maximum(least, times * p))
    begin, length, p = begin[whole], length[whole], p[whole]
    order = np.lexsort((p, length, begin))
    begin, length, p = begin[order], length[order], p[order]
    once = np.r_[True, (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])][: len(begin)]
    begin, length, p = begin[once], length[once], p[once]
    order = np.lexsort((p, begin))
    rows = np.stack([begin, length, p], axis=1)[order]
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    rows[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def periodic_runs(df: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """`df` with _n_words, _runs (start, length, period) and _collapsed: the words, one period of each run, joined by a space.

    `times` is two or more: only then does a run hold two places of its grid.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    keep = [c for c in df.columns if c not in OUT]
    df = df.select(keep)

    def settle(rows: list[pa.RecordBatch], words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)) for ws in words]
        out = []
        for ws, runs in zip(words, find_runs(texts, least, times), strict=True):
            left = ws if not len(runs) else [w for w, gone in zip(ws, dropped(len(ws), runs).tolist(), strict=True) if not gone]
            out.append((len(ws), [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], b" ".join(left).decode()))
        columns = list(zip(*out, strict=True))
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), _RUN, pa.string()), strict=True)]
        done = 0
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(m.slice(done, batch.num_rows) for m in made)], names=[*keep, *OUT])
            done += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, held = [], [], 0
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            begin = 0
            for i, t in enumerate(batch[text].to_pylist()):
                words.append(t.encode().split() if t else [])
                held += len(words[-1]) + 1
                if held >= WORDS:
                    yield from settle([*rows, batch.slice(begin, i + 1 - begin)], words)
                    rows, words, held, begin = [], [], 0, i + 1
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if rows:
            yield from settle(rows, words)

    types = (T.LongType(), RUNS, T.StringType())
    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in zip(OUT, types, strict=True))]))
