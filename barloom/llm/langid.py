"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's likelihood is the
sum, over all ways to cut it into pieces, of the product of their probabilities (forward algorithm); a
text's is the product over its words. Piece probabilities are fitted by expectation maximisation over the
same sum, on a bounded sample of labelled rows.

Rows and edge cases: a null text, an empty text or one without a letter gives `und` and score 0. Repeated
rows give repeated results. Very long texts are scored whole; very long words are summed in
logarithms. An empty table gives no rows. Without labelled rows everything is `und`. Columns other than the
text (and, for fitting, the label) are never looked at, so clashing extra columns are harmless.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULT, mix, tidy

WORD = re.compile(r"[^\W\d_]+")
#: log probability of a UTF-8 byte that no piece covers, alike in every language
LOG_BYTE = -12.0
MEMO_WORDS = 200_000  # about 30 MB; with 60,000 scoring takes 1.4 times as long
#: texts scored together, cells of one array of partial sums, letters above which a word is summed in logarithms
SLICE_TEXTS, BLOCK_CELLS, LONG_WORD = 64, 400_000, 24
#: a sum below this is taken again in logarithms
LEAST = 1e-280


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model that hold letters only (and the word mark)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p.strip("▁").isalpha())


@dataclass(frozen=True)
class Arrays:
    """A model for tasks: hashes of the pieces and, by piece and language, their probabilities."""

    languages: tuple[str, ...]
    keys: np.ndarray
    p: np.ndarray
    longest: int


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: dict[str, tuple[float, ...]]  # probability by language
    longest: int

    def arrays(self) -> Arrays:
        p = np.array(list(self.pieces.values()), np.float64).reshape(len(self.pieces), len(self.languages))
        return Arrays(self.languages, piece_keys(list(self.pieces)), p, self.longest)


def piece_keys(pieces: list[str]) -> np.ndarray:
    """64-bit hashes of the pieces' characters, as `Scorer.pieces_in` makes them."""
    mult, out = int(MULT), []
    for piece in pieces:
        h = 0
        for c in piece:
            h = (h * mult + ord(c) + 1) % (1 << 64)
        out.append(h)
    return mix(np.array(out, np.uint64))


def letters(word: str) -> str:
    return "".join(c for c in word if unicodedata.category(c)[0] == "L")


def _matches(word: str, i: int, pieces: dict, longest: int, none: tuple) -> Iterator[tuple[int, tuple]]:
    found = False
    for j in range(i + 1, min(i + longest, len(word)) + 1):
        if p := pieces.get(word[i:j]):
            found = found or j == i + 1
            yield j, p
    if not found:  # a single character must always be possible
        byte = math.exp(LOG_BYTE * min(len(word[i].encode()), 4)) if word[i] != "▁" else 1.0
        yield i + 1, tuple(byte for _ in none)


def log_likelihood(word: str, model: Model) -> tuple[float, ...]:
    """Log of the sum over all segmentations of `word`, by language: one word at a time, as `Scorer` does for many."""
    word = "▁" + word
    k, n = len(model.languages), len(word)
    ahead: dict[int, list[float]] = {0: [1.0] * k}
    shift = [0.0] * k
    for i in range(n):
        here = ahead.pop(i)
        if i % 16 == 15:  # no underflow in long words
            shift = [s + math.log(a) for s, a in zip(shift, here, strict=True)]
            ahead = {j: [x / a for x, a in zip(v, here, strict=True)] for j, v in ahead.items()}
            here = [1.0] * k
        for j, p in _matches(word, i, model.pieces, model.longest, model.languages):
            if v := ahead.get(j):
                ahead[j] = [x + a * b for x, a, b in zip(v, here, p, strict=True)]
            else:
                ahead[j] = [a * b for a, b in zip(here, p, strict=True)]
    return tuple(s + math.log(a) for s, a in zip(shift, ahead[n], strict=True))


def fit(df: DataFrame, vocab: list[str], text: str = "text", lang: str = "lang", key: Column | None = None, docs_per_language: int = 1000, rounds: int = 2, smoothing: float = 0.5) -> Model:
    """Fit on a bounded sample: about `docs_per_language` rows of each label.

    Rows are chosen by a hash of `key`, so the sample doesn't depend on partitioning. Words of any length teach.
    """
    spark = df.sparkSession
    df = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (key if key is not None else F.xxhash64(text)).alias("key")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in df.groupBy("lang").count().collect()}  # one row for each label
    if not sizes:
        return Model((), {}, 1)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(docs_per_language) / n)]), F.col("lang"))
    sample = df.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for code, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found.update((code, w) for x in WORD.findall(t.lower()) if (w := letters(x)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    words = sample.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()
    languages = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
    longest, keys = max(map(len, vocab)), piece_keys(vocab)
    p = np.full((len(vocab), len(languages)), 1.0 / len(vocab))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Arrays(languages, keys, p, longest))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent.value)
            total = np.zeros((len(keys), len(languages)))
            for batch in batches:
                by_lang: dict[str, list[tuple[str, int]]] = defaultdict(list)
                for code, w, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
                    by_lang[code].append((w, n))
                for code, rows in by_lang.items():
                    at = languages.index(code)
                    for a in range(0, len(rows), scorer.block):
                        part = rows[a : a + scorer.block]
                        total[:, at] += scorer.expected([w for w, _ in part], np.array([n for _, n in part], np.float64), at)
            piece, at = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(at, pa.int32()), "piece": pa.array(piece, pa.int32()), "x": pa.array(total[piece, at])})

        # at most one row for each piece of the fixed vocabulary and language
        got = words.mapInArrow(tidy(expect), "lang int, piece int, x double").groupBy("lang", "piece").agg(F.round(F.sum("x"), 6).alias("x")).toArrow()
        p = np.full((len(vocab), len(languages)), smoothing)
        p[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["x"].to_numpy()
        p /= p.sum(axis=0)
        sent.destroy()
    return Model(languages, dict(zip(vocab, map(tuple, p.tolist()), strict=True)), longest)


class Scorer:
    """Log likelihoods of many words at once: the same sums as `log_likelihood`, one array step for each (start, end).

    Pieces are found by 64-bit hashes of the characters from each start on.
    """

    def __init__(self, model: Model | Arrays):
        self.model = model = model.arrays() if isinstance(model, Model) else model
        k = len(model.languages)
        # after the pieces: an uncovered character of 1, 2, 3 or 4 bytes, and the word mark
        rest = [[math.exp(LOG_BYTE * n)] * k for n in (1, 2, 3, 4)] + [[1.0] * k]
        self.p = np.concatenate([model.p, np.array(rest).reshape(5, k)])
        self.order = np.argsort(model.keys)
        self.keys = model.keys[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.block = max(256, BLOCK_CELLS // ((LONG_WORD + 2) * max(k, 1)))
        self.forget()

    def forget(self, room: int = 0) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((max(MEMO_WORDS, room) + 1, len(self.model.languages)))  # row 0: words without a letter

    def pieces_in(self, marked: list[str]) -> tuple[np.ndarray, ...]:
        """Word, start, end and row of every piece in every word, by start and end."""
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, marked), np.int64)
        word = np.repeat(np.arange(len(marked)), size)
        start = np.arange(len(chars)) - (np.cumsum(size) - size)[word]
        left = size[word] - start
        h, live, found = np.zeros(len(chars), np.uint64), np.arange(len(chars)), []
        for n in range(1, max(self.model.longest, 1) + 1):
            live = live[left[live] >= n]
            h[live] = h[live] * MULT + chars[live + (n - 1)] + np.uint64(1)
            key = mix(h[live])
            some = np.flatnonzero(self.maybe[key >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            hit = self.keys[at] == key[some]
            if n == 1:  # a single character must always be possible
                row = len(self.keys) + np.digitize(chars, [0x80, 0x800, 0x10000])
                row[chars == ord("▁")] = len(self.keys) + 4
                row[some[hit]] = self.order[at[hit]]
                found.append((live, n, row))
            else:
                found.append((live[some[hit]], n, self.order[at[hit]]))
        flat = np.concatenate([f for f, _, _ in found])
        end = start[flat] + np.concatenate([np.full(len(f), n) for f, n, _ in found])
        by = np.argsort(start[flat] * (int(size.max(initial=0)) + 1) + end, kind="stable")
        return tuple(x[by] for x in (word[flat], start[flat], end, np.concatenate([r for _, _, r in found])))

    def _forward(self, marked: list[str], p: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Partial sums by place, word and column of `p`; the pieces, one place after the other; and their words."""
        word, start, stop, row = self.pieces_in(marked)
        ahead = np.zeros((LONG_WORD + 2, len(marked), p.shape[1]))
        ahead[0] = 1.0
        cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(stop) != 0)) + 1
        steps = [(int(start[a]), int(stop[a]), word[a:b], row[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]
        for a, b, who, rows in steps:
            ahead[b][who] += ahead[a][who] * p[rows]
        return ahead, steps, ahead[np.fromiter(map(len, marked), np.int64), np.arange(len(marked))]

    def forward(self, words: list[str]) -> np.ndarray:
        """By word and language."""
        if not words:
            return np.zeros((0, len(self.model.languages)))
        end = self._forward(["▁" + w if len(w) <= LONG_WORD else "▁" for w in words], self.p)[2]
        small = (end < LEAST).any(axis=1) | np.fromiter((len(w) > LONG_WORD for w in words), bool)
        out = np.log(np.maximum(end, LEAST))
        log_p = np.log(self.p) if small.any() else None
        for at in np.flatnonzero(small):
            ahead = np.full((len(words[at]) + 2, len(self.model.languages)), -np.inf)
            ahead[0] = 0.0
            for a, b, row in zip(*(x.tolist() for x in self.pieces_in(["▁" + words[at]])[1:]), strict=True):
                ahead[b] = np.logaddexp(ahead[b], ahead[a] + log_p[row])
            out[at] = ahead[-1]
        return out

    def expected(self, words: list[str], often: np.ndarray, language: int) -> np.ndarray:
        """Posterior expected count of each piece in the words, each met `often` times, in one language."""
        out = np.zeros(len(self.p))
        p = self.p[:, language : language + 1]
        marked = ["▁" + w if len(w) <= LONG_WORD else "▁" for w in words]
        ahead, steps, end = self._forward(marked, p)
        small = (end[:, 0] < LEAST) | np.fromiter((len(w) > LONG_WORD for w in words), bool)
        weight = np.where(small, 0.0, often / np.where(small, 1.0, end[:, 0]))
        behind = np.zeros(ahead.shape[:2])
        behind[np.fromiter(map(len, marked), np.int64), np.arange(len(words))] = weight
        found = []
        for a, b, who, rows in sorted(steps, key=lambda s: -s[0]):
            through = p[rows, 0] * behind[b][who]
            found.append((rows, ahead[a][who, 0] * through))
            behind[a][who] += through
        out += np.bincount(np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found]), len(out))
        for at in np.flatnonzero(small):  # in logarithms
            arcs = list(zip(*(x.tolist() for x in self.pieces_in(["▁" + words[at]])[1:]), strict=True))
            n = len(words[at]) + 1
            ahead_log, behind_log = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead_log[0] = behind_log[n] = 0.0
            for a, b, row in arcs:
                ahead_log[b] = np.logaddexp(ahead_log[b], ahead_log[a] + math.log(p[row, 0]))
            for a, b, row in reversed(arcs):
                behind_log[a] = np.logaddexp(behind_log[a], behind_log[b] + math.log(p[row, 0]))
            for a, b, row in arcs:
                out[row] += often[at] * math.exp(ahead_log[a] + math.log(p[row, 0]) + behind_log[b] - ahead_log[n])
        return out[: len(self.keys)]

    def learn(self, found: set[str]) -> None:
        """Room in the memo for all of `found`; where it would pass its bound it starts anew."""
        new = found.difference(self.at)
        if len(self.at) + len(new) > MEMO_WORDS:
            self.forget(len(found))
            new = found
        # a word that has no letter stays at row 0
        plain = [(w, x) for w in sorted(new) if (x := letters(w))]
        rows = {w: 0 for w in new}
        first = len(self.at) + 1
        for start in range(0, len(plain), self.block):
            part = plain[start : start + self.block]
            self.table[first + start : first + start + len(part)] = self.forward([x for _, x in part])
        rows.update((w, first + n) for n, (w, _) in enumerate(plain))
        self.at.update(rows)

    def sums(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """By language, for the words of each text; None where no word has a letter."""
        self.learn(set().union(*texts))
        out: list[np.ndarray | None] = []
        for words in texts:
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            out.append(self.table[at].sum(axis=0) if at.any() else None)
        return out


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with lang_pred and score (the winner's posterior under equal priors); ties go to the smaller code."""
    sent = df.sparkSession.sparkContext.broadcast(model.arrays())
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    df = df.select(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model)
        for batch in batches:
            pred, score = [], []
            for start in range(0, batch.num_rows, SLICE_TEXTS):
                texts = batch[text].slice(start, SLICE_TEXTS).to_pylist()
                for sums in scorer.sums([WORD.findall(t.lower()) if t and model.languages else [] for t in texts]):
                    if sums is None:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(np.argmax(sums))
                    pred.append(model.languages[best])
                    score.append(float(1 / np.exp(sums - sums[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
