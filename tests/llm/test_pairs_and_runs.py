"""N-gram joins, spelling variants and periodic runs against brute force, on tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ngramjoin, queries, runs, variants


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t, k=5):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def components_of(rows, percent):
    """Rows (id, text) to their smallest reachable ids."""
    head = {i: i for i, _ in rows if i is not None}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((root(i), root(j)))
                head[q] = p
    return {i: root(i) for i in head}


def like_texts(seed, n):
    """Families of texts around the threshold, passages that many share, copies, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(30)]
    bases = [[r.choice(words) for _ in range(r.choice([6, 40, 90]))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases)) if i % 3 else passage + [r.choice(words) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, (" " if i % 2 else "\n").join(w).replace("w1", "W1" if i % 5 == 0 else "w1")))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, rows[4][1]), (n + 6, rows[4][1]), (7, rows[50][1]), (n + 7, "very long " * 20_000), (n + 8, "very long " * 20_001), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize(("rounds", "long", "spread"), [(8, 64, 1000), (3, 0, 7)])
def test_ngram_join(spark, monkeypatch, rounds, long, spread):
    """Pair by pair at once, and by hubs first with everything salted."""
    for name, value in (("ROUNDS", rounds), ("LONG", long), ("LONGER", long), ("SPREAD", spread)):
        monkeypatch.setattr(ngramjoin, name, value)
    rows = like_texts(1, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"n": F.lit(1), "class": F.lit("x"), "set": F.lit("y"), "label": F.lit(0)})
    got = ngramjoin.jaccard_components(df).collect()
    assert len(got) == len(rows)
    want = components_of(rows, 80)
    assert {r.id: r.component_id for r in got if r.id is not None} == want
    assert [r.component_id for r in got if r.id is None] == [None]
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(shingle_set(t)))
    assert all(r.n_shingles in sizes[r.id] for r in got)


def test_ngram_join_other_thresholds(spark):
    rows = like_texts(2, 80)
    for percent in (60, 100):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.id: r.component_id for r in ngramjoin.jaccard_components(df, percent=percent).collect() if r.id is not None}
        assert got == components_of(rows, percent)


def test_ngram_join_emits_no_pairs_of_a_group(spark):
    """A group of 1,500 near copies: what is verified stays near the number of texts."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:60], f"x{i}", *words[60:]])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    verified = ngramjoin._verified

    def counting(pairs, *more, **named):
        seen.append(pairs.count())
        return verified(pairs, *more, **named)

    ngramjoin._verified = counting
    try:
        got = ngramjoin.jaccard_components(df).collect()
    finally:
        ngramjoin._verified = verified
    assert {r.component_id for r in got} == {0} and sum(seen) <= 3 * len(rows)


def like_group(seed, n, edits):
    """A text's copies with some words replaced: few of their pairs are alike, though all share most shingles."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(2, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_ngram_join_makes_no_pairs_of_a_group_that_is_little_alike(spark, monkeypatch):
    rows = like_group(5, 400, 9)
    seen, verified = [], ngramjoin._verified

    def counting(pairs, *more, **named):
        seen.append(pairs.count())
        return verified(pairs, *more, **named)

    monkeypatch.setattr(ngramjoin, "_verified", counting)
    got = {r.id: r.component_id for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = components_of(rows, 80)
    assert got == want and 20 < len(set(want.values())) < 380
    assert sum(seen) <= 3 * len(rows)


@pytest.mark.parametrize(("many", "block", "entries", "columns", "long"), [(1, 7, 1_000_000, 3, 1024), (0, 1000, 500, 4096, 0), (4, 1000, 1_000_000, 4096, 1024)])
def test_ngram_join_by_blocks(spark, monkeypatch, many, block, entries, columns, long):
    """Blocks of few classes, of few shingles, and lists as one block, with and without hubs before them."""
    for name, value in (("MANY", many), ("BLOCK", block), ("ENTRIES", entries), ("COLUMNS", columns), ("LONG", long), ("LONGER", long)):
        monkeypatch.setattr(ngramjoin, name, value)
    rows = like_texts(3, 120) + [(i + 1000, t) for i, t in like_group(4, 60, 6)]
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got if r.id is not None} == components_of(rows, 80)


def test_overlaps_and_forests():
    r = np.random.default_rng(7)
    for m, values in ((1, 5), (3, 40), (70, 30), (70, 3000)):
        sets = [np.unique(r.integers(0, values, r.integers(1, 60))).astype(np.uint64) for _ in range(m)]
        shared = ngramjoin._overlaps(sets)
        assert shared.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
        alike = (shared > 3) & ~np.eye(m, dtype=bool)
        a, b = ngramjoin._forest(alike)
        head = list(range(m))
        for x, y in zip(a, b, strict=True):
            assert alike[x, y] and head[x] != head[y]
            head = [head[x] if h == head[y] else h for h in head]
        assert all(head[x] == head[y] for x, y in zip(*np.nonzero(alike), strict=True))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.jaccard_components(docs).count() == 0
    assert variants.variants(variants.edited_words(docs)).count() == 0
    assert runs.periodic_runs(docs).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = r.permutation(n)
        tree = variants.WaveletTree(values)
        left, low = r.integers(0, n, 50), r.integers(0, n, 50)
        right, high = left + r.integers(0, n + 1 - left), low + r.integers(0, n + 1 - low)
        question, value = tree.report(left, right, low, high)
        want = sorted((q, int(v)) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q])
        assert sorted(zip(question.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize(("group", "index"), [(20_000, 50_000), (3, 5), (20_000, 20)])
def test_near_words(spark, monkeypatch, group, index):
    """By indexes of all sizes, and with crowded halves by single places."""
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "INDEX", index)
    r = random.Random(3)
    words = {"".join(r.choice("abé𝒳") for _ in range(r.randint(0, 6))) for _ in range(300)} | {"long" * 50, "long" * 49 + "lonk", "long" * 49 + "lon"}
    df = spark.createDataFrame([(w, "x") for w in [*words, None, "ab", "ab\0"]], "word string, near string")
    got = [(x.word, x.near) for x in variants.near_words(df.repartition(3)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words | {"ab"} for b in words | {"ab"} if near(a, b)}


def test_variants(spark):
    """Forms by counts and ties, roots by several steps, words given twice, nulls."""
    rows = [("colour", 40), ("color", 20), ("colon", 9), ("colony", 4), ("colons", 4), ("apple", 3), ("apply", 6), ("appla", 6), ("alone", 5), (None, 9), ("alone", 2), ("grape", None)]
    got = {r.word: r for r in variants.variants(spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit(1))).collect()}
    assert (got["colony"].form, got["colony"].root, got["colony"].form_n, got["colony"].n_near) == ("colon", "colour", 9, 2)
    assert (got["apple"].form, got["apple"].n_near) == ("appla", 2)
    assert (got["apply"].form, got["apply"].root, got["alone"].n, got["alone"].n_near) == (None, "apply", 5, 0)
    assert set(got) == {w for w, n in rows if w and n}


def test_edited_words(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcÉé×÷ÿZ") for _ in range(r.randint(1, 7))) + r.choice(["", ",", "中", "1", "Ā"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (None, "Some WORDS here"), (3, "Größe "), (61, "x" * 300_000)]
    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{low}".encode())
            if i is not None and h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            want[low] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"key": F.lit("k"), "word": F.lit("w")})
    assert {r.word: r.n for r in variants.edited_words(df).collect()} == dict(want)


def brute_runs(w, least=6, times=4):
    seen = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                seen.setdefault((s, i - s + p), p)
            i += i == s
    return [(s, n, p) for s, p, n in sorted((s, p, n) for (s, n), p in seen.items())]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_find_runs(monkeypatch, least, times):
    monkeypatch.setattr(runs, "QUESTIONS", 50)
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(0, 5)):
            k, n = r.choice([1, 2, 3, 8]), r.randint(0, 60)
            w = [r.randrange(k) for _ in range(n)]
            if r.random() < 0.5 and n > 5:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        got = runs.find_runs([np.array(w, np.int64) for w in texts], least, times)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(w, least, times) for w in texts]


def test_periodic_runs(spark):
    rows = [(1, "a b " * 5 + "c c c c c c c"), (2, None), (3, ""), (4, "x y\tz"), (5, "very long " * 60_000), (1, "a b " * 5 + "c c c c c c c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_runs": F.lit(1), "start": F.lit("s"), "best": F.lit(0)})
    got = runs.periodic_runs(df.repartition(2))
    assert got.columns == ["doc_id", "text", "start", "best", "_n_words", "_runs", "_collapsed"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and [tuple(x) for x in by[1][0]._runs] == [(0, 10, 2), (10, 7, 1)]
    assert by[1][0]._collapsed == "a b c" and by[2][0]._n_words == 0 and by[2][0]._runs == [] and by[2][0]._collapsed == ""
    assert by[4][0]._collapsed == "x y z" and [tuple(x) for x in by[5][0]._runs] == [(0, 120_000, 2)]
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(df, times=1)


def test_op13(spark, tmp_path):
    """The contract, repeated stretches included, against brute force."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90)))) for i in range(80)] + [(80, None), (81, " "), (None, "q q q q q q")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, f"file://{tmp_path}").collect()}
    for i, t in rows:
        w = split(t)
        n = len(w)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute_runs(w)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        s, m, p = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(found), s, m, p, None if m is None else 1000 * m // p)
        assert (x.runs_sha256, x.collapsed_sha256) == (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
