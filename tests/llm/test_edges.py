"""More of the operators against brute force: stages of the pipeline, large values, foreign archives, clashing names, empty tables."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import components, langid, lines, media, neardup, queries, substring, topk, urls, warc
from barloom.llm.common import fresh

from test_llm import DOCS, brute_near, brute_windows, made, split

PIECES = {"a": (0.2, 0.1), "b": (0.1, 0.3), "ab": (0.3, 0.05), "▁a": (0.2, 0.2), "ç": (0.01, 0.02)}


def segmentations(word):
    if not word:
        yield [], []
        return
    found = False
    for j in (1, 2):
        if j <= len(word) and word[:j] in PIECES:
            found = found or j == 1
            for names, ps in segmentations(word[j:]):
                yield [word[:j], *names], [PIECES[word[:j]], *ps]
    if not found:
        p = 1.0 if word[0] == "▁" else math.exp(-12.0 * len(word[0].encode()))
        for names, ps in segmentations(word[1:]):
            yield [None, *names], [(p, p), *ps]


@pytest.mark.parametrize("long_word", [24, 3])
def test_expected_pieces_over_all_segmentations(monkeypatch, long_word):
    monkeypatch.setattr(langid, "LONG_WORD", long_word)
    words, often = ["a", "ab", "abba", "xay", "abababab", "çab"], np.array([1.0, 2, 3, 1, 5, 1])
    scorer = langid.Scorer(langid.Model(("u", "v"), PIECES, 2))
    for language in (0, 1):
        want = dict.fromkeys(PIECES, 0.0)
        for w, n in zip(words, often, strict=True):
            ways = [(names, math.prod(p[language] for p in ps)) for names, ps in segmentations("▁" + w)]
            for names, x in ways:
                for name in names:
                    if name:
                        want[name] += n * x / sum(y for _, y in ways)
        assert np.allclose(scorer.expected(words, often, language), list(want.values()))


def language_of(text, model):
    """By single words and the plain forward sum."""
    words = [x for w in langid.WORD.findall((text or "").lower()) if (x := langid.letters(w))]
    if not words:
        return "und", 0.0
    sums = np.array([langid.log_likelihood(w, model) for w in words]).sum(axis=0)
    best = int(np.argmax(sums))
    return model.languages[best], 1 / np.exp(sums - sums[best]).sum()


def test_op1_scores_and_every_label(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{'uvwa'[i % 4]}" * r.randint(1, 20) for _ in range(r.randint(0, 12))), f"l{i % 230}", "s", 0) for i in range(690)] + [(900, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df, langid.vocabulary(queries.PIECES), key=F.col("doc_id"))
    assert len(model.languages) == 230  # no label is left out
    small = [x for x in rows if x[0] % 60 == 0]
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(spark.createDataFrame(small, DOCS).withColumn("lang_pred", F.lit(1)), model).collect()}
    for i, t, *_ in small:
        want = language_of(t, model)
        assert math.isclose(got[i][1], want[1], rel_tol=1e-6) and (got[i][0] == want[0] or want[1] < 0.34)


def test_op3_any_column_names(spark):
    rows = [(i, f"boiler\nline {i}", "en", "a", 0) for i in range(6)] + [(None, "boiler", "en", "a", 0), (0, "boiler\nx", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.col("doc_id") for c in ("_lost", "_gone", "_kept", "_owner", "_LOST_ID", "site", "line")})
    out = lines.drop_boilerplate(df)
    assert set(out.columns) == {*df.columns, "_n_lines", "_n_dropped"} and fresh(df, "_GONE") == ["_GONE_"]
    for r in out.collect():
        assert r["_lost"] == r["_gone"] == r["_kept"] == r["_owner"] == r["site"] == r.doc_id
        assert ("boiler" in r.text) == (r.doc_id is None) and r._n_dropped == (r.doc_id is not None)


def test_op2_headers_and_one_place(spark, tmp_path):
    rows = [(i, ["same", "other " * 50, None, f"own {i}"][i % 4], "en", "s", 0) for i in range(80)]
    stored = media.store(spark.createDataFrame(rows, DOCS).repartition(8), F.col("doc_id"), F.col("text"), root=f"file://{tmp_path}/t")
    assert all(r.n == 1 for r in stored.groupBy("digest").agg(F.countDistinct("shard", "offset").alias("n")).collect())
    size = {r.id: (r.width, r.height) for r in media.headers(stored).collect()}
    back = {r.id: r for r in media.read_back(stored).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        assert size[i] == (64, len(body) // 64) == (back[i].width, back[i].height)
        values = np.frombuffer(body, np.uint8).astype(float)
        p = np.unique(values, return_counts=True)[1] / len(values)
        assert back[i].feature == f"mean={values.mean():.4f};std={values.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};zero={(values == 0).mean():.4f}"


def brute_topk(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in set((i, tuple(v)) for i, v in ok):
        if q % 20 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(20_000, 16_000), (40, 5)])
def test_op5_large_components(spark, shard, block):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, [1e14 + 64 * i, 1.0, -1.0, 0.0, 0.0, 3.0]) for i in range(5)] + [(220, [float((1 << 27) + 1), float((1 << 27) - 3)] + [0.0] * 4), (221, [-1e30] * 6), (240, [1e200] * 6)]
    rows += [(300, [float("nan")] * 6), (301, None), (302, [None] * 6), (303, [float("-inf")] * 6), (320, []), (321, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "x": F.lit("y"), "shard": F.lit(0), "dim": F.lit("z"), "q": F.lit(1)})
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard, block_rows=block).collect()))
    assert got == brute_topk(rows)


def test_op5_scores_are_integers():
    points = np.array([[2.0**27 + 1, 2.0**27 - 3], [1.0, 2.0]])
    ((_, ids, scores),) = topk.search(points, [np.array([5]), np.array([6])], np.array([[2.0**27 + 1, 2.0**27 + 1]]), np.array([1]), np.array([topk.LEAST]), 2)
    q = 2**27 + 1
    assert ids.tolist() == [5, 6] and scores.tolist() == [q * q + q * (2**27 - 3), 3 * q]


def families():
    r, core, rows = random.Random(4), [f"c{j}" for j in range(60)], []
    for f in range(10):  # texts of one family are alike; those of two share 60 words of 100
        for k in range(5):
            w = core + [f"f{f}_{j}" for j in range(40)]
            w[r.randrange(60, 100)] = f"x{f}_{k}"
            rows.append((1000 + f * 10 + k, " ".join(w)))
    base = [f"w{i}" for i in range(80)]
    for i in range(40):
        base[r.randrange(80)] = f"n{i}"
        rows.append((i * 7 % 40, " ".join(base)))
    return rows


@pytest.mark.parametrize("rounds,short,block", [(2, 4, 4), (0, 4, 7)])
def test_op6_long_lists_by_blocks(spark, monkeypatch, rounds, short, block):
    for name, value in (("ROUNDS", rounds), ("SHORT", short), ("BLOCK", block)):
        monkeypatch.setattr(neardup, name, value)
    got = {x.id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(families(), "doc_id long, text string")).collect()}
    assert got == brute_near(families())


def test_components(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 4000), (4000, 5000)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(1000, 1051), 1000), 4000: 4000, 5000: 4000}


def foreign(kind, block, extra, order):
    fields = [f"content-LENGTH: {len(block)}", f"warc-type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", *extra]
    return ("WARC/1.0\r\n" + "\r\n".join(fields[order:] + fields[:order]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_op7_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\npay\r\n\r\nload"
    recs = [foreign("warcinfo", b"software: x", [], 0), foreign("response", http, ["Content-Type: application/http;\r\n msgtype=response"], 1), foreign("Revisit", b"", ["WARC-Refers-To: <urn:uuid:9>"], 2), foreign("resource", b"plain" * 500_000, [], 1)]
    for name, data in (("members", b"".join(map(gzip.compress, recs))), ("whole", gzip.compress(b"".join(recs))), ("mixed", gzip.compress(recs[0] + recs[1][:50]) + gzip.compress(recs[1][50:] + recs[2]) + gzip.compress(recs[3]))):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        index = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.gz",)], "archive string")).orderBy("offset").collect()
        assert [zlib_members(r) for r in index] == recs
        sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
        got = sorted((r.record_type, r.payload_bytes, r.payload_digest, r.page_id, r.refers_to) for r in warc.read_back(spark.createDataFrame(index, warc.INDEX)).collect())
        assert got == sorted([("warcinfo", 11, sha(b"software: x"), None, None), ("response", 11, sha(b"pay\r\n\r\nload"), None, None), ("revisit", None, None, None, None), ("resource", 2_500_000, sha(b"plain" * 500_000), None, None)], key=lambda x: x[0])
    for bad in (gzip.compress(recs[1])[:-12], gzip.compress(recs[1][:-20])):
        (tmp_path / "bad.warc.gz").write_bytes(bad)
        with pytest.raises(Exception, match="cut short|ends within"):
            warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "archive string")).collect()


def zlib_members(r):
    with open(r.archive.removeprefix("file://"), "rb") as f:
        f.seek(r.offset)
        return gzip.decompress(f.read(r.length))


def test_op7_query(spark, tmp_path):
    html = ["<p>one</p>", "", None, "<p>zwei</p>"]
    rows = [(i, f"http://a/{i}", html[i % 3] if i < 40 else f"{html[3]}{i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "sha", "first", "payload", "archive", "salt")}).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op7_warc(spark, f"file://{tmp_path}").collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""])))


def test_op8_factors_are_passages(spark):
    df = spark.createDataFrame(made(), DOCS).withColumns({c: F.lit("mine") for c in ("_owner", "_keys", "_live", "_dup_keys", "_n_words", "_kept", "owner", "keys")})
    out, words = substring.factor(df).collect(), {i: split(t) for i, t, *_ in made()}
    assert all(r["_owner"] == r["_keys"] == r["_live"] == r["owner"] == "mine" for r in out) and sum(len(r._factors) for r in out) > 20
    for r in out:
        for f in r._factors:
            assert f.reference < r.doc_id and words[f.reference][f["at"] : f["at"] + f.n_words] == words[r.doc_id][f.start : f.start + f.n_words]
        gone = {j for f in r._factors for j in range(f.start, f.start + f.n_words)}
        assert len(gone) == r._n_removed and r._kept == " ".join(w for j, w in enumerate(words[r.doc_id]) if j not in gone)


def plain_markov(rows, order):
    counts = defaultdict(lambda: defaultdict(int))
    for text in rows:
        text = "\x02" + text + "\x03"
        for i, n in itertools.product(range(1, len(text)), range(order + 1)):
            if n <= i:
                counts[text[i - n : i]][text[i]] += 1

    def score(text):
        text, out = "\x02" + text + "\x03", 0.0
        for i in range(1, len(text)):
            p = 1 / 65536
            for n in range(min(order, i) + 1):
                seen = counts.get(text[i - n : i])
                if seen is None:
                    break
                p = (seen.get(text[i], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
            out += math.log(p)
        return out

    return score


def test_op10_scores_threshold_and_verdicts(spark, tmp_path):
    r = random.Random(6)
    site = lambda: r.choice(["x.org", "a.net", "example.net", "example.com", "b.io"])
    rows = [(i, f"https://{site()}/{r.choice(['fr', 'de', 'en'])}/{r.choice(['news', 'win', 'spam', 'doc'])}{r.randint(0, 99)}?q={i % 7}") for i in range(400)] + [(900, None), (901, ""), (902, "no url"), (903, rows0 := "https://b.io/x"), (904, rows0)]
    spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("text", "score", "judged", "label", "host")}).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in queries.op10_url_filter(spark, f"file://{tmp_path}").collect()}
    ruled = {got[i].rule and rows[n][1]: got[i].verdict for n, (i, _) in enumerate(rows) if got[i].rule}
    held = {x.t for x in spark.createDataFrame([(t,) for t in ruled], "t string").where(F.pmod(F.xxhash64("t", F.lit(12)), F.lit(5)) == 0).collect()}
    accepted, rejected = (plain_markov([t for t, v in ruled.items() if v == kind and t not in held], 5) for kind in ("allow", "block"))
    score = lambda t: (accepted(t) - rejected(t)) / (len(t) + 1) if t else 0.0
    marks = sorted((score(t), ruled[t] == "allow") for t in held)
    cuts = [(x[0] + y[0]) / 2 for x, y in zip(marks, marks[1:], strict=False) if x[0] < y[0]]
    worth = lambda c: sum(ok and s >= c for s, ok in marks) / sum(ok for _, ok in marks) + sum(not ok and s < c for s, ok in marks) / sum(not ok for _, ok in marks)
    threshold = max([marks[0][0], *cuts], key=worth)
    for i, t in rows:
        assert math.isclose(got[i].score, score(t), rel_tol=1e-9, abs_tol=1e-12)
        if not got[i].rule:
            assert got[i].verdict == ("block" if t and score(t) < threshold else "allow")


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    from barloom.llm.common import read

    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name
    assert read(spark, f"file://{tmp_path}", "documents").count() == 0


def test_repeated_ids(spark, tmp_path):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t, "en", "s", 0), (1, t, "en", "s", 0), (1, "other text here", "en", "s", 0), (2, t, "en", "s", 0), (None, t, None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    path = f"file://{tmp_path}"
    assert queries.op1_language_id(spark, path).count() == queries.op2_media_columns(spark, path).count() == 5
    tokens = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in queries.op4_byte_bpe(spark, path).collect())
    assert [x[0] for x in tokens] == [0, 1, 1, 1, 2] and {x[2] for x in tokens} == {hashlib.sha256(x[1].encode()).hexdigest() for x in rows}
    packed = queries.op9_best_fit_packing(spark, path).collect()
    assert len(packed) == 5 and len({r.sequence_id for r in packed}) == 1


def test_stages_against_brute_force(spark):
    """Each stage on its own input, with nulls, empty and repeated rows and a clashing name."""
    rows = [(i, f"shared line {i % 3}\n{t}" if t and i % 2 else t, l, s, n) for i, t, l, s, n in made()] + [(300, "12 34 !?", "en", "s1", 8), made()[5]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_lost", F.lit(1))
    columns = corpus_pipeline.COLUMNS

    def run(stage, df):
        out = stage(spark, df, "").select(columns)
        got = sorted(map(tuple, out.collect()), key=str)
        return got, spark.createDataFrame(got, DOCS)

    def check(got, want):
        want = sorted(((i, t, l, s, n) for i, t, l, s, n in want), key=str)
        assert [(*x[:4], x[4]) for x in got] == want

    model = langid.fit(docs, langid.vocabulary(queries.PIECES), key=F.col("doc_id"))
    got, kept = run(corpus_pipeline.language, docs)
    check(got, [x for x in rows if (found := language_of(x[1], model))[0] != "und" and found[1] >= 0.5])

    got, lined = run(corpus_pipeline.boilerplate, kept)
    before, want = [tuple(x) for x in kept.collect()], []
    for i, t, l, s, n in before:
        pages = [set(y[1].split("\n")) for y in before if y[3] == s]
        all_lines = t.split("\n")
        left = [x for x in all_lines if not x.strip(" ") or (k := sum(x in p for p in pages)) < 3 or k <= 0.05 * len(pages)]
        text = "\n".join(left)
        if len(left) == len(all_lines) or text.strip():
            want.append((i, text, l, s, len(text)))
    check(got, want)

    got, single = run(corpus_pipeline.near_copies, lined)
    before = [tuple(x) for x in lined.collect()]
    near = brute_near([(i, t) for i, t, *_ in before])
    check(got, [x for x in before if near[x[0]][2]])

    got, _ = run(corpus_pipeline.repeats, single)
    before = [tuple(x) for x in single.collect()]
    gone, by_id = brute_windows(before), {x[0]: x for x in got}
    for i, t, l, s, n in before:
        words, removed, sha = gone[i]
        assert (i in by_id) == (not removed or removed < words)
        if i in by_id and removed:
            assert hashlib.sha256(by_id[i][1].encode()).hexdigest() == sha and by_id[i][4] == len(by_id[i][1])
        elif i in by_id:
            assert by_id[i][1] == t

    from tokenizers import Tokenizer

    tok, bins = Tokenizer.from_file(queries.PACK_JSON), defaultdict(list)
    last = spark.createDataFrame(got, DOCS)
    for r in corpus_pipeline.sequences(spark, last, "").collect():
        bins[r.sequence_id].append((r.offset, r.length, r.doc_id))
    tokens = {x[0]: len(tok.encode(x[1], add_special_tokens=False).ids) + 1 for x in got}
    assert sum(n for b in bins.values() for _, n, _ in b) == sum(tokens[x[0]] for x in got)
    for b in bins.values():
        assert [o for o, *_ in sorted(b)] == [0, *itertools.accumulate(n for _, n, _ in sorted(b))][:-1] and sum(n for _, n, _ in b) <= 2048
    assert re.fullmatch(r"[a-z_,]+", ",".join(n for n, _ in corpus_pipeline.STAGES)) and P.path("byte_bpe_50k.json")


def test_media_headers_need_no_more_than_headers(spark, tmp_path):
    """With all bytes behind the headers gone from the shards, sizes are still found, and payloads aren't."""
    texts = [(1, "a" * 1000), (2, "b" * 64 * 70), (3, None), (4, "a" * 1000)]
    stored = media.store(spark.createDataFrame(texts, "k long, t string").coalesce(2), F.col("k"), F.col("t"), f"file://{tmp_path}/shards")
    rows = stored.collect()
    want = {r.id: (r.width, r.height) for r in media.read_back(media.headers(stored)).collect()}
    assert want == {1: (64, 16), 2: (64, 70), 3: (64, 1), 4: (64, 16)}
    for r in rows:
        with open(r.shard.removeprefix("file://"), "r+b") as f:
            f.seek(r.offset + media.HEADER)
            f.write(bytes(r.length - media.HEADER))
    assert {r.id: (r.width, r.height) for r in media.headers(stored).collect()} == want
    with pytest.raises(Exception, match="zlib|incomplete|truncated|invalid"):
        media.read_back(stored).collect()
