"""The operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, langid, lines, media, neardup, packing, queries, substring, topk, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "er", "in", "é", "ou", "Ä", "st"]) for _ in range(r.randint(1, 3))) for _ in range(40)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows, texts = [], []
    for i in range(n):
        t = " ".join(r.choice(words) + r.choice(["", "", ",", ".\n"]) for _ in range(r.randint(0, 120)))
        if i % 4 == 1:
            t += " " + passage + " " + t[:40]
        if i % 5 == 2 and texts:
            t = r.choice(texts)
        if i % 7 == 3 and texts:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
        rows.append((i, t, r.choice(["en", "fr"]), f"s{i % 3}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \t\n ", None, "s1", 4), (n + 3, "one two", "en", "s1", 7), (n + 4, "ONE two", "fr", "s1", 7), (n + 5, "long" * 20_000, "en", "s2", 80_000), (n + 6, ("x y z " * 3000), "en", "s2", 18_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).repartition(3)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    docs.withColumns({"_lost": F.lit(1), "id": F.lit("x"), "label": F.lit(0)}).write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    return path


def test_op1(spark, sf_dir):
    got = collected(queries.op1_language_id(spark, sf_dir))
    assert len(got) == len(made())
    for i, t, *_ in made():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1
    assert queries.op1_language_id(spark, f"{sf_dir}/empty").count() == 0


def test_forward_sums_all_segmentations():
    model = langid.Model(("a",), {"▁": (0.1,), "▁x": (0.2,), "x": (0.3,), "y": (0.1,), "xy": (0.05,), "▁xy": (0.02,)}, 3)
    want = 0.1 * 0.3 * 0.1 + 0.1 * 0.05 + 0.2 * 0.1 + 0.02
    assert np.isclose(np.exp(langid.log_likelihood("xy", model)[0]), want)
    assert np.isfinite(langid.log_likelihood("xy" * 50_000, model)[0])


def test_batched_sums_equal_single_ones(monkeypatch):
    pieces = {"a": (0.2, 0.1), "b": (0.1, 0.3), "ab": (0.3, 0.05), "▁a": (0.2, 0.2), "ç": (0.01, 0.02)}
    model = langid.Model(("u", "v"), pieces, 2)
    words = ["a", "ab", "abba", "xay", "中文", "ç", "𝒳", "ab" * 12, "ab" * 300, "中" * 24]
    want = np.array([langid.log_likelihood(w, model) for w in words])
    assert np.allclose(langid.Scorer(model).forward(words), want, rtol=1e-12)
    monkeypatch.setattr(langid, "MEMO_WORDS", 3)  # the memo starts anew within and between calls
    scorer = langid.Scorer(model)
    for _ in range(2):
        for w, x in zip(words, want, strict=True):
            assert np.allclose(scorer.sums([[w, w]])[0], 2 * x)
        assert np.allclose(scorer.sums([words])[0], want.sum(axis=0))
    assert scorer.sums([[], ["²"]]) == [None, None]
    assert langid.Scorer(langid.Model((), {}, 1)).sums([[]]) == [None]


def test_folds_agree():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    for word in ("aaaaaaa", "mississippi", " überraschend", "zzzqqqxy", "привет", "ab" * 20, "\x00\x01"):
        one = [word.encode()[i : i + 1] for i in range(len(word.encode()))]
        assert bpe.fold(word.encode(), ranks) == ([ranks[word.encode()]] if word.encode() in ranks else bpe._fold_long(one, ranks))


def test_op1_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_op2(spark, sf_dir):
    got = collected(queries.op2_media_columns(spark, sf_dir))
    for i, t, *_ in made():
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        png = media.to_png(body)
        assert (r.media_bytes, r.media_sha256, r.width * r.height) == (len(png), hashlib.sha256(png).hexdigest(), len(body)) and media.from_png(png) == body
    assert queries.op2_media_columns(spark, f"{sf_dir}/empty").count() == 0


def test_op2_shards_are_tar(spark, docs, tmp_path):
    import tarfile

    media.store(docs, F.col("doc_id"), F.col("text"), root=f"file://{tmp_path}/t")
    names = [m.name for p in (tmp_path / "t").glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert {n.removesuffix(".png") for n in names} == {hashlib.sha256((t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64)).hexdigest() for _, t, *_ in made()}


def test_op3(spark):
    rows = [(i, f"boiler\nline {i}\n\n boiler {i % 2}", "en", "a" if i < 30 else None, 0) for i in range(40)] + [(90, None, "en", "a", 0), (None, "boiler\nown", "en", "a", 0), (0, "boiler\nother", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("pages", F.lit(1)).withColumn("line", F.lit(1))
    got = [(r.doc_id, r.text, r._n_dropped) for r in lines.drop_boilerplate(df, min_pages=10).collect()]
    want = []
    for i, t, _, s, _ in rows:
        n = sum(x[3] == s for x in rows)
        def gone(x, s=s, n=n):
            k = sum(x in set((y[1] or "").split("\n")) for y in rows if y[3] == s)
            return x.strip(" ") and k >= 10 and k > 0.05 * n
        kept = None if t is None else t.split("\n") if i is None else [x for x in t.split("\n") if not gone(x)]
        want.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_op3_small_hosts(spark, tmp_path):
    import corpus_pipeline

    rows = []
    for pages in (1, 2, 3, 9, 20, 40, 50, 59, 60, 61):
        for i in range(pages):
            t = "\n".join(["all", *(["three"] if i < 3 else []), *(["two"] if i < 2 else []), f"own {pages} {i}"])
            rows.append((len(rows), t, "en", f"h{pages}", len(t)))
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for i, t, _, h, _ in rows:
        on = lambda x, h=h: sum(x in y[1].split("\n") for y in rows if y[3] == h)
        n = sum(y[3] == h for y in rows)
        want[i] = "\n".join(x for x in t.split("\n") if not (on(x) >= 3 and on(x) > 0.05 * n))
    assert want[3] == "two\nown 3 0"
    got = collected(queries.op3_line_dedup(spark, f"file://{tmp_path}"))
    assert {i: r.text_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    staged = corpus_pipeline.boilerplate(spark, spark.createDataFrame(rows, DOCS), "")
    assert {r.doc_id: r.text for r in staged.collect()} == want


def test_op4(spark, sf_dir):
    import tiktoken

    ranks = bpe.load_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collected(queries.op4_byte_bpe(spark, sf_dir))
    for i, t, *_ in made():
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    odd = ["a  b", "x \n\n y ", "\u00a0\u2003z", "it's  we'll\r\n", "\x1c a\x1d", "日本語 テキスト", "  ", "a\u0085b", "e\u0301 1²³½", "word" * 60, "\u3000 ", "!!! ??? \t\t.", "<|endoftext|> x"]
    encoder = bpe.rank_encoder(queries.RANKS, P.PATTERN)
    for t in odd:
        assert np.frombuffer(encoder(t), "<u4").tolist() == enc.encode_ordinary(t), t


def brute_topk(rows, k=20):
    import math

    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [20_000, 100])
def test_op5(spark, shard):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=8) / 4)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 400)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, [1.0, 2.0]), (421, [3.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=shard, block_rows=max(8, shard // 10))
    assert {tuple(x) for x in got.collect()} == brute_topk(rows)


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_op6(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == brute_near(made())


def test_op6_chains(spark):
    r = random.Random(4)
    base = [f"w{r.random()}" for _ in range(100)]
    rows = []
    for i in range(80):  # each differs a little from the one before, so ends of the chain are unlike
        if i % 2:
            base[r.randrange(100)] = f"n{i}"
        rows.append((i * 7 % 80, " ".join(base)))
    rows += [(200 + i, " ".join([*base[:70], *(f"o{i}_{j}" for j in range(30))])) for i in range(20)]
    got = {x.id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_op7(spark, tmp_path):
    html = ["<p>one</p>", "", None, "<p>one</p>", "héllo\r\n\r\nWARC/1.1", "x" * 3_000_000]
    rows = [(i, f"http://a/{i}", html[i % len(html)]) for i in range(60)] + [(None, None, "<p>one</p>"), (7, "http://b/7", "<p>one</p>")]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), F.col("page_id"), F.col("url"), F.col("html"), root=f"file://{tmp_path}/w")
    index = warc.normalise(archives)
    got = sorted(map(tuple, warc.read_back(index).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=str)
    for r in index.collect()[:5]:  # each member opens by itself
        data = open(r.archive.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")


def brute_windows(rows):
    first, out = {}, {}
    grams = {i: [tuple(w[j : j + 13]) for j in range(len(w) - 12)] for i, w in ((i, split(t)) for i, t, *_ in rows)}
    for i, g in grams.items():
        for x in g:
            first[x] = min(first.get(x, i), i)
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for j, x in enumerate(grams[i]):
            if first[x] < i:
                gone |= set(range(j, j + 13))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_op8(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, sf_dir).collect()}
    assert got == brute_windows(made()) and any(x[1] for x in got.values())
    assert queries.op8_substring_dedup(spark, f"{sf_dir}/empty").count() == 0


def test_op8_repeats_and_nulls(spark):
    t = " ".join(map(str, range(20)))
    got = [(r.doc_id, r._n_removed) for r in substring.factor(spark.createDataFrame([(1, t), (1, t), (2, t + " x"), (None, t), (3, t + " " + t)], "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, 20), (None, 0), (3, 40)], key=str)


def test_op9(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.PACK_JSON)
    got, bins = defaultdict(list), defaultdict(list)
    for r in queries.op9_best_fit_packing(spark, sf_dir).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in made():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for n, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(part)) and (n == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids) and (len(got[i]) == 1 or len(ids) > 2048)
    total = 0
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 2048
        total += end
    assert len(bins) <= -(-total // 2048) + 1


def test_op9_special_strings_and_ids():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(queries.PACK_JSON), queries.json_encoder()
    for t in ["a <|endoftext|> b", "  two  spaces\n\n x", "é\u00a0\u2003 z", "日本語", "it's", "\x1c a"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_plan_uses_every_piece():
    r = random.Random(2)
    for _ in range(20):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(30)}
        used = defaultdict(int)
        for pattern, times in packing.plan(counts, 64):
            assert sum(pattern) <= 64 and times > 0
            for x in pattern:
                used[x] += times
        assert used == counts


def test_op6_classes_of_one_id(spark):
    import corpus_pipeline

    a, b, other = ("".join(f"{p}{i} " for i in range(40)) for p in "abc")
    rows = [(1, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (9, b, "en", "s", 0), (12, other, "en", "s", 0), (None, b, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.id, r.component_id, r.kept) for r in neardup.near_duplicates(df).where("id is not null").collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (9, 1, False), (12, 12, True)]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, df, "").collect()) == ["1", "12", "None"]


def test_op10(spark):
    cases = [("http://a.net/x", "a.net", "/x", "net/"), ("https://m.Example.NET/en/1?q", "m.example.net", "/en/1", "example.net/en/"), ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/"), ("http://a.net", "a.net", "", None), (None, "", "", None), ("nothing", "", "", None), ("http://notexample.com/de/", "notexample.com", "/de/", None), ("a://b://c/d", "b:", "//c/d", None), ("http://net?x", "net", "", None), ("http://x/\ny", "x", "/\ny", None)]
    host, path = urls.host_and_path(F.col("url"))
    rule, _ = urls.rule_for(F.col("host"), F.col("path"), queries.RULES)
    got = {r.url: (r.host, r.path, r.rule) for r in spark.createDataFrame([(c[0],) for c in cases], "url string").withColumns({"host": host, "path": path}).withColumn("rule", rule).collect()}
    assert got == {c[0]: c[1:] for c in cases}
    out = queries.op10_url_filter(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 50 and {r.verdict for r in out} <= {"allow", "block"}


def test_op10_model_tells_kinds_apart(spark):
    rows = [(f"good-{i % 97}.com/news/{i}", "allow") for i in range(400)] + [(f"spam-{i % 89}.biz/win/{i}", "block") for i in range(400)]
    model = urls.fit(spark.createDataFrame(rows, "text string, label string"))
    got = urls.judge(spark.createDataFrame([("good-x.com/news/9999",), ("spam-q.biz/win/777",), ("",), (None,)], "text string"), model, "text").collect()
    assert [r.judged for r in got][:2] == ["allow", "block"] and got[2].score == got[3].score == 0


def test_op10_judges_the_whole_url(spark, tmp_path):
    urls_ = [f"http://x.org/fr/{i}?good={i}#g" for i in range(300)] + [f"http://example.com/de/{i}?spam={i}#s" for i in range(300)]
    urls_ += ["http://a.io/p?good=5#g", "http://a.io/p?spam=5#s", "x?good=77#g", "x?spam=77#s", "", None]
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = collected(queries.op10_url_filter(spark, f"file://{tmp_path}"), "page_id")
    assert [got[i].verdict for i in range(600, 606)] == ["allow", "block", "allow", "block", "allow", "allow"]
    assert got[600].score > got[601].score and got[602].score > got[603].score and got[604].score == got[605].score == 0
    assert [(got[i].host, got[i].path, got[i].rule) for i in (600, 602)] == [("a.io", "/p", None), ("", "", None)]


def test_op10_empty_is_allowed_at_any_threshold(spark):
    chars = urls.Markov([("", "a", 1)], 1)
    out = urls.judge(spark.createDataFrame([("",), (None,), ("a",)], "text string"), urls.Model(chars, chars, 1.0), "text")
    assert [r.judged for r in out.collect()] == ["allow", "allow", "block"]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.run(spark, f"{sf_dir}/empty").count() == 0
