"""The operators applied to their tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from functools import lru_cache, partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lines, media, neardup, ngramjoin, packing, runs, substring, topk, urls, variants, warc
from .common import read

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACK_JSON = public_tokenizers.path("byte_bpe_50k.json")
PACK_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MIN_PAGES = 3
RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held), langid.vocabulary(PIECES), key=F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return media.read_back(media.headers(stored)).select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.drop_boilerplate(docs, min_pages=MIN_PAGES)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return bpe.decode(ids, RANKS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), F.col("html"))
    return warc.read_back(warc.normalise(archives))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.factor(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


@lru_cache(1)
def special_strings() -> list[str]:
    return packing.special_strings(PACK_JSON)


def json_encoder(special: list[str] | None = None):
    return packing.json_encoder(PACK_JSON, PACK_RANKS, public_tokenizers.PATTERN, special_strings() if special is None else special)


def pack_pieces(docs: DataFrame) -> DataFrame:
    return packing.pieces(docs, partial(json_encoder, special_strings()))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pack_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(parts).withColumnRenamed("id", "doc_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urls.host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").alias("text"))
    rule, verdict = urls.rule_for(F.col("host"), F.col("path"), RULES)
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "text")
    model = urls.fit(pages.select("text", F.col("ruled").alias("label")))
    return urls.judge(pages, model, "text").select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "score")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.edited_words(read(spark, sf_dir, "documents"))
    return variants.variants(counts.where((F.char_length("word") >= 5) & (F.col("n") >= 3)))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by id, repeat a stretch of their words to the end; their words are joined by one space."""
    words = docs.select("doc_id", "text", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    words = words.withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), F.try_mod(g, n)).cast("int"))
    words = words.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return words.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length first, then smallest start and period
    best = F.element_at(F.array_sort(F.transform("_runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    out = out.withColumn("best", F.when(F.size("_runs") > 0, best))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = -F.col("best.shorter"), F.col("best.period")
    return out.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT site, count(*) AS all_pages FROM d GROUP BY site),
p AS (SELECT doc_id, site, unnest(list_distinct(list_filter(ls, lambda x: length(trim(x, ' ')) > 0))) AS line FROM d),
b AS (SELECT p.site, line FROM p JOIN t USING (site) GROUP BY p.site, line HAVING count(*) >= 3 AND count(*) > 0.05 * any_value(all_pages)),
g AS (SELECT site, list(line) AS gone FROM b GROUP BY site),
k AS (SELECT doc_id, ls, list_filter(ls, lambda x: length(trim(x, ' ')) = 0 OR NOT list_contains(coalesce(gone, []), x)) AS kept FROM d LEFT JOIN g USING (site))
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_media_columns, op3_line_dedup, op4_byte_bpe, op5_exact_topk, op6_minhash_near_dedup, op7_warc, op8_substring_dedup, op9_best_fit_packing, op10_url_filter, op11_ngram_jaccard, op12_spelling_variants, op13_periodic_runs)}

OP5_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos FROM g JOIN f USING (g) WHERE first < doc_id),
x AS (SELECT doc_id, list(pos) AS gone FROM h GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone, list_filter(w, lambda t, n: NOT list_contains(coalesce(gone, []), n)) AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = doc_id
"""

#: (crc32 of UTF-8 `text` is list_reduce of its bytes from 2 ** 32 - 1 over a table of 256 remainders)
CRC_TABLE = "crc AS (SELECT list(list_reduce(generate_series(0, 7), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), i) ORDER BY i) AS tbl FROM range(256) t(i))"


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a string's UTF-8, beside CRC_TABLE."""
    codes = f"list_transform(generate_series(1, length(hex(encode({text}))), 2), lambda i: CAST('0x' || hex(encode({text}))[i:i + 1] AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM o GROUP BY ALL),
h AS (SELECT w, n, {crc_sql("doc_id || ':' || w")} AS h FROM c, crc),
e AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM v, LATERAL (SELECT unnest(generate_series(1, length(word))) AS i)),
p AS (SELECT DISTINCT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT word, rest FROM x WHERE rest IN (SELECT word FROM v) UNION SELECT rest, word FROM x WHERE rest IN (SELECT word FROM v)),
b AS (SELECT p.word, count(*) AS n_near, max(v.n) AS top, arg_min(near, (-v.n, near)) AS best FROM p JOIN v ON v.word = near GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN best END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""

OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
q AS (SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM q),
m AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[a + (i - 1 - a) % p + 1] END) ELSE w END AS w FROM t),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(generate_series(0, n - 1)) AS i FROM m),
z AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM z),
l AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM k GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, s, l, min(p) AS p FROM l GROUP BY doc_id, s, l),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines, arg_min({{'s': s, 'l': l, 'p': p}}, (-l, s, p)) AS best FROM r GROUP BY doc_id),
y AS (SELECT doc_id, list(i) AS gone FROM (SELECT DISTINCT doc_id, unnest(generate_series(s + p, s + l - 1)) AS i FROM r) GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256 FROM m LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)
"""

SQL = {"op3_line_dedup": OP3_SQL, "op5_exact_topk": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op11_ngram_jaccard": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_periodic_runs": OP13_SQL}
