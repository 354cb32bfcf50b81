"""MinHash near-dedup by a signature-coordinate inverted join.

Texts with one set of shingles are one class. A class posts its representative under its coordinate-value
pairs. Two texts count as candidates if at least `matches` of `coordinates` values agree. Pairs ordered from
the rarest, two such texts must share one among all but `matches` - 1 of their pairs (the prefix), and a pair
that only one class has is skipped, so most texts post nothing. Lists with the same members are merged to one of
their number's weight. Collisions are counted by pair over the lists, those of candidates on whole signatures, and
links confirmed on the full sets.

First, in a few rounds, every class meets one other, the hub that leads most of its lists; confirmed links make
components, and from then on members of one component skip each other. What is left of a list of up to SHORT
members is joined with itself. A longer one is cut into blocks: each two blocks are compared as arrays of signatures,
a pair in the first list that its prefixes share, and only where pairs reach `matches` are the blocks' full sets sent
and compared, so that neither all pairs of a list nor all candidates become rows. With 64 values and 32 matches a
link at similarity 0.75 is missed with a probability of about 4e-6; candidates below it are confirmed exactly.

Edge cases: null and empty texts have no shingles and no links; shorter texts than a shingle are one shingle.
Rows of one id are one document, linked with all that any of them is linked with. A row with a null id is
linked with nothing. An empty table gives no rows. Extra columns don't matter: only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix, tidy, word_hashes, written
from .components import SALTS, components
from .exchange import PACKED, buckets, held_by_others, notes, packing

#: hub rounds at most; members of a list that is joined with itself; texts of a block
ROUNDS, SHORT, BLOCK = 2, 64, 128
SIGNED = "id long, n long, same binary, sig array<long>"


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    if 0 < len(hashes) < words:
        return gram_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(gram_hashes(hashes, words))


def sign(df: DataFrame, key: str, text: str, words: int, coordinates: int) -> DataFrame:
    rng = np.random.default_rng(20240229)
    factor, shift = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coordinates, np.uint64)
    salt = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, same, sig = [], [], []
                for t in batch["text"].to_pylist():
                    found = shingles(t, words)
                    n.append(len(found))
                    same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if not len(found):
                        sig.append(None)
                        continue
                    least = np.array([(found * a + b).min() for a, b in zip(factor, shift, strict=True)], np.uint64)
                    sig.append(mix(least ^ salt).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], names=["id", "n", "same", "sig"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), SIGNED)


def _postings(reps: DataFrame, matches: int) -> DataFrame:
    """(value, id): each representative under the prefix of its shared coordinate values."""
    n = buckets(reps)
    packed = reps.select("id", "sig").mapInArrow(packing(lambda sig: np.array(sig, np.int64).view(np.uint64), ["id", "sig"], n, True), PACKED)

    def unpack(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for who, ends, keys, _, _ in notes(rows):
            parts = [(o, np.unique(keys[a:z].view(np.int64))) for o, a, z in zip(who.tolist(), ends, ends[1:], strict=False)]
            if parts := [(o, k) for o, k in parts if len(k) >= matches]:
                yield pa.RecordBatch.from_pydict({"value": pa.array(np.concatenate([k for _, k in parts])), "id": pa.array(np.repeat([o for o, _ in parts], [len(k) for _, k in parts]).astype(np.int64))})

    rows = written(held_by_others(packed, n, True, unpack, "value long, id long"))
    often = rows.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ordered = rows.join(often, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("all"))
    return written(ordered.where(F.size("all") >= matches).select("id", F.explode(F.slice("all", 1, F.size("all") - (matches - 1))).alias("p")).select("p.value", "id"))


def _mixed(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(value, id, label, size, weight): lists that hold several components; of lists with the same members one."""
    known = posts.join(labels, "id", "left").select("value", "id", F.coalesce("label", "id").alias("label"))
    same = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    lists = known.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y"), *same).where("x < y")
    lists = lists.groupBy("size", "h1", "h2").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("weight"))
    return known.join(lists.select("value", "size", "weight"), "value")


def _count(pairs: DataFrame, reps: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs that agree in enough coordinates."""
    left, right = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    agree = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return both.where(near & (agree >= matches)).select("a", "b").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if (a, ta) != last:
                    last, left = (a, ta), shingles(ta, words)
                right = shingles(tb, words)
                inter = len(np.intersect1d(left, right, assume_unique=True))
                if inter and 100 * inter >= percent * (len(left) + len(right) - inter):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    texts = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    texts = texts.join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return texts.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct()


def _short(lists: DataFrame) -> DataFrame:
    """(a, b, often): pairs of different components by the number of lists that they share."""
    left, right = (lists.select("value", "weight", F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in "ab")
    pairs = left.join(right.drop("weight"), "value").where("a < b and l_a <> l_b")
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("often"))


def _agreeing(left: list[dict], right: list[dict] | None, value: int, matches: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates in two blocks of one list, or in one: of different labels and in no earlier list together."""
    other = left if right is None else right
    a, b = (np.array([x["sig"] for x in side], np.int64) for side in (left, other))
    agree = np.stack([(x == b).sum(axis=1) for x in a])
    la, lb = (np.array([x["label"] for x in side]) for side in (left, other))
    na, nb = (np.array([x["n"] for x in side]) for side in (left, other))
    ok = (agree >= matches) & (la[:, None] != lb) & (np.minimum(na[:, None], nb) * 100 >= np.maximum(na[:, None], nb) * percent)
    if right is None:
        ok &= np.arange(len(left))[:, None] < np.arange(len(left))
    i, j = np.nonzero(ok)
    lists = [[set(x["lists"]) for x in side] for side in (left, other)]
    first = np.array([min(lists[0][x] & lists[1][y]) == value for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    return i[first], j[first]


def _linked(left: list[dict], right: list[dict] | None, at: np.ndarray, to: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of candidates, by place, links by full sets: no more than join the components."""
    other = left if right is None else right
    sets = [[np.frombuffer(x["set"], np.uint64) for x in side] for side in (left, other)]
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = x = head[head[x]]
        return x

    out = []
    for i, j in zip(at.tolist(), to.tolist(), strict=True):
        x, y = root(left[i]["label"]), root(other[j]["label"])
        if x == y:
            continue
        a, b = sets[0][i], sets[1][j]
        inter = len(np.intersect1d(a, b, assume_unique=True))
        if inter and 100 * inter >= percent * (len(a) + len(b) - inter):
            head[x] = y
            out.append((min(left[i]["id"], other[j]["id"]), max(left[i]["id"], other[j]["id"])))
    return out


def _long(lists: DataFrame, reps: DataFrame, docs: DataFrame, matches: int, words: int, percent: int) -> DataFrame:
    """Links between components in long lists, block by block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = lists.select("value", "id", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    own = lists.groupBy("id").agg(F.collect_set("value").alias("lists"))
    whole = placed.join(own, "id").join(reps.select("id", "n", "sig"), "id")
    whole = written(whole.groupBy("value", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("id", "label", "n", "lists", "sig"))).alias("texts")))

    def pairs(table: DataFrame) -> DataFrame:
        """One row for each two blocks, sent on by number so that a long list's are spread; right is null for a block with itself."""
        right = table.select("value", F.col("block").alias("other"), F.col("texts").alias("right"))
        two = table.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumnRenamed("texts", "left")
        apart = two.where("other > block").join(right, ["value", "other"]).select("value", "block", "other", "left", "right")
        return apart.unionByName(two.where("other = block").select("value", "block", "other", "left", F.lit(None).cast(table.schema["texts"].dataType).alias("right")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                at, to = _agreeing(r["left"], r["right"], r["value"], matches, percent)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"value": pa.array([r["value"]], pa.int64()), "block": pa.array([r["block"]], pa.int32()), "other": pa.array([r["other"]], pa.int32()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "to": pa.array([to.astype(np.int32).tobytes()], pa.binary())})

    met = written(pairs(whole).mapInArrow(tidy(count), "value long, block int, other int, at binary, to binary"))
    needed = met.select("value", "block").unionByName(met.select("value", F.col("other").alias("block"))).distinct()
    members = placed.join(needed, ["value", "block"])
    texts = docs.join(members.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("id", "text", "value", "block", "label").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "value", "block", "label")), pa.array([shingles(t, words).tobytes() for t in batch["text"].to_pylist()], pa.binary())], names=["id", "value", "block", "label", "set"])

    full = texts.mapInArrow(tidy(sets), "id long, value long, block int, label long, set binary")
    full = written(full.groupBy("value", "block").agg(F.array_sort(F.collect_list(F.struct("id", "label", "set"))).alias("texts")))
    both = met.join(full.withColumnRenamed("texts", "left"), ["value", "block"]).join(full.select("value", F.col("block").alias("other"), F.col("texts").alias("right")), ["value", "other"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found = _linked(r["left"], r["right"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["to"], np.int32), percent)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return written(both.select("left", "right", "at", "to").mapInArrow(tidy(confirm), "a long, b long").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, coordinates: int = 64, matches: int = 32) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id (the smallest id that can be reached) and kept."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(sign(df, key, text, words, coordinates))
    own = signed.where("n > 0 and id is not null")
    classes = written(own.groupBy("same").agg(F.min("id").alias("rep")))
    reps = written(own.join(classes.withColumnRenamed("rep", "id"), ["same", "id"], "left_semi").select("id", "n", "sig").distinct())
    posts = _postings(reps, matches)
    docs = written(docs.join(posts.select("id").distinct(), "id", "left_semi"))  # only these are ever compared

    # rows of one id are one document: the classes of an id are linked through its smallest representative
    placed = own.join(classes, "same").select("id", "rep", "n")
    least = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most")
    links = written(placed.join(least, "id").where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    empty = placed.select("id", F.col("rep").alias("label")).limit(0)
    labels, met = empty if links.isEmpty() else components(links), None
    for turn in range(ROUNDS + 1):
        known = written(_mixed(posts, labels))
        many = known.where(F.col("size") > SHORT)
        if turn == ROUNDS or known.isEmpty() or (turn and many.isEmpty()):
            break
        first = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        hubs = known.groupBy("value").agg(F.min(F.struct(first.alias("first"), "id", "label")).alias("hub"))
        hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))  # a list may hold most documents
        toward = salted.join(hubs, ["value", "salt"]).where("label <> hub.label").groupBy("id", F.col("hub.id").alias("hub")).agg(F.sum("weight").alias("often"))
        chosen = toward.groupBy("id").agg(F.max(F.struct("often", -F.col("hub"))).alias("m")).select("id", (-F.col("m.col2")).alias("hub"))
        pairs = chosen.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = written(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"))
        met = pairs if met is None else met.unionByName(pairs)
        new = written(_confirm(_count(pairs, reps, matches, percent), docs, words, percent))
        if new.isEmpty():
            break
        links = written(links.unionByName(new))
        labels = components(links)

    if not known.isEmpty():
        pairs = _short(known.where(F.col("size") <= SHORT)).select("a", "b")
        pairs = written(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"))
        more = written(_confirm(_count(pairs, reps, matches, percent), docs, words, percent))
        if not many.isEmpty():
            more = more.unionByName(_long(many, reps, docs, matches, words, percent))
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    out = placed.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component_id"))
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = out.unionByName(alone).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
