"""N-gram Jaccard join: documents whose shingle sets are alike, by rare-first prefixes, exactly.

Texts with one set of shingles are one class. Shingles are ordered from the rarest to the commonest, so that those of one
class alone come first. Two sets of n and m shingles that are alike to `percent` share ceil(percent (n + m) / (100 +
percent)) of them, so they share one in the prefix of the larger set (n - ceil(percent n / 100) + 1 shingles) and in the
shorter prefix of the smaller set (its least overlap with a set that isn't smaller). Only prefixes are posted, and most
classes post nothing: a class that shares fewer than `percent` of its shingles with any other is alike to none.

A pair that meets at a shingle goes on if its sizes fit (length filter), if what comes behind the shingle's places can still
hold the overlap (positional filter; it holds at the first shingle that the pair shares), and if the counts of
the two sets in 64 parts of the hash range can (suffix filter: the parts' smaller counts add up to the most that two sets can share). Each pair
is then verified once, on full sets.

Groups of many like texts don't become all their pairs: a list of over MANY classes is compared in blocks, with all overlaps
of two blocks counted at once and links sent on only as they join components. Where lists are far longer than a block,
rounds go first in which each class that meets classes of other components is compared with one hub, a class that the most of its
lists name; verified links make components, and pairs within a component are left out. What is left over - a list's
classes outside its commonest component against the whole list - is compared, so that no link between components is
missed: in short lists pair by pair, in long ones by blocks. Hubs are spread over salts.

Edge cases: null and empty texts have no shingles and no links; a text shorter than a shingle is one shingle. Rows of one
id are one document, linked with all that any of them is linked with. A row with a null id is linked with nothing and
has a null component. An empty table gives no rows. Extra columns don't matter: only id and text are read. Shingles and classes are
told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tasks, tidy, written
from .components import components
from .exchange import PACKED, buckets, from_planes, held_by_others, notes, packing
from .neardup import shingles

#: rounds of hubs at most; a round is due where lists are longer than so many, on average over postings: LONG if a quarter of the last
#: round's pairs were alike, else LONGER, as looking through a list costs little and hubs lead no further
ROUNDS, LONG, LONGER = 2, 1024, 16_384
#: lists of more classes are compared in blocks of so many classes and, on average, shingles at most; columns of a block's table at once
MANY, BLOCK, ENTRIES, COLUMNS = 64, 1024, 1_000_000, 4096
#: rows of one key that stay together; parts of the hash range that are counted
SPREAD, PARTS = 1_000, 64


def overlap(n: Column, m: Column, percent: int) -> Column:
    """What sets of n and m shingles share at least if they are alike."""
    return F.ceil((n + m) * percent / (100 + percent))


def _class(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sign(df: DataFrame, words: int) -> DataFrame:
    """(id, n, class) of rows (id, text): the set's size and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sets = [shingles(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(map(len, sets), pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.int64())], names=["id", "n", "class"])

    return df.mapInArrow(tidy(run), "id long, n long, class long")


def _likely(df: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """(class) of those that can be alike to any, by longer prefixes in order of hash, before anything is known of rarity.

    With l the share that a set may lack (and 1 at least), the first n - ceil(percent n / 100) + l shingles of each set are sent.
    Two sets that are alike share as many of them as the smaller l; a partner has at least `percent` of a set's shingles, and so
    at least `percent` of its l.
    """
    n, lack = buckets(df), 100 - percent

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sets = {}
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if i is not None and len(s := shingles(t, words)):
                    sets[_class(s)] = s[: len(s) + (-percent * len(s) // 100) + max(1, -(-lack * len(s) // 100))].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], names=["class", "set"])

    pack = packing(lambda s: np.frombuffer(s, np.uint64), ["class", "set"], n, True)
    packed = df.mapInArrow(tidy(lambda batches: pack(owned(batches))), PACKED)

    def count(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for who, ends, keys, _, _ in notes(rows):
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([len(np.unique(keys[a:z])) for a, z in zip(ends, ends[1:], strict=False)], pa.int64())], names=["class", "shared"])

    shared = held_by_others(packed, n, True, count, "class long, shared long")
    return shared.join(sizes, "class").where(F.col("shared") * 10_000 >= F.greatest(F.col("n") * lack * percent, F.lit(10_000))).select("class")


def _shared(sets: DataFrame, percent: int) -> DataFrame:
    """(class, n, value): the shingles that others hold too, of the classes that share enough of them to be alike to any."""
    n = buckets(sets)
    packed = sets.select("class", "set").mapInArrow(packing(lambda s: np.frombuffer(s, np.uint64), ["class", "set"], n, True), PACKED)
    held = held_by_others(packed, n, tell_first=True).select(F.col("owner").alias("class"), "keys")
    enough = held.join(sets.select("class", "n"), "class").where(F.length("keys") / 8 * 100 >= F.col("n") * percent)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            keys, size = np.unique(from_planes(row["keys"][0].as_py(), np.int64)), row["n"][0].as_py()
            if 100 * len(keys) >= percent * size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), x, np.int64)) for x in (row["class"][0].as_py(), size)] + [pa.array(keys)], names=["class", "n", "value"])

    return enough.select("class", "n", "keys").mapInArrow(tidy(unpack), "class long, n long, value long")


def _postings(rows: DataFrame, percent: int) -> DataFrame:
    """(value, often, class, n, place, short): the prefixes; short where the shingle is in the prefix against larger sets too."""
    by = Window.partitionBy("class")
    # a value's rows are few beside all: a class has hundreds
    placed = rows.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("value"))).withColumn("place", F.col("n") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("often", "value")) - 1)
    prefix = lambda least: F.col("place") <= F.col("n") - least
    placed = placed.where(prefix(F.ceil(F.col("n") * percent / 100)) & (F.col("often") > 1))
    return placed.withColumn("short", prefix(overlap(F.col("n"), F.col("n"), percent)))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, rep, n, parts, set) of the wanted classes (rep, class), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = []
            for rep, number, t in zip(*(batch[c].to_pylist() for c in ("rep", "class", "text")), strict=True):
                if len(s := shingles(t, words)) and _class(s) == number:
                    out.append((number, rep, len(s), np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS).tolist(), s.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["class", "rep", "n", "parts", "set"])

    # merged: what is wanted grows with the documents, so it isn't broadcast at any size
    return docs.join(wanted.withColumnRenamed("rep", "id").hint("merge"), "id").select(F.col("id").alias("rep"), "class", "text").mapInArrow(tidy(run), "class long, rep long, n long, parts array<int>, set binary").dropDuplicates(["class"])


def _beside(pairs: DataFrame, key: str, other: str, table: DataFrame) -> DataFrame:
    """`pairs` joined with `table` on `key`, the rows of a common key spread by `other`."""
    many = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("_salts")).where("_salts > 1")
    if many.isEmpty():
        return pairs.join(table, key)
    salts = F.coalesce("_salts", F.lit(1))
    left = pairs.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("_salts")
    right = table.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """`pairs` (a, b) with the columns of both classes' sets, as c_a and c_b; sets that no pair names don't travel."""
    named = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    sets = sets.select("class", *columns).join(named, "class", "left_semi")
    one = lambda key: sets.select(F.col("class").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in columns))
    return _beside(_beside(pairs, "a", "b", one("a")), "b", "a", one("b"))


def _most(x: Column, y: Column) -> Column:
    """What two sets can share at most, by the counts of their parts."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda s, a: s + a)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, filtered: bool = False) -> DataFrame:
    """(a, b), by representative: the pairs of classes that the suffix filter lets through, unless they are `filtered`, and whose sets are alike."""
    if not filtered:
        pairs = written(_both(pairs, sets, "n", "parts").where(_most(F.col("parts_a"), F.col("parts_b")) >= overlap(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch[c][i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(batch["rep_a"][i].as_py())
                    b.append(batch["rep_b"][i].as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _both(pairs, sets, "rep", "set").select("rep_a", "rep_b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def _lists(posts: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(value, often, class, rep, n, place, short, label, parts, size, held, outside, most): lists of several components; of lists with the same members the rarest shingle's.

    `posts` are postings, or the lists before `labels` were known: a list of one component stays one. `most` is the list's commonest component,
    `outside` the classes that aren't in it, `held` the shingles of all. The rarest of shingles that the same classes post is the first that any two of them share.
    """
    known = posts.select("value", "often", "class", "rep", "n", "place", "short", *(c for c in posts.columns if c == "parts"))
    known = known.withColumn("label", F.col("rep")) if labels is None else known.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    same = [F.sum(F.xxhash64("class", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    lists = known.groupBy("value").agg(F.min("often").alias("often"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), F.max("short").alias("any"), F.min("label").alias("x"), F.max("label").alias("y"), *same).where("x < y and any")
    lists = lists.groupBy("size", "held", "h1", "h2").agg(F.min(F.struct("often", "value")).alias("v")).select("v.value", "size", "held")
    mixed = known.join(lists, "value")
    mixed = written(mixed if "parts" in posts.columns else mixed.join(sets.select("class", "parts"), "class"))
    most = mixed.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max(F.struct("c", "label")).alias("m")).select("value", F.col("m.label").alias("most"), F.col("m.c").alias("inside"))
    return mixed.join(most, "value").withColumn("outside", F.col("size") - F.col("inside")).drop("inside")


def _toward_hubs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each class with the one hub of another component that leads most of its lists."""
    first = F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("first"), "class", "label", "n")).alias("hub")
    hubs = lists.groupBy("value", "size").agg(first)
    salts = F.ceil(F.col("size") / SPREAD).cast("int")
    spread = lists.withColumn("_salt", F.pmod(F.xxhash64("class"), salts).cast("int"))
    hubs = hubs.select("value", "hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    fit = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    met = spread.join(hubs, ["value", "_salt"]).where((F.col("label") != F.col("hub.label")) & fit)
    counted = met.groupBy("class", F.col("hub.class").alias("hub")).agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy("class").agg(F.max(F.struct("c", "hub")).alias("m"))
    return best.select(F.least("class", "m.hub").alias("a"), F.greatest("class", "m.hub").alias("b")).distinct()


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different components that pass the length and positional filters at some shingle, and the suffix filter."""
    side = lambda c: F.struct("n", "class", "place", "short", "label", "parts").alias(c)
    # the smaller set, of equal ones the smaller number, is the one whose shorter prefix is posted
    both = lists.where("label <> most").select("value", side("x")).join(lists.select("value", side("y")), "value").where("x.label <> y.label").select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("l"))
    left = F.least(F.col("s.n") - F.col("s.place"), F.col("l.n") - F.col("l.place"))
    least = overlap(F.col("s.n"), F.col("l.n"), percent)
    fit = (F.col("s.n") * 100 >= F.col("l.n") * percent) & (left >= least) & (_most(F.col("s.parts"), F.col("l.parts")) >= least)
    return both.where(F.col("s.short") & fit).select(F.least("s.class", "l.class").alias("a"), F.greatest("s.class", "l.class").alias("b")).distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share: values of many sets by products of 0/1 tables, those of few by their pairs."""
    m, sizes = len(sets), [len(s) for s in sets]
    keys, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    often = np.repeat(counts, counts)
    few = max(1, min(32, m // 16))
    shared = np.zeros((m, m), np.float32)
    rare = (often > 1) & (often <= few)
    k, o = keys[rare], owner[rare]
    for d in range(1, few):
        if not len(met := np.flatnonzero(k[d:] == k[:-d])):
            break
        shared += np.bincount(o[met] * m + o[met + d], minlength=m * m).reshape(m, m)
    shared += shared.T
    dense = often > few
    o, column = owner[dense], np.repeat(np.arange(np.count_nonzero(counts > few)), counts[counts > few])
    for at in range(0, column[-1] + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, (at, at + COLUMNS))
        table = np.zeros((m, column[z - 1] + 1 - at), np.float32)
        table[o[a:z], column[a:z] - at] = 1
        shared += table @ table.T
    shared = shared.astype(np.int64)
    np.fill_diagonal(shared, sizes)
    return shared


def _forest(alike: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join all that a symmetric table of links joins, fewer than it has rows."""
    seen, a, b = np.zeros(len(alike), bool), [], []
    for start in np.flatnonzero(alike.any(1)):
        front = np.array([] if seen[start] else [start], np.int64)
        seen[start] = True
        while len(front):
            rows = alike[front]
            new = np.flatnonzero(rows.any(0) & ~seen)
            a += front[rows[:, new].argmax(0)].tolist()
            b += new.tolist()
            seen[new] = True
            front = new
    return a, b


def _by_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), by representative: links that join what the lists' pairs of different components join, by exact overlaps.

    A list's commonest component and the classes outside it are dealt to blocks of their own. Every two blocks meet, but not two of
    the commonest component; a row is sent for each class and meeting, none for a pair.
    """
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("size") * ENTRIES / F.col("held"))))
    dealt = lists.withColumns({"_few": F.ceil(F.col("outside") / width).cast("int"), "_rest": F.ceil((F.col("size") - F.col("outside")) / width).cast("int")})
    at = F.xxhash64("class", F.lit(1))
    dealt = dealt.withColumn("_block", F.when(F.col("label") != F.col("most"), F.pmod(at, "_few")).otherwise(F.col("_few") + F.pmod(at, "_rest")).cast("int"))
    # there are two blocks at least; of the commonest component's, each meets the others' alone
    others = F.filter(F.sequence(F.lit(0), F.when(F.col("label") != F.col("most"), F.col("_few") + F.col("_rest")).otherwise(F.col("_few")) - 1), lambda x: x != F.col("_block"))
    rows = written(dealt.select("value", "class", "label", "_block", F.explode(others).alias("_other")).select("value", "class", "label", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j")))
    named = sets.select("class", "rep", "set").join(rows.select("class").distinct(), "class", "left_semi")

    def settle(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        reps, labels, found = zip(*group, strict=True)
        shared, labels = _overlaps([np.frombuffer(s, np.uint64) for s in found]), np.array(labels)
        n = np.diag(shared)
        a, b = _forest((100 * shared >= percent * (n[:, None] + n - shared)) & (labels[:, None] != labels))
        yield pa.RecordBatch.from_pydict({"a": pa.array([reps[x] for x in a], pa.int64()), "b": pa.array([reps[x] for x in b], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for value, i, j, *row in zip(*(batch[c].to_pylist() for c in ("value", "i", "j", "rep", "label", "set")), strict=True):
                if (value, i, j) != last and group:
                    yield from settle(group)
                    group = []
                last = value, i, j
                group.append(row)
        if group:
            yield from settle(group)

    met = rows.join(named, "class").repartition(tasks(lists.sparkSession), "value", "i", "j").sortWithinPartitions("value", "i", "j")
    return met.select("value", "i", "j", "rep", "label", "set").mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `df`: id, n_shingles and component_id, the smallest id that links lead to."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(sign(docs, words))
    own = signed.where("n > 0 and id is not null")
    classes = written(own.groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    likely = written(classes.join(_likely(docs, classes.select("class", "n"), words, percent), "class", "left_semi").select("class", "rep"))
    sets = written(_sets(docs, likely, words))
    posts = written(_postings(written(_shared(sets, percent)), percent).join(likely, "class"))

    # rows of one id are one document: the classes of an id are linked through its smallest representative
    placed = own.join(classes.select("class", "rep"), "class").select("id", "rep", "n")
    least = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most")
    links = written(placed.join(least, "id").where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    labels = None if links.isEmpty() else components(links)
    met, fruitful = None, True
    for turn in range(ROUNDS + 1):
        posts = lists = written(_lists(posts, sets, labels))
        left = lists.agg(F.sum(F.when(F.col("label") != F.col("most"), F.col("size"))).alias("pairs"), F.count(F.lit(1)).alias("n")).first()
        if not left.pairs:
            break
        last = turn == ROUNDS or left.pairs <= (LONG if fruitful else LONGER) * left.n
        pairs = _across(lists.where(F.col("size") <= MANY), percent) if last else _toward_hubs(lists, turn, percent)
        pairs = written(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"))
        met = pairs if met is None else met.unionByName(pairs)
        new = written(_verified(pairs, sets, percent, filtered=last))
        fruitful = last or 4 * new.count() >= pairs.count()
        if last and not (long := lists.where(F.col("size") > MANY)).isEmpty():
            new = written(new.unionByName(_by_blocks(long, sets, percent)))
        if not new.isEmpty():
            links = written(links.unionByName(new))
            labels = components(links)
        if last:
            break

    out = placed.select("id", "n", F.col("rep").alias("component_id")) if labels is None else placed.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component_id"))
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles")
