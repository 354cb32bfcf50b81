"""URL filter by a character language-model ratio.

Rules see host and path, the models the whole url with scheme, query string and fragment. Two variable-order
Markov models, of accepted and of rejected urls, back off from the longest context seen to
shorter ones (Witten-Bell smoothing). A url's score is the difference of their log likelihoods for each
character; the threshold is calibrated on labelled urls that were not trained on. Rules decide first; the
urls they decide are the labels.

Edge cases: a null url, or one without `://`, has an empty host and path and fits no rule; the latter is
scored like any other. A null or empty url isn't scored: its score is 0 and it is allowed. Without labels of either kind every score is 0 and the verdict
is allow. Repeated rows get equal verdicts. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import scan
from .common import fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equal lengths the first by name); else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Markov:
    """Counts (context, char, n) of the character that follows each context of up to `order` characters: rows, or a table of them."""

    rows: list[tuple[str, str, int]] | DataFrame
    order: int

    def table(self, like: DataFrame) -> DataFrame:
        return self.rows if isinstance(self.rows, DataFrame) else like.sparkSession.createDataFrame(self.rows, GRAMS)


@dataclass(frozen=True)
class Model:
    accepted: Markov | None
    rejected: Markov | None
    threshold: float


GRAMS = "context string, char string, n long"
#: pieces that are more than this share of all places go to the tasks that hold the urls: there are fewer than its inverse
COMMON = 1 / 20_000


def _pieces(text: Column, order: int) -> Column:
    """Each character of a text, its start and end marked, with up to `order` characters before it."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(2), F.char_length(text) + 2), lambda i: F.substring(marked, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1))))


def _ends(piece: Column) -> Column:
    """A piece and what is left of it without its first characters: its last character with contexts of all lengths."""
    return F.transform(F.sequence(F.lit(1), F.char_length(piece)), lambda i: F.substring(piece, i, F.char_length(piece)))


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """(label, context, char, n) of rows (label, text)."""
    pieces = rows.select("label", F.explode(_pieces(F.col("text"), order)).alias("gram")).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n"))
    grams = pieces.select("label", F.explode(_ends(F.col("gram"))).alias("gram"), "n").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    before = F.char_length("gram") - 1
    return grams.select("label", F.substring("gram", F.lit(1), before).alias("context"), F.substring("gram", before + 1, F.lit(1)).alias("char"), "n")


def _ratios(pieces: DataFrame, model: Model) -> DataFrame:
    """(piece, ratio) of distinct (piece): the log of how much likelier its last character is among accepted urls, from short contexts to long ones."""
    sides = [m.table(pieces).select(F.concat("context", "char").alias("gram"), "context", *(F.col("n").alias(c) if c == side else F.lit(0).cast("long").alias(c) for c in "ab")) for side, m in (("a", model.accepted), ("b", model.rejected))]
    grams = sides[0].unionByName(sides[1]).groupBy("gram", "context").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = grams.groupBy("context").agg(*(x for c in "ab" for x in (F.sum(c).alias(f"all_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}"))))
    needed = pieces.select(F.explode(_ends(F.col("piece"))).alias("gram")).distinct().withColumn("context", F.substring("gram", F.lit(1), F.char_length("gram") - 1))
    known = written(needed.join(grams.drop("context"), "gram", "left").join(totals, "context", "left").withColumn("size", F.char_length("gram")))

    def smoothed(c: str, shorter: Column) -> Column:
        return F.when(F.col(f"all_{c}") > 0, (F.coalesce(c, F.lit(0)) + F.col(f"kinds_{c}") * shorter) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(shorter)

    least, out, last = F.lit(1 / 65536), None, None
    for size in range(1, max(model.accepted.order, model.rejected.order) + 2):
        level = known.where(F.col("size") == size)
        if last is None:
            level = level.select("gram", smoothed("a", least).alias("p_a"), smoothed("b", least).alias("p_b"))
        else:
            level = level.join(last.select(F.col("gram").alias("_rest"), F.col("p_a").alias("_a"), F.col("p_b").alias("_b")), F.substring("gram", F.lit(2), F.lit(size)) == F.col("_rest"))
            level = level.select("gram", smoothed("a", F.col("_a")).alias("p_a"), smoothed("b", F.col("_b")).alias("p_b"))
        last = written(level)
        out = last if out is None else out.unionByName(last)
    # decimals: sums don't depend on their order, so equal urls have equal scores
    ratio = (F.ln("p_a") - F.ln("p_b")).cast("decimal(20,16)").alias("ratio")
    return out.select(F.col("gram").alias("piece"), ratio).join(pieces, "piece", "left_semi")


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    """(row, score) of written (row, text) with texts that have characters. Urls and pieces meet by shuffle, the few common pieces by broadcast."""
    places = rows.select("row", (F.char_length("text") + 1).alias("places"), F.explode(_pieces(F.col("text"), max(model.accepted.order, model.rejected.order))).alias("piece"))
    counts = written(places.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    ratios = written(_ratios(counts.select("piece"), model).join(counts, "piece"))
    most = (counts.agg(F.sum("n")).first()[0] or 0) * COMMON
    common = ratios.where(F.col("n") > most).select("piece", F.col("ratio").alias("_ratio"))
    met = places.join(F.broadcast(common), "piece", "left")
    own = met.where("_ratio is not null").select("row", "places", F.col("_ratio").alias("ratio"))
    rare = met.where("_ratio is null").select("row", "places", "piece").join(ratios.where(F.col("n") <= most), "piece").select("row", "places", "ratio")
    # each side's sums first: most of a url's places are summed where it is read
    summed = [x.groupBy("row", "places").agg(F.sum("ratio").alias("ratio")) for x in (own, rare)]
    return summed[0].unionByName(summed[1]).groupBy("row", "places").agg(F.sum("ratio").cast("double").alias("ratio")).select("row", (F.col("ratio") / F.col("places")).alias("score"))


def _threshold(marks: DataFrame) -> float | None:
    """The cut of (score, allow, block) counts with the best balanced accuracy, of equal ones the lowest: half-way to the next lower score."""
    marks = marks.groupBy("score").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).withColumn("all", F.lit(0))
    rows = scan.chunked(marks, "all", "score")
    w = scan.within("all", "score")
    under = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"lost": F.sum("allow").over(under), "caught": F.sum("block").over(under), "below": F.lag("score").over(w)})
    sums = rows.groupBy("all", "_chunk").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.max("score").alias("s"))
    off = {"_lost": F.sum("a"), "_caught": F.sum("b"), "_below": F.max("s")}
    sums = sums.withColumns({c: x.over(scan.before("all")) for c, x in off.items()}).drop("a", "b", "s", "all")
    total = marks.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not total.allow or not total.block:
        return None
    zero = lambda x: F.coalesce(x, F.lit(0))
    rows = rows.join(F.broadcast(sums), "_chunk")  # a row for each chunk
    worth = (total.allow - zero(scan.plus(F.col("_lost"), F.col("lost")))) / F.lit(total.allow) + zero(scan.plus(F.col("_caught"), F.col("caught"))) / F.lit(total.block)
    below = F.coalesce("below", "_below")
    best = rows.agg(F.max_by(F.coalesce((F.col("score") + below) / 2, F.col("score")), F.struct(worth, -F.col("score"))).alias("cut")).first()
    return best.cut


def fit(labelled: DataFrame, text: str = "text", label: str = "label", order: int = 5) -> Model:
    """Fit on all distinct urls that are labelled allow or block.

    A fifth of them, chosen by a hash of themselves, isn't trained on and calibrates the threshold: the score where the
    balanced accuracy is best. Counts stay tables; only the threshold is a number of the driver.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text <> '' and label in ('allow', 'block')").distinct()
    rows = written(rows.select("*", (F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5)) == 0).alias("held"), F.monotonically_increasing_id().alias("row")))
    counts = written(_counted(rows.where(~F.col("held")), order))
    if {r["label"] for r in counts.select("label").distinct().collect()} != {"allow", "block"}:
        return Model(None, None, 0.0)
    accepted, rejected = (Markov(counts.where(F.col("label") == x).drop("label"), order) for x in ("allow", "block"))
    held = rows.where("held")
    marks = held.join(_scores(held.select("row", "text"), Model(accepted, rejected, 0.0)), "row")
    marks = written(marks.select("score", *((F.col("label") == x).cast("long").alias(x) for x in ("allow", "block"))))
    return Model(accepted, rejected, _threshold(marks) or 0.0)


def judge(df: DataFrame, model: Model, text: str) -> DataFrame:
    """`df` with score and judged: block where the score is under the threshold, else allow; so is a text without characters. Rows keep their order."""
    df = df.drop("score", "judged")
    if not model.accepted or not model.rejected:
        return df.withColumns({"score": F.lit(0.0), "judged": F.lit("allow")})
    (row,) = fresh(df, "row")
    df = written(df.withColumn(row, F.monotonically_increasing_id()))  # numbers of rows that stay
    scores = _scores(df.where(F.col(text) != "").select(F.col(row).alias("row"), F.col(text).alias("text")), model).withColumnRenamed("row", row)
    out = df.join(scores, row, "left").orderBy(row).drop(row)
    judged = F.when(F.col("score") < model.threshold, "block").otherwise("allow")
    return out.withColumns({"judged": judged, "score": F.coalesce("score", F.lit(0.0))}).select(*df.drop(row).columns, "score", "judged")
