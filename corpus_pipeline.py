"""From raw documents to packed sequences: five operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import langid, lines, neardup, packing, substring
from barloom.llm.common import read, written
from barloom.llm.queries import MIN_PAGES, PIECES, pack_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no language explains better than the others together, go."""
    model = langid.fit(docs, langid.vocabulary(PIECES), key=F.col("doc_id"))
    found = langid.identify(docs.select(COLUMNS), model)
    return found.where("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a site repeats go; a document of nothing else goes with them."""
    out = lines.drop_boilerplate(docs.select(COLUMNS), min_pages=MIN_PAGES).where("_n_dropped = 0 or text rlike '\\\\S'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document of nothing else goes with them."""
    out = substring.factor(docs.select(COLUMNS)).where("_n_removed = 0 or _n_removed < _n_words")
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(pack_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("boilerplate", boilerplate), ("near_copies", near_copies), ("repeats", repeats), ("sequences", sequences)]

#: SQL cannot express language identification, signatures and tokens; not every stage is held against brute force yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
