"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage works on all documents its predecessor kept. All stages but the last return the columns of documents, extra
ones included, also those whose names a stage uses itself. Null and empty texts are documents without words: near-dedup and substring dedup leave them alone, as does
decontamination. Rows that share an id are documents of their own. Repeated rows: one stays after near-dedup. A document
without an id goes in near-dedup if it resembles one that has an id, and stays otherwise; substring dedup takes no words from it. An empty
table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, neardup, pieces, quality, substring
from corpusgraph.llm.common import forget, shared_dir, stored, table


def _named(docs: DataFrame) -> DataFrame:
    """Columns by names of their own, so that none is taken for one that a stage adds."""
    return docs.toDF(*(f"in_{c}" for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its fit uses labelled documents that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    good = quality.classify(_named(docs), model, text_col="in_text").where("predicted = 1")
    return good.drop("score", "predicted").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id; of equal rows, one."""
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    # By row, not by id: of rows that share an id only those whose own text is kept stay.
    left = _named(docs).join(kept, F.col("in_doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("in_text") == F.col("kept_hash")), "left_semi")
    same = Window.partitionBy("in_doc_id", F.xxhash64("in_text")).orderBy("in_doc_id")
    return left.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy").toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that start in a document with a smaller id; a text left empty goes.

    Texts that lose nothing stay as they are; others are their words joined by spaces.
    """
    out = substring.remove_repeats(docs, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("in_text"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    out = out.where("n_removed = 0 OR kept <> ''")
    return out.select(*(made.get(c, F.col(f"in_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces, a sampled segmentation. The text returned is the one decoded from the pieces;
    where it differs from the text encoded, the run fails. A null text stays null."""
    return pieces.encode(docs, text_decoded=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: None of the stages can be written in SQL as a whole; tests/llm compares stages with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder, read by the next and removed once that is
    written. The folder of the last but one stays for as long as the result is read."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"{root}/stage{n}")
            if n:
                forget(spark, f"{root}/stage{n - 1}")
    return docs
