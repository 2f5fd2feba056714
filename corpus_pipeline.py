"""A corpus cleaned from end to end: toxic documents go, near copies go but one, repeated passages and benchmark leaks
go, and what is left becomes pieces.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its result is written as
Parquet and read again. All stages but the last return the columns of ``docs``. Null texts stay (they are no copies and
no leaks), null ids stay, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm import common, decontaminate, partenum, pieces, suffixes, toxicity
from herdlens.llm.queries import tokenizer_path

#: A repeated passage has so many words at least, of any length.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus' labels, rejects go."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    judged = toxicity.score(docs, model, column="__toxicity__")
    return judged.where(F.col("__toxicity__") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle sets with a similarity of 0.8 or more, one row stays, of the smallest doc_id."""
    common.table(spark, sf_dir, "documents")
    return partenum.drop_copies(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start anywhere else as well go from every text; ``n_chars`` follows."""
    common.table(spark, sf_dir, "documents")
    kept = suffixes.deduplicate(docs, words=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with a benchmark item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, sampled segmentations, and whether they decode to the text."""
    common.table(spark, sf_dir, "documents")
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"), tokenizer_path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("pieces", to_pieces),
]
#: Training a classifier and contracting components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERY = {"pipeline": run}
