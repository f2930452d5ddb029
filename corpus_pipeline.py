"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination and packing of ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read back as the next stage's docs. All but the last return the columns of ``documents``; extra columns pass
through. SQL can't express the learned and hashed stages, so tests compare them with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import private, written
from lectern.llm.decontam import leaked
from lectern.llm.encoding import tokenizer_path
from lectern.llm.linededup import remove_boilerplate
from lectern.llm.packing import COLUMNS, pack
from lectern.llm.simhash import one_of_each_group
from lectern.llm.toxicity import fit, score_column


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model does not hold for toxic (score below 0.5).

    Null and empty texts score 0 and stay; rows without a doc_id are scored but not learned from; repeated rows score alike
    and stay or go together; with labels of one kind only every score is their rate; an empty table gives no row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.where(score_column(model)["score"] < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that spread over ten sites or more and stand earlier elsewhere.

    Null and empty texts stay as they are; a null source is a site of its own; rows of one doc_id, or of none, are one
    document and are cut alike; n_chars follows a text that was cut; an empty table gives no row.
    """
    if "n_chars" not in docs.columns:
        return remove_boilerplate(docs, site="source", min_sites=10)
    lines, removed = private(docs, "lines", "removed")
    kept = remove_boilerplate(docs, site="source", min_sites=10, counts=(lines, removed))
    chars = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingle sets of similarity 0.8.

    Null and empty texts are one group, of no words; a group with no doc_id keeps one row; of rows that repeat a doc_id and
    its words one stays; an empty table gives no row.
    """
    return one_of_each_group(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words in edits.

    Null and empty texts hold none and stay; repeated rows stay or go together; without items everything stays.
    """
    return docs.where(~leaked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-id sequences, sources mixed in each by their share of what was kept.

    Null and empty texts are their end id; every row is packed, repeated or without a doc_id; an empty table gives no row.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2).select(*COLUMNS, "queue", "ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
