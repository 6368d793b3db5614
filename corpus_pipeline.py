"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Stages but the last return
the columns of documents. Whoever runs the stages writes each result as Parquet and reads it as the next one's docs.

Rows with a null id or text pass the filtering stages (a null text has no words, so nothing is found in it) and are packed as
an end token alone. Rows that share an id are judged alike by near-dup and decontamination: if one goes, all go. An empty
table gives empty results. Columns besides doc_id and text may have any names and stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import fresh, materialize
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.queries import vocabulary
from tessera.llm.toxicity import reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose expected grade of toxicity, by a model of the labelled ones, is too high."""
    return reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of equal or nearly equal lines; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates."""
    from pyspark.sql import functions as F

    (gone,) = fresh(docs.columns, "gone")
    rest = near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(rest, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece."""
    return pack_documents(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained grades, edit distances and bred packings are beyond SQL; tests/llm/test_pipeline.py holds a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
