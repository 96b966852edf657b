"""From raw documents to a training mix: rules, near duplicates, benchmark passages, secrets, and source weights.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of the
table `documents`; the last adds `copy`, the number of the copy, and has a row for each copy that the mix takes. A
stage's result is written as Parquet and read again as the next one's input.

Every stage keeps the table's own columns and their values, whatever their names. A null or empty text is rejected by the
quality rules for its few words; given to a later stage it is linked with nothing, holds no passage and no secret, and is
taken once. Repeated rows are near duplicates of each other: rows of one id stay or go together. An empty table gives an
empty table at every stage and in the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanlore.llm.decontaminate import keep_clean
from lanlore.llm.mixing import mix
from lanlore.llm.near_dedup import keep_one
from lanlore.llm.quality_rules import keep_good
from lanlore.llm.secret_scan import masked
from lanlore.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 or more over five-word shingles, the document with the smallest id stays."""
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; `n_chars`, where there is one, follows the text where that was changed."""
    changed = masked(docs.withColumn("_before", F.col("text")))
    if "n_chars" in docs.columns:
        length = F.when(F.col("text") != F.col("_before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", length)
    return changed.drop("_before")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that brings the sources to their target weights. A column `copy` of the table's own gives way."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"])
    mixed = mix(docs.select("doc_id", "text", "source", row.alias("_row"))).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("_row.*", "copy")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing", mixture),
]
#: Newton iterations and the rounding of rates have no counterpart in SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
