"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept (Parquet, read again) and returns those it keeps, with the
columns of documents; the last returns packed pieces. Rows that share a doc_id are one document and stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import decontaminate, jaccard, language, packing, quality
from veritrail.llm.common import crc_mod, shared_dir, table
from veritrail.llm.queries import QUALITY_THRESHOLD, byte_encoder

#: A text of so many words, of which fewer than this share occur in any learned language, is in none of them.
LANGUAGE_WORDS, LANGUAGE_KNOWN = 12, 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores at the threshold or above."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    _, model = quality.trained(docs, labels)
    return docs.where(quality.text_score(model)(F.col("text")) >= QUALITY_THRESHOLD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Those without letters go, and those of ``LANGUAGE_WORDS`` words and more that hardly have a word of any learned
    language, however many of these there are; shorter ones say too little and stay.
    """
    model = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = language.text_language(model, spark)(F.col("text"))
    return docs.where(F.transform(F.array(found), lambda x: (x["lang_pred"] != language.UNKNOWN) & ((x["words"] < LANGUAGE_WORDS) | (x["known"] >= LANGUAGE_KNOWN)))[0])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    first = jaccard.join(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all that is left."""
    return packing.crc32_of(packing.pack(docs, byte_encoder))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]
#: Trained models and searches: SQL doesn't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/veritrail/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
